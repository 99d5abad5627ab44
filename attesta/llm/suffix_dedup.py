"""Suffix-array dedup: bytes covered by a 400-byte string that also starts elsewhere are removed.

Equal strings have to meet. A string's anchor is the place of the least hash among its 128-byte substrings (the leftmost
of equals), which equal strings have at the same place in themselves. The strings of a document that start in a row and have
the same anchor make a piece: their starts, and the bytes from the first start to the last string's end. So every start
is in one piece, and all occurrences of a string are in pieces of the same anchor substring, the piece's key.

1. A scan of the documents lists the pieces (document, start, number of starts, key). Keys found once are dropped.
2. The documents of the other pieces are fetched once; pieces equal in all bytes are counted and become one. Where a key
   has one such piece only, there is nothing to sort: all its strings occur as often as the piece does.
3. The other pieces, one of each kind, go to shards by key. A shard concatenates them, builds the suffix array by induced sorting and the permuted
   common prefixes, and marks the starts whose 400 bytes are those of another start, or of a piece that occurs more than once.
4. A key of more than `HOT` different pieces (a passage with as many different surroundings) doesn't go to one shard: its
   strings are named by 128-bit digests, as pieces are, and counted with partial sums, and so marked.
5. Marked runs go back to their documents, and what they cover is cut out.

A null text is empty; a text of fewer than 400 bytes loses nothing; an empty table gives an empty result. Repeated rows (equal id and text) are two documents:
what they have in common is removed from both. Extra columns are ignored. Cuts may fall inside a character: the kept
bytes are bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, real_id, row_key
from .sais import permuted_lcp, suffix_array

LENGTH = 400
ANCHOR = 128
HOT = 4096
SHARD = 1 << 19
SEPARATOR = 0xFF
#: Documents longer than this are listed in parts that overlap by a string.
PART = 1 << 23


def pieces(raw: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, key) of the pieces of a byte string."""
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    m, width = len(raw) - anchor + 1, length - anchor + 1
    at = np.arange(m)
    hashes = K.Prefix(raw).span(at, at + anchor)
    places = (hashes >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    # minima of windows: of the blocks' suffixes and prefixes
    pad = -m % width
    grid = np.concatenate([places, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    owner = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return first, np.diff(first, append=n), hashes[owner[first]].view(np.int64)


def _list(length: int, anchor: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = K.pack(batch.column("text"))
            k1, k2 = batch.column("k1"), batch.column("k2")
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                for lo in range(offs[i], max(offs[i + 1] - length + 1, offs[i]), most):
                    first, count, key = pieces(raw[lo : min(lo + most + length - 1, offs[i + 1])], length, anchor)
                    for held, x in zip(out, (np.full(len(first), i), first + (lo - offs[i]), count, key), strict=True):
                        held.append(x)
                if (i + 1) % 256 and i + 1 < batch.num_rows or not out[0]:
                    continue
                rows, first, count, key = (np.concatenate(x) for x in out)
                out = [[], [], [], []]
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [k1.take(rows), k2.take(rows), pa.array(first.astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(key)],
                    names=["k1", "k2", "start", "count", "key"],
                )

    return run


def _name(length: int):
    """Documents with their pieces to the pieces' names, a 128-bit digest of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = (batch.column("text")[row].as_py() or "").encode()
                own = batch.column("own")[row].values
                start, count = own.field("start").to_pylist(), own.field("count").to_pylist()
                names = [hashlib.blake2b(text[s : s + c + length - 1], digest_size=16).digest() for s, c in zip(start, count, strict=True)]
                same = pa.array(np.full(len(names), row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1").take(same), batch.column("k2").take(same), own.field("start"), own.field("count"), own.field("key"), pa.array(names, pa.binary())],
                    names=["k1", "k2", "start", "count", "key", "id"],
                )

    return run


def _cut_out(length: int):
    """Documents with the pieces that are to be read from them to those pieces' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = (batch.column("text")[row].as_py() or "").encode()
                own = batch.column("own")[row].values
                start, count = own.field("start").to_pylist(), own.field("count").to_pylist()
                data = [text[s : s + c + length - 1] for s, c in zip(start, count, strict=True)]
                yield pa.RecordBatch.from_arrays([*(own.field(x) for x in ("key", "id", "times", "hot")), pa.array(data, pa.binary())], names=["key", "id", "times", "hot", "data"])

    return run


def repeated_starts(data: list[bytes], times: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each of some different pieces the starts whose strings occur elsewhere among them, or whose piece occurs more than once."""
    sizes = np.array([len(d) + 1 for d in data])
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(bytes([SEPARATOR]).join(data) + bytes([SEPARATOR, SEPARATOR - 1]), np.uint8)
    text = raw.astype(np.int16) + 1
    text[-1] = 0
    sa = suffix_array(text, 257)
    value = permuted_lcp(raw, sa, at[:-1], int(sizes.max()) + length)
    real = np.zeros(len(raw), np.int64)
    for a, d, m in zip(at[:-1], data, times, strict=True):
        real[a : a + len(d) - length + 1] = m
    block = np.cumsum(value[sa] < length)
    total = np.bincount(block, weights=real[sa].astype(np.float64))
    again = np.zeros(len(raw), bool)
    again[sa] = (total[block] > 1) & (real[sa] > 0)
    return [np.flatnonzero(again[a : a + len(d) - length + 1]) for a, d in zip(at[:-1], data, strict=True)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive numbers: (first, last)."""
    if not len(starts):
        return starts, starts
    new = np.concatenate([[True], np.diff(starts) > 1])
    return starts[new], starts[np.concatenate([new[1:], [True]])]


def _shards(length: int, shard: int):
    """Different pieces sorted by key to the runs of repeated starts in each: (key, id, first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out: list[tuple] = []
            for (key, name, times, data), starts in zip(held, repeated_starts([h[3] for h in held], [h[2] for h in held], length), strict=True):
                out += [(key, name, int(a), int(b)) for a, b in zip(*_runs(starts), strict=True)]
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["key", "id", "first", "last"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "times", "data")), strict=True):
                if size > shard and held[-1][0] != row[0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    return run


def _strings(length: int):
    """Pieces of hot keys to the digests of their strings: (h, key, id, at, times). 128 bits of BLAKE2b stand for the bytes, as in `_name`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, name, times, data in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "times", "data")), strict=True):
                m = len(data) - length + 1
                digests = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(m)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([key] * m, pa.int64()), pa.array([name] * m, pa.binary()), pa.array(np.arange(m, dtype=np.int32)), pa.array([times] * m, pa.int64())],
                    names=["h", "key", "id", "at", "times"],
                )

    return run


def _remove(length: int):
    """Documents with the runs of repeated starts to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                text = (batch.column("text")[row].as_py() or "").encode()
                runs = batch.column("runs")[row].as_py() or []
                spans: list[list[int]] = []
                for r in sorted((r["a"], r["b"]) for r in runs):
                    a, b = r[0], r[1] + length
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [x for s in spans for x in s]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), *[pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]], names=["k1", *names])

    return run


def dedup(spark: SparkSession, docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, shard: int = SHARD, most: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (ends of the removed runs, in bytes): one row per input row."""
    scratch = Scratch(spark, "suffix")
    rows = docs.select(*row_key(doc=doc, text=text), F.col(text).alias("text"))
    listed = scratch.save(rows.mapInArrow(_list(length, anchor, most), "k1 long, k2 long, start long, count int, key long"), "pieces")
    # counts are written before they are joined: a join of two plain exchanges can be split where a key is hot
    often = scratch.save(listed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "often")
    again = scratch.save(listed.join(often, "key").select("k1", "k2", "start", "count", "key"), "again")
    scratch.drop("pieces")
    own = again.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "count", "key")).alias("own"))
    found = scratch.save(rows.join(own, ["k1", "k2"]).select("k1", "k2", "text", "own"), "found")
    scratch.drop("again")
    placed = scratch.save(found.mapInArrow(_name(length), "k1 long, k2 long, start long, count int, key long, id binary"), "placed")
    kinds = placed.groupBy("key", "id", "count").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "start")).alias("at"))
    kinds = scratch.save(kinds, "same")
    ways = scratch.save(kinds.groupBy("key").agg(F.count("*").alias("ways")), "ways")
    kinds = scratch.save(kinds.join(ways, "key"), "kinds")
    read = F.struct("at.start", "count", "key", "id", "times", (F.col("ways") > hot).alias("hot"))
    wanted = kinds.where("ways > 1").select("at.k1", "at.k2", read.alias("piece")).groupBy("k1", "k2").agg(F.collect_list("piece").alias("own"))
    cut = found.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "own")
    unlike = scratch.save(cut.mapInArrow(_cut_out(length), "key long, id binary, times long, hot boolean, data binary"), "unlike")
    alone = kinds.where("ways = 1 and times > 1").select("key", "id", F.lit(0).alias("first"), (F.col("count") - 1).alias("last"))
    dealt = unlike.where("not hot").select("key", "id", "times", "data").repartition("key").sortWithinPartitions("key")
    marked = alone.unionByName(dealt.mapInArrow(_shards(length, shard), "key long, id binary, first int, last int"))
    strings = unlike.where("hot").select("key", "id", "times", "data").mapInArrow(_strings(length), "h binary, key long, id binary, at int, times long")
    twice = scratch.save(strings.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h"), "twice")
    marked = marked.unionByName(strings.join(twice, "h").select("key", "id", F.col("at").alias("first"), F.col("at").alias("last")))
    marked = scratch.save(marked, "marked")
    runs = placed.join(marked, ["key", "id"]).select("k1", "k2", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last")).alias("b"))
    runs = runs.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    changed = found.select("k1", "k2", "text").join(runs, ["k1", "k2"]).mapInArrow(_remove(length), "k1 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    whole = docs.select(*row_key(doc=doc, text=text), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    same = whole.join(runs.select("k1", "k2"), ["k1", "k2"], "left_anti")
    same = same.select("k1", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.array().cast("array<long>").alias("spans"))
    return changed.unionByName(same).select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
