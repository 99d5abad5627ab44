"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item of q distinct five-word shingles is found in a document that has at least 80 % of them, wherever they stand in the
document and however long it is. Items are partitioned by size, a power of two each. A partition has one sketch length, that of its
largest size u: u - ceil(0.8 u) + 1 least hash values of an item, of which a document that contains the item can't lack all. So no
contained item escapes. And it has one least document: with fewer shingles than 0.8 times its smallest size a document contains
none of its items, and isn't looked up there. (Banded signatures compared by Jaccard similarity, the usual form of this search,
lose short items in long documents: 50 shingles among 20,000 have a similarity of 0.002.) One scan of the documents looks their
shingles up in the partitions' sketches; a document's set is then compared with the whole set of each item it met, and what
passes is compared once more as word sequences.

Items go to the scan in blocks of at most `block_bytes` of text, so what is broadcast is bounded whatever the benchmark; with
several blocks each one's finds are written and its broadcast destroyed before the next is made. Null or empty texts (on either
side) match nothing; an item of one to four words is one shingle and matches documents of the same one to four words. Repeated
rows are found one by one. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, row_key

FILTER = 1 << 20
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_FOLD = bytes(b + 32 if 65 <= b <= 90 else (0x20 if b in _SPACES else b) for b in range(256))


def word_shingles(text: str | None, size: int = 5) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for the exact comparison."""
    words = (text or "").encode().translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def sketch_length(q: int) -> int:
    """The fewest shingles of an item of q of which a document with 80 % of them can't lack all."""
    return q - -(-4 * q // 5) + 1


class Partition:
    """The items of sizes 2**(b-1) to 2**b - 1: an inverted list of their sketches, and the least document that holds one."""

    def __init__(self, b: int, members: list[tuple[int, np.ndarray]]):
        length = sketch_length((1 << b) - 1)
        lists: dict[int, list[int]] = defaultdict(list)
        for at, values in members:
            for h in values[np.argsort(K.mix(values))][:length]:
                lists[int(h)].append(at)
        self.least = -(-4 * (1 << b - 1) // 5)
        self.keys = np.array(sorted(lists), np.uint64)
        self.items_of = [lists[int(k)] for k in self.keys]
        self.maybe = np.zeros(FILTER, bool)
        self.maybe[(self.keys & np.uint64(FILTER - 1)).astype(np.int64)] = True

    def met(self, hashes: np.ndarray, low: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(row, items) for each shingle that is in a sketch; `low` are the hashes' filter bits."""
        may = self.maybe[low]
        some, at_row = hashes[may], rows[may]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        hit = self.keys[at] == some
        for row, key in zip(at_row[hit].tolist(), at[hit].tolist(), strict=True):
            yield row, self.items_of[key]


class Sketches:
    """Items (id, text) as sets of shingle hashes, and their partitions."""

    def __init__(self, items: list[tuple[int, str]]):
        column = pa.array([t for _, t in items], pa.string())
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.sets = [v for _, _, raw, offs in K.each_chunk(column) for _, v in K.sets(raw, offs)]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for at, values in enumerate(self.sets):
            if len(values):
                by_size[len(values).bit_length()].append((at, values))
        self.partitions = [Partition(b, members) for b, members in sorted(by_size.items())]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = shared.value
        for batch in batches:
            out: list[tuple] = []
            for first, _, raw, offs in K.each_chunk(batch.column("text")):
                hashes, rows, _ = K.shingles(raw, offs)
                low = (hashes & np.uint64(FILTER - 1)).astype(np.int64)
                size = np.bincount(rows, minlength=len(offs) - 1)[rows]  # no fewer than distinct ones
                met: dict[int, set[int]] = defaultdict(set)
                for part in sk.partitions:
                    fits = size >= part.least
                    whole = fits.all()
                    for row, items in part.met(*((hashes, low, rows) if whole else (hashes[fits], low[fits], rows[fits]))):
                        met[row].update(items)
                for row, items in met.items():
                    lo, hi = np.searchsorted(rows, [row, row + 1])
                    own = np.unique(hashes[lo:hi])
                    words = None
                    for i in sorted(items):
                        want = sk.sets[i]
                        here = int((own[np.minimum(np.searchsorted(own, want), len(own) - 1)] == want).sum())
                        if 100 * here < 80 * len(want):
                            continue
                        words = words if words is not None else word_shingles(batch.column("text")[first + row].as_py())
                        exact = word_shingles(sk.texts[i])
                        both = len(exact & words)
                        if 100 * both >= 80 * len(exact):
                            out.append((first + row, sk.ids[i], len(exact), both))
            take = pa.array([o[0] for o in out], pa.int32())
            more = [pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(take), batch.column("k2").take(take), *more], names=["k1", "k2", "item_id", "n_item", "n_both"])

    return run


def contained(
    spark: SparkSession, docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", block_bytes: int = 32 << 20,
) -> DataFrame:
    """(k1, k2, item_id, n_item, n_both): every row of `docs` with every item it contains to 80 % or more."""
    wanted = items.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("t")).where("t is not null")
    size = wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    rows = docs.select(*row_key(doc=doc, text=text), F.col(text).alias("text"))
    scratch = Scratch(spark, "contained")
    found = None
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block).orderBy("id", "t")
        shared = spark.sparkContext.broadcast(Sketches([(r["id"], r["t"]) for r in part.collect()]))
        one = rows.mapInArrow(K.lean(_scan(shared)), "k1 long, k2 long, item_id long, n_item long, n_both long")
        if blocks > 1:
            one = scratch.save(one, f"block{block}")
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    return found


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_both, containment: a row for each document and item found in it."""
    from .common import real_id

    found = contained(spark, docs, items)
    share = F.col("n_both") / F.col("n_item")
    return found.select(real_id().alias("doc_id"), "item_id", F.col("n_item").alias("n_item_shingles"), F.col("n_both").alias("n_shared"), share.alias("containment"))


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, with the columns they have."""
    found = contained(spark, docs, items).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = row_key()
    kept = docs.withColumns({"__k1": k1, "__k2": k2}).join(found, ["__k1", "__k2"], "left_anti")
    return kept.select(*docs.columns)
