"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. One scan gives every row's set size and a hash of its set (rows of equal sets are one class), and adds the row's
   shingles to a table of 2**22 counters (16 MB, whatever the corpus), summed over the corpus: how often a shingle's counter was hit orders shingles
   from rare to frequent (ties by hash).
2. A second scan emits each class's prefix, the floor(0.2 n) + 1 rarest shingles. Two classes that link share one.
   Rows of shingles that only one class has are dropped; counters far above the mean one show a very frequent shingle and salt
   its rows. (The mean grows with the corpus: what counts is the excess.)
3. Rows of a shingle's bucket that pass the length and positional filters connect their classes. Buckets of up to `SMALL`
   classes give the passing pairs; pairs that share fewer prefix shingles than a link needs go, and the suffix filter thins the
   others (the sets' histograms over 64 ranges of the hash,
   whose distance bounds the symmetric difference from below); larger buckets give a spanning forest of them, never all
   pairs, and buckets of more than `BLOCK` classes do so block by block. The components are clusters: every two classes
   that link are in one cluster.
4. Only clusters' texts are fetched. In a cluster each two classes meet in one block, and their sets are intersected once
   at most: not if size or histogram forbid a link, and not if links already connect them. Clusters of more than `BLOCK`
   classes first meet a pivot each (a star), so that what the star connects needn't meet again.
5. Components of the links by alternating stars.

Texts without words (or null) have empty sets and link with nothing; fewer than five words make one shingle. Repeated rows
are equal sets and link. A null id takes no part in the smallest id; a component of null ids only has a null id. Extra
columns are ignored. An empty table gives an empty result. Sets are identified by a 64-bit hash of their content and size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import NULL_ID, Scratch, row_key
from .components import components

COUNTERS = 1 << 22
SLOTS = 64
CELLS = 64
#: A counter above the mean by this much, or by `HOT_MEANS` means where that is more, belongs to a very frequent shingle.
HOT = 50_000
HOT_MEANS = 4
BLOCK = 2048
SMALL = 16


def least_overlap(n: int) -> int:
    """The fewest shingles that a set of n shares with any set it links with: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def prefix_length(n: int) -> int:
    return n - least_overlap(n) + 1 if n else 0


def histogram(values: np.ndarray) -> bytes:
    return np.minimum(np.bincount((values >> np.uint64(58)).astype(np.int64), minlength=CELLS), 65535).astype("<u2").tobytes()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a document's k1, k2, n, class, histogram; of kind 1: a slot of this partition's counters."""
    total = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        n, cls, sig = [], [], []
        for _, _, raw, offs in K.each_chunk(batch.column("text")):
            hits = []
            for _, values in K.sets(raw, offs):
                n.append(len(values))
                cls.append(np.uint64(K.hold(values)).astype(np.int64))
                sig.append(histogram(values))
                hits.append((values & np.uint64(COUNTERS - 1)).astype(np.int64))
            at, times = np.unique(np.concatenate(hits), return_counts=True)
            total[at] += times.astype(np.uint32)
        m = len(n)
        yield _rows(batch.column("k1"), batch.column("k2"), n, cls, sig, np.zeros(m, np.int8))
    # as narrow as the largest number allows: a task's counters are small
    width = COUNTERS // SLOTS
    kind = np.min_scalar_type(int(total.max()))
    blobs = [part.astype(kind).tobytes() for part in total.reshape(SLOTS, width)]
    zero = np.zeros(SLOTS, np.int64)
    yield _rows(pa.array(zero), pa.array(zero), np.arange(SLOTS), zero, blobs, np.ones(SLOTS, np.int8))


def _rows(k1, k2, n, cls, sig, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [k1, k2, pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary()), pa.array(kind, pa.int8())],
        names=["k1", "k2", "n", "c", "sig", "kind"],
    )


def _add_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, blob in zip(batch.column("n").to_pylist(), batch.column("sig").to_pylist(), strict=True):
            part = np.frombuffer(blob, f"u{len(blob) * SLOTS // COUNTERS}").astype(np.uint64)
            held[slot] = held[slot] + part if slot in held else part
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in held.values()], pa.binary())], names=["n", "sig"])


def counters(described: DataFrame, parts: int = 16) -> np.ndarray:
    """The corpus counters: 2**22 numbers (16 MB) whatever the corpus; they end at 2**32 - 1."""
    slots = described.where("kind = 1").select("n", "sig").repartition(parts, "n")
    out = np.zeros(COUNTERS, np.uint32)
    width = COUNTERS // SLOTS
    for row in slots.mapInArrow(K.lean(_add_slots), "n int, sig binary").collect():
        out[row["n"] * width : (row["n"] + 1) * width] = np.frombuffer(row["sig"], np.uint32)
    return out


def _prefixes(shared, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        above, step = int(count.mean()), max(hot, HOT_MEANS * int(count.mean()))
        seen: set[int] = set()
        for batch in batches:
            for _, _, raw, offs in K.each_chunk(batch.column("text")):
                s, c, n, p, salt = [], [], [], [], []
                for _, values in K.sets(raw, offs):
                    if not len(values) or (cls := K.hold(values)) in seen:
                        continue
                    seen.add(cls)
                    often = count[(values & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.int64)
                    first = np.lexsort((values, often))[: prefix_length(len(values))]
                    s.append(values[first])
                    m = len(first)
                    c.append(np.full(m, cls, np.uint64))
                    n.append(np.full(m, len(values), np.int32))
                    p.append(np.arange(m, dtype=np.int32))
                    ways = np.maximum(often[first] - above, 0) // step
                    salt.append(np.where(ways > 0, 1 + (np.uint64(cls) % (ways + 1).astype(np.uint64)).astype(np.int64), 0))
                if s:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in ([v.view(np.int64) for v in s], [v.view(np.int64) for v in c], n, p)] + [pa.array(np.concatenate(salt).astype(np.int32))],
                        names=["s", "c", "n", "p", "salt"],
                    )

    return run


def _spans(column: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    new = np.ones(len(column), bool)
    new[1:] = column[1:] != column[:-1]
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _passes(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The length and positional filters of rows (set size, place in the prefix) that share a shingle.

    What precedes it in both, it, and what follows it in both must still make the least overlap, ceil(4/9 (n + m)).
    """
    ok = 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
    return ok & (9 * (1 + np.minimum(n - p - 1, m - q - 1) + np.minimum(p, q)) >= 4 * (n + m))


def _spanning(c: np.ndarray, n: np.ndarray, p: np.ndarray, from_: np.ndarray, to: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the passing pairs of rows `from_` x `to` (places in the columns) of one bucket."""
    tree = np.arange(len(c))
    out = []
    for x in from_:
        y = to[(tree[to] != tree[x]) & _passes(n[to], p[to], n[x], p[x])]
        if len(y):
            trees, at = np.unique(tree[y], return_index=True)
            out += [(int(c[x]), int(z)) for z in c[y[at]]]
            tree[np.isin(tree, trees)] = tree[x]
    return out


#: What leaves a bucket: a pair to be filtered (n: shingles it was met by), an edge of a forest, a row of a bucket that is too
#: large for one task, the number (n) of a class's rows in buckets that don't give pairs.
PAIR, EDGE, ROW, BUSY = 0, 1, 2, 3
BUCKETS = "kind byte, a long, b long, s long, n int, p int"


def _bucket_rows(kind: int, a, b, s=None, n=None, p=None) -> pa.RecordBatch:
    a = np.asarray(a, np.int64)
    zero = np.zeros(len(a), np.int64)
    cols = [np.full(len(a), kind, np.int8), a, np.asarray(b, np.int64), zero if s is None else s, (zero if n is None else n).astype(np.int32), (zero if p is None else p).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kind", "a", "b", "s", "n", "p"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s, salt, n, c, p) sorted by these to pairs, forest edges, and the rows of salted or very large buckets.

    A stream: at most `BLOCK` rows of the last bucket are held. A class's repeats from other partitions of the scan are dropped.
    """
    names = ("s", "salt", "n", "c", "p")
    held = [np.zeros(0, np.int64)] * 5
    large = None  # the key of a bucket that went over BLOCK
    for batch in _then_none(batches):
        if batch is not None:
            now = [batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]
            s, salt, n, c, p = (np.concatenate([h, x]) for h, x in zip(held, now, strict=True))
        else:
            s, salt, n, c, p = held
        if not len(s):
            continue
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (salt[1:] != salt[:-1]) | (c[1:] != c[:-1])
        s, salt, n, c, p = s[keep], salt[keep], n[keep], c[keep], p[keep]
        out = salt > 0
        if large is not None:
            out |= (s == large[0]) & (salt == large[1])
        starts = _spans(s, salt)
        tail = starts[-1]
        if batch is not None:
            if out[tail] or len(s) - tail > BLOCK:
                large = (s[tail], salt[tail])
                out[tail:] = True
                cut = len(s) - 1  # the last row waits, so that its repeats in the next batch are seen
            else:
                cut = tail
            held = [x[cut:] for x in (s, salt, n, c, p)]
        else:
            cut = len(s)
        s, salt, n, c, p, out = (x[:cut] for x in (s, salt, n, c, p, out))
        if out.any():
            yield _bucket_rows(ROW, c[out], c[out], s[out], n[out], p[out])
            yield _busy(c[out])
        s, n, c, p = s[~out], n[~out], c[~out], p[~out]
        if not len(s):
            continue
        starts = _spans(s)
        size = np.diff(starts, append=len(s))
        mine = np.repeat(size, size)
        small = np.flatnonzero((mine > 1) & (mine <= SMALL))
        found_a, found_b = [], []
        for d in range(1, SMALL):
            small = small[small + d < len(s)]
            small = small[s[small] == s[small + d]]
            if not len(small):
                break
            ok = small[_passes(n[small], p[small], n[small + d], p[small + d])]
            found_a.append(np.minimum(c[ok], c[ok + d]))
            found_b.append(np.maximum(c[ok], c[ok + d]))
        if found_a and sum(map(len, found_a)):
            both, times = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=1, return_counts=True)
            yield _bucket_rows(PAIR, both[0], both[1], n=times)
        if (size > SMALL).any():
            yield _busy(c[mine > SMALL])
        edges = []
        for u, m in zip(starts[size > SMALL], size[size > SMALL], strict=True):
            rows = np.arange(m)
            edges += _spanning(c[u : u + m], n[u : u + m], p[u : u + m], rows, rows)
        if edges:
            a, b = np.array(edges).T
            yield _bucket_rows(EDGE, np.minimum(a, b), np.maximum(a, b))


def _busy(c: np.ndarray) -> pa.RecordBatch:
    who, times = np.unique(c, return_counts=True)
    return _bucket_rows(BUSY, who, who, n=times)


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts to those that link."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            left, right = _all_sets(part.column("ta")), _all_sets(part.column("tb"))
            found = [i for i, (x, y) in enumerate(zip(left, right, strict=True)) if _links(x, y)]
            take = pa.array(found, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("a").take(take), part.column("b").take(take)], names=["a", "b"])


def _all_sets(column: pa.Array) -> list[np.ndarray]:
    return [values for _, _, raw, offs in K.each_chunk(column) for _, values in K.sets(raw, offs)]


def _suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose histograms leave room for the least overlap: |x| + |y| - 2 overlap >= distance of the histograms."""
    for batch in batches:
        if not batch.num_rows:
            continue
        na, nb = (batch.column(x).to_numpy().astype(np.int64) for x in ("na", "nb"))
        sa, sb = (np.frombuffer(b"".join(batch.column(x).to_pylist()), "<u2").reshape(-1, CELLS).astype(np.int64) for x in ("sa", "sb"))
        least = -(-4 * (na + nb) // 9)
        ok = np.abs(sa - sb).sum(axis=1) <= na + nb - 2 * least
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], names: tuple[str, ...]) -> Iterator[tuple[tuple, list]]:
    """Runs of rows with equal keys in a sorted stream: (key, Arrow columns)."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(x).to_numpy(zero_copy_only=False) for x in key]
        starts = [*_spans(*keys), batch.num_rows]
        for u, v in zip(starts[:-1], starts[1:], strict=True):
            now = tuple(int(k[u]) for k in keys)
            if held and now != last:
                yield last, [pa.concat_arrays([h.column(x) for h in held]) for x in names]
                held = []
            held.append(batch.slice(u, v - u))
            last = now
    if held:
        yield last, [pa.concat_arrays([h.column(x) for h in held]) for x in names]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of very large buckets (s, i, j) to a spanning forest of each block's passing pairs."""
    for (_, i, j), cols in _groups(batches, ("s", "i", "j"), ("a", "n", "p", "own")):
        c, n, p, own = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in cols)
        edges = _spanning(c, n, p, np.flatnonzero(own == i), np.flatnonzero(own == j))
        if edges:
            a, b = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of clusters (cluster, i, j) with texts to a spanning forest of the links between components."""
    for (_, i, j), cols in _groups(batches, ("cluster", "i", "j"), ("c", "root", "own", "text")):
        c, root, own = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in cols[:3])
        values = _all_sets(cols[3])
        n = np.array([len(v) for v in values])
        cells = np.stack([np.minimum(np.bincount((v >> np.uint64(56)).astype(np.int64), minlength=256), 255) for v in values]).astype(np.int16)
        _, tree = np.unique(root, return_inverse=True)
        out_a, out_b = [], []
        for x in np.flatnonzero(own == i):
            y = np.flatnonzero((tree != tree[x]) & (own == j) & (5 * np.minimum(n, n[x]) >= 4 * np.maximum(n, n[x])))
            if not len(y):
                continue
            room = n[y] + n[x] - 2 * -(-4 * (n[y] + n[x]) // 9)
            apart = np.abs(cells[y] - cells[x]).sum(axis=1)
            y = y[apart <= room]
            for z in y[np.argsort(apart[apart <= room], kind="stable")]:
                if tree[z] != tree[x] and _links(values[x], values[z]):
                    out_a.append(c[x])
                    out_b.append(c[z])
                    tree[tree == tree[z]] = tree[x]
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    """Verification: 100 |x & y| >= 80 |x | y|, for sorted distinct hashes."""
    if not len(x) or not len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


class Join:
    """The steps of one join over (k1, k2, text)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, doc: str = "doc_id", text: str = "text", hot: int = HOT):
        self.spark, self.scratch, self.hot = spark, Scratch(spark, "ngram"), hot
        self.docs = docs.select(*row_key(doc=doc, text=text), F.col(text).alias("text"))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(rows k1, k2, n, c; links a, b of classes, enough of them to connect all that link)."""
        save = self.scratch.save
        described = save(self.docs.mapInArrow(K.lean(_describe), "k1 long, k2 long, n int, c long, sig binary, kind byte"), "described")
        shared = self.spark.sparkContext.broadcast(counters(described))
        rows = described.where("kind = 0").select("k1", "k2", "n", "c")
        self.classes = save(described.where("kind = 0 and n > 0").groupBy("c").agg(F.min(F.struct("k1", "k2")).alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
        prefix = self.docs.mapInArrow(K.lean(_prefixes(shared, self.hot)), "s long, c long, n int, p int, salt int")
        dealt = prefix.repartition("s", "salt").sortWithinPartitions("s", "salt", "n", "c").select("s", "salt", "n", "c", "p")
        met = save(dealt.mapInArrow(K.lean(_buckets), BUCKETS), "buckets")
        clusters = components(save(self._edges(met), "edges"), self.scratch, "cluster-").select(F.col("node").alias("c"), F.col("root").alias("cluster"))
        clusters = save(clusters.unionByName(clusters.select(F.col("cluster").alias("c"), "cluster").distinct()), "clusters")
        wanted = self.classes.join(clusters, "c").select("c", "n", "cluster", F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"))
        texts = save(self.docs.join(wanted, ["k1", "k2"]).select("c", "n", "cluster", "text"), "texts")
        stars = self._stars(texts)
        return rows, save(self._settled(texts, stars), "links")

    def _edges(self, met: DataFrame) -> DataFrame:
        # Two classes that link share so many prefix shingles at least: ceil(4/9 (n + m)) less the shingles after either prefix.
        busy = met.where(f"kind = {BUSY}").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("busy"))
        size = self.classes.select("c", "n").join(busy, "c", "left").select("c", "n", F.coalesce("busy", F.lit(0)).alias("busy"))
        pairs = met.where(f"kind = {PAIR}").groupBy("a", "b").agg(F.sum("n").alias("met"))
        pairs = pairs.join(size.toDF("a", "na", "ba"), "a").join(size.toDF("b", "nb", "bb"), "b")
        pairs = pairs.where("met + least(ba, bb) >= (4 * (na + nb) + 8) div 9 + 1 - (4 * greatest(na, nb) + 4) div 5").select("a", "b", "na", "nb")
        sig = self.classes.select("c", "sig")
        near = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(K.lean(_suffix), "a long, b long")
        rest = met.where(f"kind = {ROW}")
        g = F.ceil(F.col("size") / BLOCK).cast("int")
        rest = rest.join(rest.groupBy("s").agg(F.count("*").alias("size")), "s").withColumn("g", g)
        rest = rest.withColumn("own", F.pmod(F.xxhash64("a"), F.col("g")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        rest = rest.select("s", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "a", "n", "p", "own")
        dealt = rest.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")
        return near.unionByName(met.where(f"kind = {EDGE}").select("a", "b")).unionByName(dealt.mapInArrow(K.lean(_forest), "a long, b long"))

    def _stars(self, texts: DataFrame) -> DataFrame | None:
        """Links of very large clusters' classes with their cluster's least, or None if all clusters are small."""
        large = texts.groupBy("cluster").agg(F.count("*").alias("m"), F.min(F.struct("n", "c")).alias("v")).where(F.col("m") > BLOCK)
        pivots = self.scratch.save(large.select("cluster", "v.c"), "pivots")
        if pivots.isEmpty():
            return None
        tb = texts.join(pivots, ["cluster", "c"], "left_semi").select("cluster", F.col("c").alias("b"), F.col("text").alias("tb"))
        pairs = texts.join(tb, "cluster").where("c <> b").select(F.col("c").alias("a"), "b", F.col("text").alias("ta"), "tb")
        return self.scratch.save(pairs.mapInArrow(K.lean(_similar), "a long, b long"), "stars")

    def _settled(self, texts: DataFrame, stars: DataFrame | None) -> DataFrame:
        """The links of each cluster, from blocks of bounded size; blocks that both hold a cluster's largest part only don't meet."""
        if stars is None:
            rows = texts.withColumn("root", F.col("c"))
        else:
            roots = components(stars, self.scratch, "stars-").select(F.col("node").alias("c"), "root")
            rows = texts.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
        per = rows.groupBy("cluster", "root").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
        per = per.groupBy("cluster").agg(F.max(F.struct("m", "root"))["root"].alias("major"), F.sum("n").alias("n"), F.sum("m").alias("m"), F.max(F.struct("m", "n")).alias("top"))
        blocks = lambda m, n: F.greatest(F.ceil(m / BLOCK), F.ceil(n / (1 << 20)), F.lit(1)).cast("int")
        per = per.select("cluster", "major", blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("gm"), blocks(F.col("top.m"), F.col("top.n")).alias("gt"), F.col("m").alias("size"))
        rows = rows.join(per, "cluster").withColumn("minor", F.col("root") != F.col("major"))
        # a cluster that fits one block is one; else its largest part and the rest have blocks of their own
        one = (F.col("gm") + F.col("gt") <= 2) & (F.col("size") <= BLOCK)
        at = F.when(one, 0).when(F.col("minor"), F.pmod(F.xxhash64("c"), F.col("gm"))).otherwise(F.col("gm") + F.pmod(F.xxhash64("c"), F.col("gt"))).cast("int")
        last = F.when(one, 0).when(F.col("minor"), F.col("gm") + F.col("gt") - 1).otherwise(F.col("gm") - 1)
        rows = rows.withColumn("own", at).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
        dealt = rows.select("cluster", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "c", "root", "own", "text")
        dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        links = dealt.mapInArrow(K.lean(_settle), "a long, b long")
        return links if stars is None else links.unionByName(stars)


def grouped(spark: SparkSession, docs: DataFrame, doc: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(k1, k2, n, component, root): one row per input row; component is the smallest id it reaches, root names its group."""
    join = Join(spark, docs, doc, text, hot)
    rows, linked = join.links()
    roots = components(linked, join.scratch, "final-").select(F.col("node").alias("c"), "root")
    placed = join.scratch.save(rows.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")), "placed")
    # written before it is joined: a join of two plain exchanges can be split where a root is hot
    least = join.scratch.save(placed.where("n > 0").groupBy("root").agg(F.min(F.when(F.col("k1") != NULL_ID, F.col("k1"))).alias("least")), "least")
    out = placed.join(least, "root", "left")
    own = F.when(F.col("k1") != NULL_ID, F.col("k1"))
    return out.select("k1", "k2", F.col("n").cast("long").alias("n"), F.when(F.col("n") > 0, F.col("least")).otherwise(own).alias("component"), "root")


def jaccard_join(spark: SparkSession, docs: DataFrame, doc: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    own = F.when(F.col("k1") != NULL_ID, F.col("k1"))
    return grouped(spark, docs, doc, text, hot).select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
