"""Language ID: a byte convolutional network, trained here in numpy on labelled texts.

A window of 256 bytes is embedded byte by byte, passed through filters of widths 2, 3 and 4, ReLU and max pooling, and a
softmax. A text is cut into consecutive windows (the last one ends with the text), all of which are scored in batches;
the text's distribution is the windows' mean, weighted by the bytes each adds. For scoring, embedding and filters are
multiplied out into tables by byte pair, so a position costs two look-ups.

The training sample is bounded: of each language at most `PER_LABEL` texts, the `PER_LABEL / PARTS` ids of least hash in each
of `PARTS` parts of the ids, among rows with an id, a text and a label that the caller leaves in. An id counts once, however often
its row is repeated (rows of one id and label give the least of their pieces); of a long text `SLICES` pieces of `SLICE`
characters, evenly spaced, are fetched; up to `PER_TEXT` windows of each text, of mixed lengths, are learned from.

A null text and one without letters are `und` with score 0; so is every text when no label could be learned. Repeated
rows are scored one by one; extra columns are ignored; an empty table gives an empty result. Long texts are scored in blocks
of windows, so that work arrays don't grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernel as K

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
PER_LABEL = 400
PER_TEXT = 6
EPOCHS = 5
PARTS = 25
SLICES, SLICE = 6, 300
BLOCK = 4096
UNKNOWN = "und"
POSITIONS = WINDOW - max(WIDTHS) + 1


class Net:
    """The network's weights, with a training step and table-driven scoring."""

    def __init__(self, n_labels: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.w = [rng.normal(0, 1 / np.sqrt(k * EMBED), (k * EMBED, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), n_labels)).astype(np.float32)
        self.c = np.zeros(n_labels, np.float32)
        self.moments: dict[int, list[np.ndarray]] = {}
        self.t = 0

    def params(self) -> list[np.ndarray]:
        return [self.e, *self.w, *self.b, self.v, self.c]

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One Adam step on windows x (m, 256) of bytes with labels y; returns the loss."""
        m = len(x)
        emb = self.e[x]
        pooled, kept = [], []
        for k, w, b in zip(WIDTHS, self.w, self.b, strict=True):
            cols = np.concatenate([emb[:, j : j + POSITIONS] for j in range(k)], axis=2)
            out = np.maximum(cols @ w + b, 0)
            at = out.argmax(axis=1)
            top = np.take_along_axis(out, at[:, None], 1)[:, 0]
            pooled.append(top)
            kept.append((cols, at, top))
        h = np.concatenate(pooled, axis=1)
        p = _softmax(h @ self.v + self.c)
        loss = float(-np.log(p[np.arange(m), y] + 1e-9).mean())
        d = p
        d[np.arange(m), y] -= 1
        d /= m
        grads_v, grads_c, dh = h.T @ d, d.sum(axis=0), d @ self.v.T
        ge = np.zeros_like(self.e)
        gw, gb = [], []
        row = np.arange(m)[:, None]
        for i, (k, w) in enumerate(zip(WIDTHS, self.w, strict=True)):
            cols, at, top = kept[i]
            g = dh[:, i * FILTERS : (i + 1) * FILTERS] * (top > 0)
            picked = cols[row, at]  # (m, filters, k * embed)
            gw.append(np.einsum("mfc,mf->cf", picked, g))
            gb.append(g.sum(axis=0))
            back = g[:, :, None] * w.T[None]
            for j in range(k):
                np.add.at(ge, x[row, at + j], back[:, :, j * EMBED : (j + 1) * EMBED])
        self.t += 1
        for p_, g_ in zip(self.params(), [ge, *gw, *gb, grads_v, grads_c], strict=True):
            a, s = self.moments.setdefault(id(p_), [np.zeros_like(p_), np.zeros_like(p_)])
            a += 0.1 * (g_ - a)
            s += 0.001 * (g_ * g_ - s)
            p_ -= (rate * (a / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)
        return loss

    def tables(self) -> dict[str, np.ndarray]:
        """Filters by byte pair: `near` for the pair at a position, `far` for the pair two bytes on."""
        part = [[self.e @ w[j * EMBED : (j + 1) * EMBED] for j in range(k)] for k, w in zip(WIDTHS, self.w, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        near = np.concatenate([pair(p[0], p[1]) + b for p, b in zip(part, self.b, strict=True)], axis=1)
        none = np.zeros_like(part[0][0])
        far = np.concatenate([pair(none, none), pair(part[1][2], none), pair(part[2][2], part[2][3])], axis=1)
        return {"near": near.astype(np.float32), "far": far[:, FILTERS:].astype(np.float32).copy(), "v": self.v, "c": self.c}


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def score(tables: dict[str, np.ndarray], x: np.ndarray, batch: int = 256) -> np.ndarray:
    """The label distribution of each window (rows of 256 bytes)."""
    out = np.empty((len(x), len(tables["c"])), np.float32)
    for lo in range(0, len(x), batch):
        part = x[lo : lo + batch].astype(np.uint16)
        pairs = (part[:, :-1] << 8) | part[:, 1:]
        h = tables["near"].take(pairs[:, :POSITIONS], axis=0)
        h[:, :, FILTERS:] += tables["far"].take(pairs[:, 2 : 2 + POSITIONS], axis=0)
        out[lo : lo + batch] = _softmax(np.maximum(h.max(axis=1), 0) @ tables["v"] + tables["c"])
    return out


def windows(raw: np.ndarray, offs: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (windows, row of each, bytes it adds) of rows of text; a row of up to 256 bytes is one window, padded with 0."""
    size = np.diff(offs)
    count = -(-size // WINDOW)
    rows = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    starts = offs[rows] + np.minimum(nth * WINDOW, np.maximum(size[rows] - WINDOW, 0))
    adds = np.minimum(size[rows] - nth * WINDOW, WINDOW)
    for lo in range(0, len(rows), block):
        row = rows[lo : lo + block]
        at = starts[lo : lo + block, None] + np.arange(WINDOW)
        inside = at < offs[row + 1][:, None]
        yield np.where(inside, raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8), row, adds[lo : lo + block]


def train(rows: list[tuple[str, str]], seed: int = 5) -> tuple[list[str], dict[str, np.ndarray]] | None:
    """(labels, tables) from (label, text) rows, or None without rows."""
    labels = sorted({label for label, _ in rows})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    x, y = [], []
    for label, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw):
            continue
        for turn in range(PER_TEXT):
            long = WINDOW if turn < PER_TEXT // 2 else int(rng.integers(4, WINDOW))
            at = int(rng.integers(0, max(len(raw) - long, 0) + 1)) if turn else 0
            piece = raw[at : at + long]
            x.append(np.pad(piece, (0, WINDOW - len(piece))))
            y.append(labels.index(label))
    if not x:
        return None
    x, y = np.stack(x), np.array(y)
    net = Net(len(labels), seed)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            net.step(x[order[lo : lo + 64]], y[order[lo : lo + 64]], 0.01 / (1 + epoch))
    return labels, net.tables()


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            picks, sure = [], []
            letters = batch.column("letters").to_pylist()
            for first, last, raw, offs in K.each_chunk(batch.column("text"), 1 << 20):
                if model is None:
                    picks += [UNKNOWN] * (last - first)
                    sure += [0.0] * (last - first)
                    continue
                labels, tables = model
                total = np.zeros((last - first, len(labels)))
                for x, row, adds in windows(raw, offs):
                    np.add.at(total, row, score(tables, x) * adds[:, None])
                mean = total / np.maximum(np.diff(offs), 1)[:, None]
                best = mean.argmax(axis=1)
                for i in range(last - first):
                    known = letters[first + i]
                    picks.append(labels[best[i]] if known else UNKNOWN)
                    sure.append(float(min(max(mean[i, best[i]], 0.0), 1.0)) if known else 0.0)
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "letters")]
            names = [c for c in batch.schema.names if c not in ("text", "letters")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(picks, pa.string()), pa.array(sure, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def held_out(doc: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out (and not learned from)."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(df: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "lang", most: int = PER_LABEL) -> list[tuple[str, str]]:
    """At most `most` (label, text) rows a label, one for each id chosen; ids are chosen before any text is read."""
    fit = df.where(F.col(doc).isNotNull() & F.col(label).isNotNull() & ~held_out(doc) & (F.length(text) > 0))
    fit = fit.select(F.col(doc).cast("long").alias("id"), F.col(label).alias("label"), F.col(text).alias("t"))
    ids = fit.groupBy("label", "id").agg(F.count("*").alias("n")).select("label", "id", F.xxhash64("id").alias("h"))
    rank = F.row_number().over(W.partitionBy("label", F.pmod("h", F.lit(PARTS))).orderBy("h", "id"))
    ids = ids.withColumn("r", rank).where(F.col("r") <= max(most // PARTS, 1)).select("label", "id")
    apart = F.expr(f"(length(t) - {SLICE}) / {SLICES - 1}")
    slices = F.concat_ws(" ", *[F.substring("t", F.floor(apart * i).cast("int") + 1, F.lit(SLICE)) for i in range(SLICES)])
    piece = F.when(F.length("t") > SLICES * SLICE, slices).otherwise(F.col("t"))
    rows = fit.join(F.broadcast(ids), ["label", "id"]).groupBy("label", "id").agg(F.min(piece).alias("t"))
    return sorted((r["label"], r["t"]) for r in rows.select("label", "t").toLocalIterator())


def predict(spark: SparkSession, df: DataFrame, model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, k2, lang_pred, score: one row per input row."""
    from .common import row_key

    shared = spark.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), row_key(doc=doc, text=text)[1], held_out(doc).alias("held_out"), F.col(text).alias("text"), letters.alias("letters"))
    return rows.mapInArrow(K.lean(_scorer(shared)), "doc_id long, k2 long, held_out boolean, lang_pred string, score double")


def identify(spark: SparkSession, df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, by a network trained on the rows that are not held out."""
    return predict(spark, df, train(sample(df))).select("doc_id", "held_out", "lang_pred", "score")


#: A text whose best language has less than this share is rejected, as one without letters is.
LEAST_SCORE = 0.35


def known(spark: SparkSession, df: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is recognised, with the columns they have."""
    from .common import row_key

    model = train(sample(df))
    shared = spark.sparkContext.broadcast(model)
    if model is None:
        return df.limit(0)
    kept = [c for c in df.columns if c not in ("letters", "lang_pred", "score")]
    clash = {c: f"__{c}" for c in df.columns if c not in kept}
    rows = df.withColumnsRenamed(clash).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return _with_score(rows, shared).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in clash.items()}).select(*df.columns)


def _with_score(rows: DataFrame, shared) -> DataFrame:
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([f for f in rows.schema if f.name != "letters"] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slim = pa.RecordBatch.from_arrays([batch.column("text"), batch.column("letters")], names=["text", "letters"])
            for out in _scorer(shared)(iter([slim])):
                names = [c for c in batch.schema.names if c != "letters"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], out.column("lang_pred"), out.column("score")], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(K.lean(run), schema)
