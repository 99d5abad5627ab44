"""Token counts by a separator scan of flat, unindexed token files.

Writing: each task encodes its texts and appends the ids, each text followed by the end-of-document id, to flat files of
little-endian integers (16 bits where the vocabulary allows) in the shared folder; beside them goes a table of the order
of documents in each file, not their lengths. A file's name is new for each attempt of a task, and only files of attempts
that ended are in the table, so a lost executor leaves at most files that nothing reads.

Counting: files are cut into blocks of fixed size without looking inside. Each block is searched for the separator by one
vectorised comparison. A prefix scan over a file's blocks gives the number of documents that ended before a block and the
place of the last separator before it, which stitches documents that span blocks.

A null or empty text has 0 tokens. Repeated rows are counted one by one; extra columns are ignored. Special tokens'
strings in a text are ordinary text, and a separator that is a token of the vocabulary is refused, so the separator can't come
from a text. An empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, open_file
from .secret_scan import VOCABULARY, load_encoding

SEPARATOR = 50256
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 27


def _write(root: str, path: str, separator: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path)
        if separator <= encoding.max_token_value:
            with contextlib.suppress(KeyError):
                raise ValueError(f"the separator {separator} is the token {encoding.decode_single_token_bytes(separator)!r}")
        kind = np.dtype("<u2" if max(encoding.max_token_value, separator) < 1 << 16 else "<u4")
        out = name = None
        nth = held = 0
        end = np.array([separator], kind).tobytes()
        for batch in batches:
            names, order = [], []
            for text in batch.column("text"):
                if out is None or held > most:
                    if out is not None:
                        out.close()
                    name, nth, held = f"{root}/{uuid.uuid4().hex}.{kind.itemsize * 8}", 0, 0
                    out = open_file(name, "wb")
                ids = np.array(encoding.encode_ordinary(text.as_py() or ""), kind)
                out.write(ids.tobytes() + end)
                names.append(name)
                order.append(nth)
                nth, held = nth + 1, held + len(ids) + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(order, pa.int64())], names=["doc_id", "file", "nth"])
        if out is not None:
            out.close()

    return run


def write(spark: SparkSession, docs: DataFrame, scratch: Scratch, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, separator: int = SEPARATOR, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the token files; returns (doc_id, file, nth): which document is the n-th of which file."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = rows.mapInArrow(_write(scratch.path("tokens"), vocabulary, separator, file_ids), "doc_id long, file string, nth long")
    return scratch.save(order, "order")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """File names to their sizes in ids."""
    for batch in batches:
        sizes = []
        for name in batch.column("file").to_pylist():
            with open_file(name, "rb") as f:
                sizes.append(f.seek(0, 2) * 8 // int(name.rpartition(".")[2]))
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], names=["file", "ids"])


def _search(separator: int, block: int):
    """Blocks (file, block) to the places of separators in each, counted from the file's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for name, nth in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                kind = np.dtype(f"<u{int(name.rpartition('.')[2]) // 8}")
                with open_file(name, "rb") as f:
                    f.seek(nth * block * kind.itemsize)
                    ids = np.frombuffer(f.read(block * kind.itemsize), kind)
                ends.append(np.flatnonzero(ids == separator) + nth * block)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "ends"])

    return run


def count(files: DataFrame, separator: int = SEPARATOR, block: int = BLOCK_IDS) -> DataFrame:
    """(file, nth, n_tokens) of every document of flat token files (file)."""
    sized = files.mapInArrow(_sizes, "file string, ids long")
    blocks = sized.where("ids > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(ids - 1) div {block}"))).alias("block"))
    found = blocks.repartition("file", "block").mapInArrow(_search(separator, block), "file string, block long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.select(
        "file", "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("done"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)).alias("last"),
    )
    length = lambda e, i: F.struct((F.col("done") + i).alias("nth"), (e - F.when(i == 0, F.col("last")).otherwise(F.get("ends", i - 1)) - 1).alias("n_tokens"))
    return placed.select("file", F.inline(F.transform("ends", length)))


def token_counts(spark: SparkSession, docs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens: one row per input row, counted from the files."""
    scratch = Scratch(spark, "tokens")
    order = write(spark, docs, scratch, doc, text, vocabulary)
    counted = scratch.save(count(order.select("file").distinct()), "counted")
    scratch.drop("tokens")
    return order.join(counted, ["file", "nth"]).select("doc_id", "n_tokens")
