"""The corpus pipeline: five stages, each over all documents the one before kept, each written as Parquet and read again.

language ID -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> mixing sources to target weights.
All stages but the last return the columns of documents; the last one adds `copy`. Nulls: documents without an id or
source go through; documents without text or letters are rejected by the first stage. Repeated rows: the third stage
keeps one row of them. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontam, langid, line_dedup, mixing, ngram_join
from attesta.llm.common import Scratch, read, row_key


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network recognises."""
    return langid.known(spark, docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to an earlier line; documents that lose all their lines go."""
    return line_dedup.deduped(spark, docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id (of equal ids, of least hash of the text)."""
    scratch = Scratch(spark, "groups")
    placed = scratch.save(ngram_join.grouped(spark, docs), "placed")
    solo = placed.where("n = 0").select("k1", "k2")
    first = placed.where("n > 0").groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("at"))
    kept = first.select("at.k1", "at.k2").unionByName(solo).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = row_key()
    rows = docs.select(*docs.columns, k1.alias("__k1"), k2.alias("__k2")).join(kept, ["__k1", "__k2"], "left_semi")
    return rows.dropDuplicates(["__k1", "__k2"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.clean(spark, docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, numbered by `copy`."""
    return mixing.mixed(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Stages 1, 3 and 5 train, hash or draw: SQL can't express them. Tests compare the run with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
