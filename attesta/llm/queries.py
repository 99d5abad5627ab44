"""The queries of this subpackage: op1_ to op10_ and the pipeline, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, line_dedup, mixing, ngram_join, quality, secret_scan, suffix_dedup, token_counts, warc
from .common import read


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(spark, read(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, read(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, read(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(spark, read(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spark, read(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1,
        "op2_secret_scan": op2,
        "op3_warc": op3,
        "op4_language_id": op4,
        "op5_benchmark_decontamination": op5,
        "op6_token_counts": op6,
        "op7_ngram_jaccard_join": op7,
        "op8_quality_rules": op8,
        "op9_line_dedup": op9,
        "op10_mixing": op10,
        "pipeline": pipeline,
    }
