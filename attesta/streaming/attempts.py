"""New attempts as a stream: each micro-batch adds its attempts and classifies the sections it touched, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.loop import classify

ATTEMPT = "section_id string, attempt int, errors long, findings long, invalid boolean"
#: Attempts are kept in so many parts by section, so that a batch reads the parts of its sections only.
PARTS = 64


def attempt_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ATTEMPT).json(path)


def classify_stream(attempts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps (section, attempt) once, and writes the statuses of the sections of each batch to a folder of that batch.

    A batch that is run again replaces what it wrote. Attempts are bounded per section, so no watermark is needed.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark, store = df.sparkSession, f"{out}/attempts"
        part = F.pmod(F.xxhash64("section_id"), F.lit(PARTS)).cast("int").alias("part")
        df.dropDuplicates(["section_id", "attempt"]).select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={number}")
        kept = spark.read.schema(f"{ATTEMPT}, batch long, part int").parquet(store)
        touched = kept.where(F.col("batch") == number).select("section_id", "part").distinct()
        parts = [r["part"] for r in touched.select("part").distinct().collect()]  # at most PARTS
        seen = kept.where(F.col("part").isin(parts)).join(touched.select("section_id"), "section_id", "left_semi")
        classify(seen.select("section_id", "attempt", "errors", "findings", "invalid").dropDuplicates(["section_id", "attempt"])).write.mode("overwrite").parquet(f"{out}/status/batch={number}")

    return attempts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status(spark: SparkSession, out: str) -> DataFrame:
    """The status of each section by the last batch that touched it."""
    rows = spark.read.parquet(f"{out}/status")
    rest = [c for c in rows.columns if c not in ("section_id", "batch")]
    return rows.groupBy("section_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("section_id", "r.*")
