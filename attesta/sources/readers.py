"""Sources and sinks: pages, contracts, sheets, manifests and deterministic outputs."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "number int, text string, sha256 string"
COUNTS = "section_id string, attempt int, items long, grounded long, row_checked long, row_ok long, rows_detected long, samples long, samples_parsed long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, dealt out over the cores: for work on long texts of a small table.

    A larger table stays as it is read, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pages_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).json(path)


def pages_text(spark: SparkSession, path: str) -> DataFrame:
    """Text files whose pages are separated by form feeds: (file, number, text)."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\f")).alias("n", "text")).select("file", (F.col("n") + 1).alias("number"), "text")


def contracts(spark: SparkSession, path: str, sections: list[str] | None = None) -> DataFrame:
    """(section_id, raw) of contract files; the raw text is kept, since a broken file is itself a result."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(S-\d{1,2}\.\d{1,2})\.json$", 1).alias("section_id"), F.col("value").alias("raw"))
    return raw.where(F.col("section_id").isin(sections)) if sections else raw


def in_chapter(rows: DataFrame, chapter: int) -> DataFrame:
    """Rows of the sections of one chapter."""
    return rows.where(F.regexp_extract("section_id", r"^S-(\d+)\.", 1) == str(chapter))


def section_lines(spark: SparkSession, path: str) -> DataFrame:
    """(section_id, ord, page, line) of a file of sections, one JSON object {id, lines: [[page, line]]} a line."""
    rows = spark.read.schema("id string, lines array<array<string>>").json(path)
    rows = rows.select(F.col("id").alias("section_id"), F.posexplode("lines").alias("ord", "x"))
    return rows.select("section_id", "ord", F.col("x")[0].cast("int").alias("page"), F.col("x")[1].alias("line"))


#: Folders of a package that hold no client code.
SKIPPED = ("tests", "test", ".git", ".venv", "venv", "__pycache__", "build")


def python_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, source) of the Python files below a folder, without those of tests and builds; `file` is relative to the folder."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").text(root, wholetext=True)
    name = F.regexp_replace(F.input_file_name(), r"^file:/+", "/")
    file = F.when(name.contains(root), F.substring_index(name, root.rstrip("/") + "/", -1)).otherwise(name)
    rows = raw.select(file.alias("file"), F.col("value").alias("source"))
    folders = F.split("file", "/")
    return rows.where(~F.arrays_overlap(F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*map(F.lit, SKIPPED))))


def optional(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """A table that may not be there: then it is empty, with the same columns."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).format(kind).load(path) if there else spark.createDataFrame([], schema)


def check_pins(rows: DataFrame) -> DataFrame:
    """Sources (id, sha256, commit and more) with `error`: the first pin that is no full hexadecimal hash, null if all are."""
    wrong = lambda name, length: F.when(F.col(name).isNotNull() & ~F.col(name).rlike(rf"^[0-9a-f]{{{length}}}$"), F.lit(f"{name} is no hash of {length} digits"))
    return rows.withColumn("error", F.coalesce(wrong("sha256", 64), wrong("commit", 40)))


def pins(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, url, dest, sha256, commit, error) of a YAML lock file by id."""
    return check_pins(yaml_rows(spark, path, "sources", "id string, kind string, url string, dest string, sha256 string, commit string")).orderBy("id")


def record_of(manifest: DataFrame, artifact: str) -> DataFrame:
    """The manifest's record of an artifact, if it has one."""
    return manifest.where(F.col("artifact") == artifact)


def cached(manifest: DataFrame, artifact: str, producer: str, inputs: list[str], present: str | None) -> bool:
    """Whether the manifest's record of an artifact still holds: same producer and inputs, and the file has the recorded hash."""
    same = (F.col("producer") == producer) & (F.col("inputs") == F.array(*map(F.lit, inputs))) & F.col("sha256").eqNullSafe(F.lit(present))
    return not record_of(manifest, artifact).where(same).isEmpty()


def lineage(contracts: DataFrame) -> DataFrame:
    """(section_id, sha256, stage, tool, mode, prompt_version, attempt) of contract files (section_id, raw); a broken file has a hash only."""
    parsed = F.from_json("raw", "extraction struct<producer:string,mode:string,prompt_version:string,attempt:int>")["extraction"]
    rows = contracts.withColumn("x", parsed)
    return rows.select("section_id", F.sha2(F.col("raw").cast("binary"), 256).alias("sha256"), F.lit("extract").alias("stage"), F.col("x.producer").alias("tool"), "x.mode", "x.prompt_version", "x.attempt")


def mapping_rows(spark: SparkSession, path: str) -> DataFrame:
    """(section_id, model, json_path, file, line) of a (driver-sized) YAML mapping: a list, or {producer, entries}."""
    import yaml

    data = yaml.safe_load(Path(path).read_text())
    entries = (data.get("entries") if isinstance(data, dict) else data) or []
    rows = [(str(e["section_id"]), str(e["model"]), str(e.get("json_path", "data")), str((e.get("code") or {}).get("file", "")), int((e.get("code") or {}).get("line", 0))) for e in entries]
    return spark.createDataFrame(sorted(rows), "section_id string, model string, json_path string, file string, line int")


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet, all columns as strings."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def yaml_rows(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The list under `key` of a (driver-sized) YAML file."""
    import yaml

    return spark.createDataFrame(yaml.safe_load(Path(path).read_text()).get(key) or [], schema)


def xml_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of JUnit files: (classname, name, failed, error)."""
    schema = "_classname string, _name string, failure string, error string"
    rows = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    return rows.select(F.col("_classname").alias("classname"), F.col("_name").alias("name"), F.col("failure").isNotNull().alias("failed"), F.col("error").isNotNull().alias("error"))


def matches_pin(spark: SparkSession, path: str, pin: str) -> bool:
    """Whether a file's content has the pinned hash."""
    rows = spark.read.format("binaryFile").load(path).select((F.sha2("content", 256) == pin).alias("ok")).head(1)
    return bool(rows and rows[0]["ok"])


def write_json(value: object, path: str) -> None:
    """A small result as deterministic JSON, replaced in one step."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    os.replace(temp, path)


def write_once(df: DataFrame, path: str) -> None:
    """A sheet that must not be there yet."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_yaml(value: object, path: str) -> None:
    """A small result as YAML with sorted keys."""
    import yaml

    Path(path).write_text(yaml.safe_dump(value, sort_keys=True, allow_unicode=True), encoding="utf-8")


def write_attempts(results: DataFrame, path: str) -> None:
    """Results partitioned by attempt; a rerun replaces the partitions it writes."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("attempt").parquet(path)


def latest_attempts(spark: SparkSession, path: str) -> DataFrame:
    """The last attempt of each section of what `write_attempts` wrote."""
    from ..operators.loop import latest

    return latest(spark.read.parquet(path))
