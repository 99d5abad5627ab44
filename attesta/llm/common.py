"""Shared plumbing of the training-data operators: scratch tables, row keys and file access."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: The word separators of every operator here, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
NULL_ID = -(2**63)
#: Bytes of a scratch table after whose writing a local session is asked to drop the shuffle files behind it; others always are.
LARGE = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether the executors are threads of the driver."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only where the session names none is a local one made (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    with contextlib.suppress(Exception):
        if sc._jsc.sc().getCheckpointDir().isDefined():
            return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = "file://" + tempfile.mkdtemp(prefix="attesta-")
    sc.setCheckpointDir(local)
    return local


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        del df
        where, store = self._at(name)
        if not is_local(self.spark) or store.getContentSummary(where).getLength() > LARGE:
            self.release()
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            where, store = self._at(name)
            store.delete(where, True)

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

        After one collection the JVM still holds the plan that ran last (measured: its files stayed until the next job's end).
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()


def row_key(*extra: str, doc: str = "doc_id", text: str = "text") -> list[Column]:
    """(k1, k2): k1 is the id, k2 a hash of the row's text (and further columns).

    Rows that agree in all of these are repeated rows and share a key; a null id has a key of its own.
    """
    parts = [F.col(doc).isNull(), F.col(text).isNull(), F.col(text)]
    for name in extra:
        parts += [F.col(name).isNull(), F.col(name)]
    return [F.coalesce(F.col(doc).cast("long"), F.lit(NULL_ID)).alias("k1"), F.xxhash64(*parts).alias("k2")]


def real_id(name: str = "k1") -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def open_file(uri: str, mode: str):
    """A binary file by URI, on whichever store the shared folder is."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        if "w" in mode:
            os.makedirs(os.path.dirname(parsed.path), exist_ok=True)
        return open(parsed.path, mode)
    from pyarrow import fs

    # Hadoop's names of stores that pyarrow names otherwise
    scheme = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}.get(parsed.scheme, parsed.scheme)
    store, path = fs.FileSystem.from_uri(scheme + uri[len(parsed.scheme) :])
    if "w" in mode:
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)
