"""Sessions: configuration for stand-alone use, and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_shipped: set[str] = set()


def local_session(name: str = "attesta", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution and UTC timestamps."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once a context, so that workers need no installed copy."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="attesta-code-")) / "attesta.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, os.path.join("attesta", path.relative_to(home)))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def literal(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows as a relation in the plan, by Arrow; `createDataFrame` of a list would pass them through Python workers once more."""
    kind = T.StructType.fromDDL(schema)
    own = to_arrow_schema(kind)
    columns = list(zip(*rows, strict=True)) or [()] * len(own)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, own, strict=True)], schema=own), kind)
