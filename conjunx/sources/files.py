"""Other sources and sinks: rows as text, generated rows, clustered copies, indexes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.  Where none is configured: a temporary one if the driver
    runs all tasks itself, else an error."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def write_text(df: DataFrame, path: str) -> None:
    """Comma-separated rows without a header; the files are in the order of the rows."""
    df.write.mode("overwrite").csv(path, header=False)


def read_text(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=False)


def generate(spark: SparkSession, rows: int = 6000, columns: int = 6, below: int = 1000, seed: int = 0) -> DataFrame:
    """``rows`` x ``columns`` integers, uniform in [0, below), the same for the same seed."""
    kind = [F.floor(F.rand(seed * 1000 + k) * below).cast("int").alias(f"c{k}") for k in range(columns)]
    return spark.range(0, rows, 1, max(1, min(rows // 1_000_000, 10_000))).select(*kind)


def cluster(df: DataFrame, key: str, path: str, partitions: int | None = None, bloom: bool = False) -> None:
    """A copy of ``df`` in Parquet, range-partitioned and sorted by ``key``: the least and greatest key of each
    file and row group let a scan with a bound on it skip the rest.  ``bloom`` adds filters for equality."""
    by = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    out = by.sortWithinPartitions(key).write.mode("overwrite")
    if bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{key}", "true")
    out.parquet(path)


def index(df: DataFrame, key: str, places: tuple[str, ...], path: str) -> None:
    """The distinct keys of ``df`` with the ``places`` (columns) that have them, sorted by key: which files or pages a bound on the
    key leaves to be read."""
    cluster(df.select(F.col(f"`{key}`").alias("key"), *places).where("key is not null").distinct(), "key", path)
