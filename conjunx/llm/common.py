"""What several operators share: column handling, checkpoints, words, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conjunx.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Where none is configured: a temporary one if the driver runs all tasks
    itself, else an error, since executors would not see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut at files in the shared folder: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder wherever Spark can, in shared folders too."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a frame that ``cut`` made, once nothing will read it again."""
    plan = df._jdf.queryExecution().logical()
    if plan.nodeName().endswith("RDD") and (at := plan.rdd().getCheckpointFile()).isDefined():
        discard(df.sparkSession, at.get())


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that other columns can neither clash nor be carried."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


#: Rows and bytes that go to a worker at once, and back: settings of the session, so that a task holds little besides its rows.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def trimmed() -> None:
    """Gives a worker's free memory back to the system: workers stay for other tasks, and beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, with this package on the workers and small batches; a task ends with ``trimmed``."""

    def then_trimmed(batches):
        yield from run(batches)
        trimmed()

    spark = df.sparkSession
    ship(spark)
    for k, v in BATCHES.items():
        if spark.conf.get(k) != v:
            spark.conf.set(k, v)
    return df.mapInArrow(then_trimmed, schema)


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Of each row the bytes of its texts and the rough size of its lists."""
    out = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            n = pc.binary_length(column)
        elif pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            n = pc.multiply(pc.list_value_length(column), 8)
        else:
            continue
        out += pc.fill_null(n, 0).to_numpy(zero_copy_only=False)
    return out


def small(batches, rows: int = 2000, size: int = 8_000_000):
    """The same rows in batches of at most ``rows`` rows and about ``size`` bytes (one row where that has more), so
    that a worker turns little into Python objects at once."""
    for batch in batches:
        ends = np.cumsum(_bytes(batch))
        k = 0
        while k < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, side="right"))
            stop = min(k + rows, max(k + 1, full))
            yield batch.slice(k, stop - k)
            k = stop


def pieces(text: str, size: int):
    """(offset, piece): a text in pieces of about ``size`` characters, each cut after white space, longer where there is none."""
    at = 0
    while len(text) - at > size:
        cut_at = max(text.rfind(c, at, at + size) for c in " \n") + 1
        if cut_at <= at:
            ends = [k for c in " \n" if (k := text.find(c, at + size)) >= 0]
            cut_at = min(ends) + 1 if ends else len(text)
        yield at, text[at:cut_at]
        at = cut_at
    if at < len(text) or not text:
        yield at, text[at:]


def id_bucket(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod``: the split of rows that contracts name."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def session_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
