"""Tables of 32-bit integers in fixed pages, as a Spark data source named ``pages``.

A page has 4096 bytes: two big-endian 32-bit integers, the columns of a row and the rows in the page, then the
rows one after another, and zeros.  Rows do not cross pages.  A page without rows ends a file.  A table is a file,
or a folder of such files, which are read in the order of their names; a writing task makes one file, named by
its place, so that a sorted DataFrame stays in order.  The folder must be one that all executors see.

Columns that a query does not name are not decoded, filters are applied to whole pages at once, and a reader can be
told which pages to read; the names ``_file`` and ``_page`` in a schema are the places of the rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from conjunx.shipping import ship

PAGE = 4096
HEAD = 8
#: Pages that are decoded together.
TOGETHER = 256
#: Columns that are not in the pages: where a row is.
FILE, NUMBER = "_file", "_page"
_COMPARED = {D.EqualTo: np.equal, D.GreaterThan: np.greater, D.GreaterThanOrEqual: np.greater_equal, D.LessThan: np.less, D.LessThanOrEqual: np.less_equal}


def capacity(columns: int) -> int:
    """Rows in a page."""
    return (PAGE - HEAD) // (4 * columns)


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _files(path: str) -> list[str]:
    path = _local(path)
    if os.path.isdir(path):
        return [f"{path}/{x}" for x in sorted(os.listdir(path)) if not x.startswith((".", "_"))]
    return [path]


def decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The rows of some pages, up to the first page that has none, and the place of each row's page."""
    words = np.frombuffer(raw.ljust(-(-len(raw) // PAGE) * PAGE, b"\0"), ">i4").reshape(-1, PAGE // 4)
    end = np.flatnonzero(words[:, 1] <= 0)
    words = words[: end[0]] if len(end) else words
    if not len(words):
        return np.empty((0, 0), np.int32), np.empty(0, np.int64)
    columns = int(words[0, 0])
    if (words[:, 0] != columns).any() or not 0 < columns <= PAGE // 4 - 2 or (words[:, 1] > capacity(columns)).any():
        raise ValueError("not a table of pages")
    rows = words[:, 2 : 2 + capacity(columns) * columns].reshape(len(words), capacity(columns), columns)
    there = np.arange(capacity(columns)) < words[:, 1, None]
    return rows[there].astype(np.int32), np.nonzero(there)[0]


def encode(rows: np.ndarray) -> bytes:
    """Rows as pages, all full but the last."""
    n, columns = rows.shape
    most = capacity(columns)
    out = np.zeros((-(-n // most), PAGE // 4), ">i4")
    out[:, 0], out[:, 1] = columns, most
    if n % most:
        out[-1, 1] = n % most
    whole = n // most
    out[:whole, 2 : 2 + most * columns] = rows[: whole * most].reshape(whole, most * columns)
    if n % most:
        out[-1, 2 : 2 + n % most * columns] = rows[whole * most :].ravel()
    return out.tobytes()


@dataclass
class _Pages(InputPartition):
    file: str
    first: int
    count: int


class _Reader(DataSourceReader):
    """``names``: the columns of the pages, if the schema need not have all; ``only``: pages by file, if not all."""

    def __init__(self, schema: T.StructType, path: str, pages: int, names: list[str] | None, only: dict[str, list[int]] | None):
        self.schema, self.path, self.pages, self.only = schema, path, pages, only
        own = [f.name for f in schema if f.name not in (FILE, NUMBER)]
        self.names = names or own
        if missing := set(own).difference(self.names):
            raise ValueError(f"no columns {sorted(missing)} in these pages")
        self.filters: list[tuple[str, type, int]] = []

    def pushFilters(self, filters):
        """Comparisons of a column with a number are applied here, others are given back."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (*_COMPARED, D.IsNotNull)) and len(f.attribute) == 1 else None
            if column in self.names and type(f) in _COMPARED and type(f.value) is int:
                self.filters.append((column, type(f), f.value))
            elif not (column in self.names and isinstance(f, D.IsNotNull)):  # pages have no nulls
                yield f

    def partitions(self):
        out = []
        for f in _files(self.path):
            n = -(-os.path.getsize(f) // PAGE)
            if self.only is None:
                out += [_Pages(f, k, min(self.pages, n - k)) for k in range(0, n, self.pages)]
                continue
            runs: list[list[int]] = []  # of pages next to each other
            for k in sorted(set(self.only.get(f, ()))):
                if runs and k == sum(runs[-1]) and runs[-1][1] < self.pages:
                    runs[-1][1] += 1
                elif k < n:
                    runs.append([k, 1])
            out += [_Pages(f, *run) for run in runs]
        return out or [_Pages("", 0, 0)]

    def read(self, partition: _Pages):
        kinds = pa.schema([(f.name, pa.string() if f.name == FILE else pa.int32()) for f in self.schema])
        if not partition.count:
            return
        place = {x: k for k, x in enumerate(self.names)}
        with open(partition.file, "rb") as f:
            f.seek(partition.first * PAGE)
            for first in range(0, partition.count, TOGETHER):
                n = min(TOGETHER, partition.count - first)
                rows, page = decode(f.read(n * PAGE))
                if not len(rows):
                    return
                if rows.shape[1] != len(self.names):
                    raise ValueError(f"{partition.file}: pages have {rows.shape[1]} columns, the schema has {len(self.names)}")
                for column, kind, value in self.filters:
                    keep = _COMPARED[kind](rows[:, place[column]].astype(np.int64), value)
                    rows, page = rows[keep], page[keep]
                made = {FILE: lambda: pa.repeat(partition.file, len(rows)), NUMBER: lambda: pa.array(page + partition.first + first, pa.int32())}  # noqa: B023
                yield pa.RecordBatch.from_arrays([made[c]() if c in made else pa.array(rows[:, place[c]]) for c in kinds.names], schema=kinds)


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, columns: int, overwrite: bool):
        self.path, self.columns, self.overwrite, self.job = _local(path), columns, overwrite, uuid.uuid4().hex[:8]
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        place, attempt = context.partitionId(), context.taskAttemptId()
        temporary = f"{self.path}/_part-{self.job}-{place:06d}-{attempt}"
        most, held = capacity(self.columns), np.empty((0, self.columns), np.int32)
        with open(temporary, "wb") as f:
            for batch in iterator:
                if any(c.null_count for c in batch.columns):
                    raise ValueError("pages hold no nulls")
                rows = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)))
                whole = len(rows) // most * most
                f.write(encode(rows[:whole]))
                held = rows[whole:]
            f.write(encode(held))
        return _Written(temporary, f"{self.path}/part-{place:06d}-{self.job}")

    def commit(self, messages):
        old = [f for f in _files(self.path) if self.overwrite]
        for m in messages:
            os.replace(m.temporary, m.final)
        for f in old:
            os.remove(f)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class PagedSource(DataSource):
    """Options: ``path``; ``pagesPerTask`` (4096); ``columns``, the names of the pages' columns, so that a schema can
    have some of them; ``only``, the pages to read, by file, as JSON.  Without a schema or names, columns are c0, c1, ..."""

    @classmethod
    def name(cls):
        return "pages"

    def _names(self) -> list[str] | None:
        return self.options["columns"].split(",") if self.options.get("columns") else None

    def schema(self):
        names = self._names()
        for f in _files(self.options["path"]) if not names else ():
            if os.path.getsize(f):
                with open(f, "rb") as x:
                    n, _ = struct.unpack(">ii", x.read(HEAD))
                names = [f"c{k}" for k in range(n)]
                break
        if not names:
            raise ValueError("an empty table of pages needs a schema")
        return T.StructType([T.StructField(c, T.IntegerType()) for c in names])

    def reader(self, schema):
        if any(not isinstance(f.dataType, T.IntegerType) for f in schema if f.name != FILE):
            raise ValueError("pages hold 32-bit integers only")
        only = self.options.get("only")
        return _Reader(schema, self.options["path"], int(self.options.get("pagesPerTask", 4096)), self._names(), json.loads(only) if only is not None else None)

    def writer(self, schema, overwrite):
        if not len(schema) or any(not isinstance(f.dataType, T.IntegerType) for f in schema):
            raise ValueError("pages hold 32-bit integers only")
        return _Writer(self.options["path"], len(schema), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and its executors, and lets filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
