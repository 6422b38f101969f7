"""Names of tables, where they are, what is known of them, their clustered copies and their indexes."""

from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conjunx.plans.access import PAGE, Access, choose
from conjunx.plans.dialect import DialectError
from conjunx.plans.joinorder import Stats
from conjunx.plans.model import Interval
from conjunx.sources import files, paged

#: Most files or pages that an index may name; of more, the table is scanned.
MOST_PLACES = 100_000

_RANGED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class _Entry:
    format: str | None
    path: str | None
    options: dict[str, str]
    frame: DataFrame | None = None
    schema: T.StructType | None = None
    rows: int | None = None
    ranges: dict[str, tuple] = field(default_factory=dict)
    #: By kind (clustered, unclustered) and column: the path, and what the table was like when it was made.
    layouts: dict[tuple[str, str], tuple[str, tuple | None]] = field(default_factory=dict)


def _width(kind: T.DataType) -> int:
    """Bytes of a value, about."""
    return {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8, "boolean": 1}.get(kind.simpleString(), 20)


class Catalog:
    """Tables by name, case aside.  Statistics are read when a plan first needs them, and kept."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, _Entry] = {}
        self._footers: SparkSession | None = None

    def register(self, name: str, path: str | None = None, *, format: str = "parquet", frame: DataFrame | None = None, schema: T.StructType | None = None, **options: str) -> None:
        """A table at ``path`` in any format that Spark reads, or a DataFrame."""
        if (path is None) == (frame is None):
            raise ValueError("a table is either a path or a DataFrame")
        self._tables[name.lower()] = _Entry(None if frame is not None else format, path, options, frame, schema)

    def names(self) -> list[str]:
        return sorted(self._tables)

    def _entry(self, name: str) -> _Entry:
        if name.lower() not in self._tables:
            raise DialectError(f"no table {name!r}")
        return self._tables[name.lower()]

    def read(self, name: str, access: Access | None = None, columns: Iterable[str] = ()) -> DataFrame:
        """The table, or what of it ``access`` leaves to be read: at least the rows within its bound.  Tables of pages are read with the
        ``columns`` only; other formats know them by themselves.  An index is asked at once for its places."""
        e = self._entry(name)
        if access is not None and access.kind == "clustered":
            return self.spark.read.schema(self.schema(name)).parquet(e.layouts["clustered", access.column][0])
        if access is not None and access.kind == "unclustered":
            found = self._places(e, access)
            if found is not None:
                return self._reader(e, columns, found) if found else self.read(name).where(F.lit(False))
        if e.format == "pages" and columns:
            return self._reader(e, columns)
        if e.frame is None:
            e.frame = self._reader(e)
        return e.frame

    def _reader(self, e: _Entry, columns: Iterable[str] = (), places: list[tuple] | None = None) -> DataFrame:
        reader, path = self.spark.read.format(e.format).options(**e.options), e.path
        if e.schema is not None:
            wanted = [f for f in e.schema if f.name in set(columns)] if e.format == "pages" and columns else e.schema.fields
            reader = reader.schema(T.StructType(wanted or e.schema.fields[:1]))
        if places is not None and e.format == "pages":
            by: dict[str, list[int]] = {}
            for f, page in places:
                by.setdefault(f, []).append(page)
            reader = reader.option("only", json.dumps(by))
        elif places is not None:
            reader, path = reader.option("basePath", e.path), [f for (f,) in places]
        return reader.load(path)

    def _places(self, e: _Entry, access: Access) -> list[tuple] | None:
        """The files, or files and pages, that have keys within the bound; None if there are too many."""
        side, key, i = self.spark.read.parquet(e.layouts["unclustered", access.column][0]), F.col("key"), access.interval
        bound: list[Column] = []
        if i.low is not None:
            bound.append(key > i.low if i.low_open else key >= i.low)
        if i.high is not None:
            bound.append(key < i.high if i.high_open else key <= i.high)
        for c in bound:
            side = side.where(c)
        found = side.drop("key").distinct().limit(MOST_PLACES + 1).collect()
        return sorted(map(tuple, found)) if len(found) <= MOST_PLACES else None

    def schema(self, name: str) -> T.StructType:
        e = self._entry(name)
        if e.schema is None:
            e.schema = self.read(name).schema
        return e.schema

    def cluster(self, name: str, column: str, path: str, **options) -> None:
        """Makes a copy of the table at ``path``, sorted by ``column``."""
        files.cluster(self.read(name), column, path, **options)
        self.add_clustered(name, column, path)

    def add_clustered(self, name: str, column: str, path: str) -> None:
        """Tells of a copy of the table, as it is now, at ``path``, sorted by ``column``."""
        self._entry(name).layouts["clustered", column] = path, self._stamp(name)

    def index(self, name: str, column: str, path: str) -> None:
        """Makes an index of ``column`` at ``path``: the files of the table, or its pages, by key."""
        e = self._entry(name)
        if e.format == "pages":
            kind = T.StructType([f for f in self.schema(name) if f.name == column] + [T.StructField(paged.FILE, T.StringType()), T.StructField(paged.NUMBER, T.IntegerType())])
            files.index(self.spark.read.format("pages").options(**e.options).schema(kind).load(e.path), column, (paged.FILE, paged.NUMBER), path)
        elif e.path is None:
            raise ValueError("an index needs a table of files")
        else:
            files.index(self.read(name).select("*", F.col("_metadata.file_path").alias("_file")), column, ("_file",), path)
        e.layouts["unclustered", column] = path, self._stamp(name)

    def _stamp(self, name: str) -> tuple | None:
        """What changes when the files of a table do: their number and a sum over names, times and lengths."""
        e = self._entry(name)
        if e.path is None:
            return None
        listed = self.spark.read.format("binaryFile").load(e.path).select("path", "modificationTime", "length")
        return tuple(listed.agg(F.count("*"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first())

    def layouts(self, name: str) -> list[tuple[str, str]]:
        """Kind and column of the copies and indexes that were made of the table as it is."""
        made = self._entry(name).layouts
        now = self._stamp(name) if made else None
        return [k for k, (_, then) in made.items() if then == now]

    def access(self, name: str, bounds: dict[str, Interval], stats: Stats) -> Access:
        """The cheapest way to the rows within ``bounds``."""
        kinds = {f.name: f.dataType for f in self.schema(name)}
        layouts = {(kind, c): _width(kinds[c]) for kind, c in self.layouts(name) if c in bounds}
        row_bytes, units = sum(map(_width, kinds.values())), 1
        if any(kind == "unclustered" for kind, _ in layouts):
            e = self._entry(name)
            units = max(1, -(-stats.rows * row_bytes // PAGE)) if e.format == "pages" else len(self.read(name).inputFiles())
        return choose(stats, row_bytes, units, bounds, layouts)

    def stats(self, name: str, columns: tuple[str, ...] = ()) -> Stats:
        """Rows, and the least and greatest value of the ``columns`` that have an order."""
        return self.stats_of({name: columns})[name]

    def stats_of(self, wanted: dict[str, tuple[str, ...]]) -> dict[str, Stats]:
        """Statistics of several tables.  What is not known yet is computed, tables side by side; over Parquet in a
        reader that answers from file footers, so that no rows are read."""
        new: dict[str, list[str]] = {}
        for name, columns in wanted.items():
            e, kinds = self._entry(name), {f.name: f.dataType for f in self.schema(name)}
            missing = [c for c in dict.fromkeys(columns) if c not in e.ranges and isinstance(kinds[c], _RANGED)]
            if missing or e.rows is None:
                new[name] = missing
        if new:
            frames = {n: self._measured(self._entry(n), n).agg(F.count("*"), *(f(F.col(f"`{c}`")) for c in cols for f in (F.min, F.max))) for n, cols in new.items()}
            with ThreadPoolExecutor(min(8, len(frames))) as pool:
                rows = dict(zip(frames, pool.map(lambda df: df.first(), frames.values()), strict=True))
            for name, cols in new.items():
                e, row = self._entry(name), rows[name]
                e.rows = row[0]
                e.ranges |= {c: (row[1 + 2 * k], row[2 + 2 * k]) for k, c in enumerate(cols)}
        return {n: Stats(self._entry(n).rows, {c: self._entry(n).ranges[c] for c in columns if c in self._entry(n).ranges}) for n, columns in wanted.items()}

    def _measured(self, e: _Entry, name: str) -> DataFrame:
        """The table; Parquet in a session of its own, whose reader answers from footers, so that the caller's settings stay as they are."""
        if e.format != "parquet":
            return self.read(name)
        if self._footers is None:
            self._footers = self.spark.newSession()
            others = [x for x in self._footers.conf.get("spark.sql.sources.useV1SourceList").split(",") if x != "parquet"]
            self._footers.conf.set("spark.sql.sources.useV1SourceList", ",".join(others))
            self._footers.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        return self._footers.read.schema(self.schema(name)).options(**e.options).parquet(e.path)

    def set_stats(self, name: str, rows: int, ranges: dict[str, tuple]) -> None:
        """Statistics known from elsewhere."""
        e = self._entry(name)
        e.rows, e.ranges = rows, dict(ranges)

    def statistics(self, name: str) -> DataFrame:
        """A row for each column with an order: column, rows, least and greatest value, as text."""
        df = self.read(name)
        cols = [f.name for f in df.schema if isinstance(f.dataType, _RANGED)]
        each = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.min(F.col(f"`{c}`")).cast("string").alias("low"), F.max(F.col(f"`{c}`")).cast("string").alias("high")) for c in cols]
        return df.agg(F.array(*each).alias("all")).select(F.inline("all"))

    def describe(self) -> str:
        """What is known, as text."""
        out = []
        for name in self.names():
            e = self._tables[name]
            out.append(f"{name}: {e.path or 'DataFrame'}" + (f", {e.rows} rows" if e.rows is not None else ""))
            out += [f"  {f.name} {f.dataType.simpleString()}" + (" [{} .. {}]".format(*e.ranges[f.name]) if f.name in e.ranges else "") for f in self.schema(name)]
            out += [f"  {'clustered by' if kind == 'clustered' else 'index of'} {c}: {p}" for (kind, c), (p, _) in e.layouts.items()]
        return "\n".join(out)
