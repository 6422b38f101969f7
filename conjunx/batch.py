"""Runs a script of queries and writes results, plans and timings, a set of files for each.

The input folder has db/schema.txt (a table and its columns a line), db/data/<table> in pages, optionally
db/index_info.txt (table, then column, clustered 0 or 1, order, repeated) and queries.sql.  For statement N the
output folder gets query{N} (pages, if all columns are integers), query{N}_humanreadable (text),
query{N}_logicalplan and query{N}_physicalplan.  Inputs are never changed: a clustered index is a sorted copy
in the temporary folder, an unclustered one a table there of the pages that have each key.  A statement that fails does not stop the others; all are numbered by place.
"""

from __future__ import annotations

import shutil
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from conjunx.engine import Engine
from conjunx.operators import compiler
from conjunx.plans import explain
from conjunx.plans.dialect import statements
from conjunx.sources import files, paged


@dataclass(frozen=True)
class Outcome:
    number: int
    seconds: float | None
    error: str | None


def read_config(path: str) -> tuple[Path, Path, Path]:
    """Input, output and temporary folder, a line each."""
    lines = [x.strip() for x in Path(path).read_text().splitlines() if x.strip()]
    if len(lines) != 3:
        raise ValueError(f"{path}: three lines expected: input, output, temporary folder")
    return Path(lines[0]), Path(lines[1]), Path(lines[2])


def open_tables(spark: SparkSession, source: Path, temporary: Path) -> Engine:
    """The engine over the tables of an input folder, statistics written to db/stat.txt of the temporary one."""
    paged.register(spark)
    engine = Engine(spark)
    named = [x.split() for x in (source / "db/schema.txt").read_text().splitlines() if x.strip()]
    for table, *columns in named:
        kind = T.StructType([T.StructField(c, T.IntegerType()) for c in columns])
        engine.register(table, str(source / "db/data" / table), format="pages", schema=kind, columns=",".join(columns))
    indexes = source / "db/index_info.txt"
    for table, *rest in (x.split() for x in indexes.read_text().splitlines() if x.strip()) if indexes.exists() else []:
        for column, clustered, _order in zip(rest[::3], rest[1::3], rest[2::3], strict=True):
            (engine.cluster if clustered == "1" else engine.index)(table, column, str(temporary / f"{table}.{column}"))
    (temporary / "db").mkdir(parents=True, exist_ok=True)
    lines = []
    for table, *columns in named:
        s = engine.catalog.stats(table, tuple(columns))
        lines.append(" ".join([table, str(s.rows), *(f"{c},{s.ranges[c][0]},{s.ranges[c][1]}" for c in columns)]))
    (temporary / "db/stat.txt").write_text("\n".join(lines) + "\n")
    return engine


def run_script(engine: Engine, script: str, output: Path) -> list[Outcome]:
    """Runs each statement once; seconds are of writing its results."""
    output.mkdir(parents=True, exist_ok=True)
    done = []
    for number, statement in enumerate(statements(script), 1):
        name = output / f"query{number}"
        try:
            plan = engine.plan(statement)
            Path(f"{name}_logicalplan").write_text(explain.logical(plan.normal))
            df = engine.build(plan)
            Path(f"{name}_physicalplan").write_text(explain.physical(plan, compiler.chosen_joins(df)))
            began = time.perf_counter()
            if all(isinstance(f.dataType, T.IntegerType) for f in df.schema):
                paged.register(engine.spark)
                shutil.rmtree(name, ignore_errors=True)
                df.write.format("pages").mode("append").save(str(name))
                df = engine.spark.read.format("pages").schema(df.schema).load(str(name))  # the text is of what was written
            files.write_text(df, f"{name}_humanreadable")
            done.append(Outcome(number, time.perf_counter() - began, None))
        except Exception as e:  # one statement's failure is its own
            done.append(Outcome(number, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    return done


def run_config(spark: SparkSession, config: str) -> list[Outcome]:
    source, output, temporary = read_config(config)
    return run_script(open_tables(spark, source, temporary), (source / "queries.sql").read_text(), output)
