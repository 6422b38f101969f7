"""Each relational operator as one DataFrame step.

A scan names its columns ``alias.column``, so that names stay unique through self-joins and nothing else of a table
is read.  Physical choices (join algorithm, spill, shuffle) are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conjunx.functions.predicates import comparison, conjunction
from conjunx.plans.model import Cmp, Col


def of(col: Col) -> Column:
    """A column of the operators' frames."""
    return F.col(f"`{col}`")


def scan(df: DataFrame, alias: str, columns: Iterable[str], conditions: Iterable[Cmp]) -> DataFrame:
    """The rows that pass, with the columns asked for."""
    keep = conjunction(comparison(c, lambda x: F.col(f"`{x.name}`")) for c in conditions)
    rows = df if keep is None else df.where(keep)
    return rows.select(*(F.col(f"`{c}`").alias(f"{alias}.{c}") for c in columns))


def join(left: DataFrame, right: DataFrame, equal: Iterable[tuple[Col, Col]], theta: Iterable[Cmp] = ()) -> DataFrame:
    """Inner join over equalities and further comparisons; a cross product over none."""
    on = conjunction([*(of(a) == of(b) for a, b in equal), *(comparison(c, of) for c in theta)])
    return left.crossJoin(right) if on is None else left.join(right, on, "inner")


def project(df: DataFrame, columns: Iterable[tuple[Col, str]]) -> DataFrame:
    """The columns in their order, under their output names."""
    return df.select(*(of(c).alias(n) for c, n in columns))


def total_order(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Ascending by the keys, then by every other column, so that the order is one."""
    keys = list(dict.fromkeys(keys))
    return df.orderBy(*(F.col(f"`{c}`") for c in [*keys, *(c for c in df.columns if c not in keys)]))


def distinct(df: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Each row once, in total order."""
    return total_order(df.distinct(), keys)
