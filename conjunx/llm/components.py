"""Connected components of a graph of links, by alternating large-star and small-star rounds.

Every round is joins and partial aggregations over the edges; a hub's edges are split by adaptive skew joins.
Rounds end when the edges are stars around each component's smallest node.  Nothing of the graph is collected:
the driver sees a count and a checksum of the edges of each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunx.llm.common import cut, forget


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour (itself included)."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "n")
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """edges: (a, b) with a > b, in longs.  Returns (a, b): each node that has links, but the smallest of its
    component, with that smallest node.  No edges in, no rows out."""
    edges = cut(edges.select("a", "b").distinct())
    seen = _print(edges)
    while seen[0]:
        old, edges = edges, cut(_small_star(_large_star(edges)))
        forget(old)
        if (now := _print(edges)) == seen:
            break
        seen = now
    return edges
