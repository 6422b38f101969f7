"""The query catalogue: each query of the engine with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conjunx.engine import Engine
from conjunx.plans.builder import Select, Value
from conjunx.sources import files, paged

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FLAGSHIP = """SELECT l.l_orderkey, l.l_linenumber, c.c_custkey, n.n_name, r.r_name
FROM lineitem l, orders o, customer c, nation n, region r
WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey
  AND n.n_regionkey = r.r_regionkey AND r.r_regionkey = 2 AND l.l_suppkey < 20"""

#: In the dialect, and word for word in SQL.
TEXTS = {
    "scan_star": "SELECT * FROM nation",
    "select_range": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 100 AND o_custkey < 200",
    "select_le_gt": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 100 AND o_custkey <= 200",
    "select_eq": "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey = 7",
    "select_ne": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey <> 3",
    "const_left": "SELECT c_custkey FROM customer WHERE 10 > c_custkey",
    "const_only": "SELECT n_nationkey FROM nation WHERE 1 < 2 AND n_nationkey < 5",
    "negative_literal": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500.5",
    "string_literal": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "timestamp_range": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1995-02-01 00:00:00'",
    "contradiction": "SELECT c_custkey FROM customer WHERE c_custkey > 5 AND c_custkey < 3",
    "eq_after_range": "SELECT c_custkey FROM customer WHERE c_custkey > 5 AND c_custkey = 3",
    "intra_table": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey",
    "intra_eq": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey",
    "tautology": "SELECT c_custkey FROM customer WHERE c_custkey = c_custkey",
    "project_reorder": "SELECT c_nationkey, c_custkey FROM customer",
    "project_alias": "SELECT c.c_custkey AS id, c.c_nationkey AS nation FROM customer AS c",
    "star_of_one": "SELECT n.*, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "star_join": "SELECT * FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_regionkey <> 4",
    "equi_join": "SELECT o.o_orderkey, c.c_custkey, c.c_nationkey FROM orders o, customer c WHERE o.o_custkey = c.c_custkey",
    "composite_equi": "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_partkey = o_custkey",
    "mixed_join": "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_partkey < o_custkey",
    "theta_join": "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_custkey < s_suppkey",
    "cross_product": "SELECT n_nationkey, r_regionkey FROM nation, region",
    "self_join": "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "transitive3": "SELECT s_suppkey, c_custkey, n_nationkey FROM supplier, customer, nation WHERE s_nationkey = c_nationkey AND c_nationkey = n_nationkey AND n_nationkey < 3",
    "unlinked_first": "SELECT s_suppkey, r_regionkey, n_nationkey FROM supplier, region, nation WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    "multiway5": FLAGSHIP,
    "labelled_documents": "SELECT d.doc_id, d.lang, l.toxic FROM documents d, labels l WHERE d.doc_id = l.doc_id AND l.quality = 1",
    "order_by": "SELECT c_nationkey, c_custkey, c_name FROM customer ORDER BY c_nationkey",
    "order_by_two": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_custkey ASC",
    "distinct": "SELECT DISTINCT c_nationkey FROM customer",
    "distinct_multi_order": "SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem ORDER BY l_linenumber",
    "distinct_join_order": "SELECT DISTINCT s.s_suppkey FROM customer c, supplier s WHERE c.c_nationkey = s.s_nationkey ORDER BY s.s_suppkey",
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over the tables of a folder; a table is opened when a query names it."""
    out = Engine(spark)
    for t in TABLES:
        out.register(t, f"{sf_dir}/{t}.parquet")
    return out


def fluent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fluent API."""
    query = Select("o.o_orderkey", segment="c.c_mktsegment").from_("orders", "o").join("customer", "c", ("o.o_custkey", "c.c_custkey"))
    return engine(spark, sf_dir).run(query.where("c.c_mktsegment", "<>", Value("BUILDING")).order_by("o.o_orderkey"))


def clustered_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range scan of a copy sorted by the key."""
    e = engine(spark, sf_dir).cluster("orders", "o_custkey", files.scratch(spark, "clustered"))
    return e.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 300 AND o_custkey <= 400 AND o_orderstatus = 'O'")


def clustered_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equality scan of a copy with bloom filters."""
    e = engine(spark, sf_dir).cluster("lineitem", "l_partkey", files.scratch(spark, "clustered"), bloom=True)
    return e.sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 77")


def clustered_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bound so wide that the table is scanned although a sorted copy is there."""
    e = engine(spark, sf_dir).cluster("orders", "o_custkey", files.scratch(spark, "clustered"))
    return e.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 1")


def unclustered_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equality that an index of the files' keys answers: of many files those are read that have the key."""
    path = files.scratch(spark, "orders")
    engine(spark, sf_dir).catalog.read("orders").repartitionByRange(16, "o_orderdate").write.parquet(path)
    e = Engine(spark).register("orders", path).index("orders", "o_orderkey", files.scratch(spark, "index"))
    return e.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")


def paged_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a filter that the reader applies, columns that it does not decode, and an index of pages."""
    paged.register(spark)
    path = files.scratch(spark, "pages")
    rows = engine(spark, sf_dir).catalog.read("orders").selectExpr("cast(o_custkey as int) a", "cast(o_orderkey as int) b", "cast(o_orderkey % 7 as int) c")
    rows.write.format("pages").mode("append").save(path)
    e = Engine(spark).register("orders", path, format="pages", schema=rows.schema, columns="a,b,c").index("orders", "b", files.scratch(spark, "index"))
    return e.sql("SELECT x.a, y.c FROM orders x, orders y WHERE x.b = 42 AND y.c = 3 AND x.a = y.a")


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logical plan of a query and the physical one of another, a row a line."""
    e = engine(spark, sf_dir).cluster("lineitem", "l_orderkey", files.scratch(spark, "clustered"))
    logical, _ = e.explain("SELECT DISTINCT c.c_custkey FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND n.n_nationkey < 3 ORDER BY c.c_custkey")
    _, physical = e.explain("SELECT l_orderkey FROM lineitem WHERE l_orderkey < 5 AND l_linenumber <> 2")
    return spark.createDataFrame(list(enumerate([*logical.splitlines(), *physical.splitlines()])), "n long, line string")


EXPLAINED = """DupElim
-Sort[c.c_custkey]
--Project[c.c_custkey]
---Join[null]
---[[c.c_nationkey, n.n_nationkey], equals null, min null, max 3]
----Select[c.c_nationkey < 3]
-----Leaf[customer]
----Select[n.n_nationkey < 3]
-----Leaf[nation]
Project[lineitem.l_orderkey]
-Select[lineitem.l_orderkey < 5 AND lineitem.l_linenumber <> 2]
--IndexScan[lineitem,l_orderkey,None,5]""".splitlines()


def catalog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog says of a table, a row a line, but for where it is."""
    e = engine(spark, sf_dir)
    e.catalog.stats("nation", ("n_nationkey",))
    text = e.catalog.describe().splitlines()
    at = next(k for k, x in enumerate(text) if x.startswith("nation:"))
    lines = ["nation: " + text[at].rsplit(", ", 1)[1], *(x.strip() for x in text[at + 1 : at + 4])]
    return spark.createDataFrame(list(enumerate(lines)), "n long, line string")


def paged_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers written to pages and read back."""
    paged.register(spark)
    path = files.scratch(spark, "pages")
    rows = engine(spark, sf_dir).sql("SELECT n_nationkey, n_regionkey FROM nation ORDER BY n_nationkey")
    rows.write.format("pages").mode("append").save(path)
    return spark.read.format("pages").schema(rows.schema).load(path)


def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as text and read back."""
    path = files.scratch(spark, "text")
    rows = engine(spark, sf_dir).sql("SELECT c_custkey, c_nationkey FROM customer")
    files.write_text(rows, path)
    return files.read_text(spark, path, rows.schema)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, least and greatest value of each column with an order."""
    return engine(spark, sf_dir).catalog.statistics("customer")


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random rows: by column their number, whether all are in range, and whether nearly every value occurs."""
    df = files.generate(spark)
    each = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n_rows"), ((F.min(c) >= 0) & (F.max(c) < 1000)).alias("in_range"), (F.count_distinct(F.col(c)) > 950).alias("spread")) for c in df.columns]
    return df.agg(F.array(*each).alias("all")).select(F.inline("all"))


PROGRAMS = {
    "fluent_join": (fluent_join, "SELECT o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'"),
    "clustered_range": (clustered_range, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 300 AND 400 AND o_orderstatus = 'O'"),
    "clustered_equal": (clustered_equal, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 77"),
    "paged_round_trip": (paged_round_trip, "SELECT n_nationkey, n_regionkey FROM nation"),
    "text_round_trip": (text_round_trip, "SELECT c_custkey, c_nationkey FROM customer"),
    "statistics": (
        statistics,
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")),
    ),
    "clustered_wide": (clustered_wide, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 1"),
    "unclustered_equal": (unclustered_equal, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77"),
    "paged_filter": (paged_filter, "SELECT CAST(x.o_custkey AS INTEGER) AS a, CAST(y.o_orderkey % 7 AS INTEGER) AS c FROM orders x, orders y WHERE x.o_orderkey = 42 AND y.o_orderkey % 7 = 3 AND x.o_custkey = y.o_custkey"),
    "explained": (explained, " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS n, '{line}' AS line" for k, line in enumerate(EXPLAINED))),
    "catalog_text": (
        catalog_text,
        "SELECT CAST(0 AS BIGINT) AS n, 'nation: ' || count(*) || ' rows' AS line FROM nation"
        " UNION ALL SELECT 1, 'n_nationkey int [' || min(n_nationkey) || ' .. ' || max(n_nationkey) || ']' FROM nation"
        " UNION ALL SELECT 2, 'n_name string' UNION ALL SELECT 3, 'n_regionkey int'",
    ),
    "generated": (generated, " UNION ALL ".join(f"SELECT 'c{k}' AS \"column\", CAST(6000 AS BIGINT) AS n_rows, true AS in_range, true AS spread" for k in range(6))),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(text)


QUERIES = {name: _query(text) for name, text in TEXTS.items()} | {name: f for name, (f, _) in PROGRAMS.items()}
SQL = TEXTS | {name: sql for name, (_, sql) in PROGRAMS.items() if sql}
