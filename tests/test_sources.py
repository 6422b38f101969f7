import json
import os
import struct

import pytest

from conjunx import Engine
from conjunx.batch import run_config
from conjunx.sources import files, paged
from conjunx.streaming.selects import stream


@pytest.fixture(autouse=True)
def pages(spark):
    paged.register(spark)


def write(spark, rows, columns, path):
    kind = ", ".join(f"c{k} int" for k in range(columns))
    spark.createDataFrame(rows, kind).coalesce(1).write.format("pages").mode("append").save(str(path))


@pytest.mark.parametrize("n", [1, 169, 170, 171, 340, 341])
def test_round_trip_at_page_edges(spark, tmp_path, n):
    rows = [(k, -k, 2**31 - 1, -(2**31), 0, k * k) for k in range(n)]
    write(spark, rows, 6, tmp_path / "t")
    assert paged.capacity(6) == 170
    (part,) = (tmp_path / "t").iterdir()
    assert part.stat().st_size == paged.PAGE * -(-n // 170)
    assert [tuple(r) for r in spark.read.format("pages").option("pagesPerTask", 1).load(str(tmp_path / "t")).collect()] == rows


def test_layout_is_big_endian(spark, tmp_path):
    write(spark, [(1, 2), (3, -4)], 2, tmp_path / "t")
    (part,) = (tmp_path / "t").iterdir()
    raw = part.read_bytes()
    assert struct.unpack_from(">6i", raw) == (2, 2, 1, 2, 3, -4) and not any(raw[24:])


def test_page_without_rows_ends_a_file(spark, tmp_path):
    page = struct.pack(">4i", 2, 1, 5, 6).ljust(4096, b"\0")
    (tmp_path / "f").write_bytes(page + struct.pack(">2i", 2, 0).ljust(4096, b"\0"))
    assert [tuple(r) for r in spark.read.format("pages").load(str(tmp_path / "f")).collect()] == [(5, 6)]


def test_empty_tables(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"")
    assert spark.read.format("pages").schema("a int").load(str(tmp_path / "f")).count() == 0
    spark.createDataFrame([], "a int").write.format("pages").mode("append").save(str(tmp_path / "d"))
    assert spark.read.format("pages").schema("a int").load(str(tmp_path / "d")).count() == 0


def test_filters_columns_and_places(spark, tmp_path):
    rows = [(k, k % 5, -k) for k in range(2000)]
    write(spark, rows, 3, tmp_path / "t")
    read = lambda kind, **o: spark.read.format("pages").options(columns="a,b,c", pagesPerTask="2", **o).schema(kind).load(str(tmp_path / "t"))
    df = read("c int, a int").where("a >= 700 and a < 710 and c <> -705 and a is not null")
    assert sorted(map(tuple, df.collect())) == sorted((c, a) for a, _, c in rows if 700 <= a < 710 and c != -705)
    assert "Filter NOT (c" in df._jdf.queryExecution().optimizedPlan().toString() or "NOT" in df._jdf.queryExecution().executedPlan().toString()
    (part,) = (str(x) for x in (tmp_path / "t").iterdir())
    most = paged.capacity(3)
    placed = read("a int, _file string, _page int").where("a = 1000").first()
    assert tuple(placed) == (1000, part, 1000 // most)
    some = read("a int", only=json.dumps({part: [1, 3, 99]}))
    assert [r.a for r in some.collect()] == [*range(most, 2 * most), *range(3 * most, 4 * most)]
    assert read("a int", only="{}").count() == 0 and read("b int").where("b = 3 and b > 3").count() == 0
    with pytest.raises(Exception, match="no columns"):
        read("z int").collect()


def test_index_of_pages(spark, tmp_path):
    rows = [(k * 7 % 5000, k) for k in range(5000)]
    write(spark, rows, 2, tmp_path / "t")
    kind = spark.createDataFrame([], "a int, b int").schema
    e = Engine(spark).register("t", str(tmp_path / "t"), format="pages", schema=kind, columns="a,b").index("t", "a", str(tmp_path / "i"))
    q = "SELECT t.b FROM t WHERE t.a = 33"
    assert "IndexScan[t,a,33,33]" in e.explain(q)[1] and [r.b for r in e.sql(q).collect()] == [b for a, b in rows if a == 33]
    assert "TableScan[t]" in e.explain("SELECT t.b FROM t WHERE t.a > 33")[1]
    assert len(e.catalog._places(e.catalog._entry("t"), e.plan(q).steps[0].scan.access)) == 1


def test_nulls_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="no nulls"):
        spark.createDataFrame([(1,), (None,)], "a int").coalesce(1).write.format("pages").mode("append").save(str(tmp_path / "d"))


def test_scratch_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}  # noqa: RUF012

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        files.scratch(Session(), "x")
    Session.sparkContext.master = "local[4]"
    assert "x-" in files.scratch(Session(), "x")


def test_other_types_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="32-bit integers"):
        spark.range(3).write.format("pages").mode("append").save(str(tmp_path / "d"))


def test_sorted_rows_stay_sorted(spark, tmp_path):
    spark.range(5000).selectExpr("cast(4999 - id as int) a").repartition(7).orderBy("a").write.format("pages").mode("overwrite").save(str(tmp_path / "d"))
    assert [r.a for r in spark.read.format("pages").schema("a int").load(str(tmp_path / "d")).collect()] == list(range(5000))


def test_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (3, None)], "a int, b int")
    files.write_text(df.coalesce(1), str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("part-*")
    assert part.read_text() == '1,2\n3,\n' or part.read_text() == '1,2\n3,""\n'
    assert sorted(map(tuple, files.read_text(spark, str(tmp_path / "t"), df.schema).collect()), key=str) == [(1, 2), (3, None)]


def test_generator(spark):
    a, b = files.generate(spark, 500, 3, 10, seed=4).collect(), files.generate(spark, 500, 3, 10, seed=4).collect()
    assert a == b and len(a) == 500 and {x for r in a for x in r} == set(range(10))
    assert files.generate(spark, 500, 3, 10, seed=5).collect() != a


def test_cluster_sorts(spark, tmp_path):
    files.cluster(files.generate(spark, 2000, 2, 100), "c0", str(tmp_path / "c"), partitions=3, bloom=True)
    parts = [spark.read.parquet(str(p)).toPandas().c0 for p in sorted((tmp_path / "c").glob("part-*"))]
    assert all(p.is_monotonic_increasing for p in parts) and sum(map(len, parts)) == 2000
    assert all(a.max() < b.min() for a, b in zip(parts, parts[1:]))


def test_batch(spark, tmp_path):
    source, out, temporary = (tmp_path / x for x in ("in", "out", "tmp"))
    (source / "db/data").mkdir(parents=True)
    r = [(k % 7, k, 100 - k) for k in range(300)] + [(60 + k % 900, 1000 + k, 9) for k in range(9000)]
    s = [(k, k * 2) for k in range(5)]
    for name, rows, n in (("R", r, 3), ("S", s, 2)):
        with open(source / "db/data" / name, "wb") as f:
            most = paged.capacity(n)
            for k in range(0, len(rows), most):
                f.write(paged.encode(__import__("numpy").array(rows[k : k + most])))
    (source / "db/schema.txt").write_text("R A B C\nS G H\n")
    (source / "db/index_info.txt").write_text("R A 1 10 B 0 10\n")
    (source / "queries.sql").write_text("SELECT * FROM S;\nSELECT R.B, S.H FROM R, S WHERE R.A = S.G AND R.B < 20 ORDER BY S.H;\nSELECT R.A FROM R GROUP BY R.A;\nSELECT DISTINCT R.A FROM R WHERE R.A > 2 AND R.A < 10;\nSELECT R.B FROM R WHERE R.B < 3 AND R.B > 7;\nSELECT R.C FROM R WHERE R.B = 1234;\n")
    (tmp_path / "config").write_text(f"{source}\n{out}\n{temporary}\n")
    before = (source / "db/data/R").read_bytes()
    done = run_config(spark, str(tmp_path / "config"))
    assert [d.number for d in done] == [1, 2, 3, 4, 5, 6] and [d.error is None for d in done] == [True, True, False, True, True, True]
    assert "GROUP" in done[2].error and (source / "db/data/R").read_bytes() == before
    read = lambda n, kind: [tuple(x) for x in spark.read.format("pages").schema(kind).load(str(out / f"query{n}")).collect()]
    assert sorted(read(1, "G int, H int")) == s
    assert read(2, "B int, H int") == sorted(((b, 2 * a) for a, b, _ in r if a < 5 and b < 20), key=lambda x: (x[1], x[0]))
    assert read(4, "A int") == [(3,), (4,), (5,), (6,)] and read(5, "B int") == []
    assert read(6, "C int") == [(9,)] and "IndexScan[R,B,1234,1234]" in (out / "query6_physicalplan").read_text()
    assert "IndexScan[R,A,2,10]" in (out / "query4_physicalplan").read_text() and (out / "query4_logicalplan").read_text().startswith("DupElim")
    assert (temporary / "db/stat.txt").read_text().splitlines()[0] == "R 9300 A,0,959 B,0,9999 C,-199,100"
    assert any(x.startswith("part-") for x in os.listdir(out / "query1_humanreadable"))


def test_stream(spark, data, tmp_path):
    e = Engine(spark).register("nation", f"{data}/nation.parquet").register("customer", f"{data}/customer.parquet")
    spark.read.parquet(f"{data}/customer.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    q = "SELECT c.c_custkey, n.n_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND n.n_nationkey < 4"
    run = stream(e, q, "customer", str(tmp_path / "in"), maxFilesPerTrigger="1").writeStream.format("memory").queryName("streamed").start()
    try:
        run.processAllAvailable()
        assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, e.sql(q).collect()))
    finally:
        run.stop()
    with pytest.raises(ValueError):
        stream(e, "SELECT DISTINCT c_custkey FROM customer", "customer", str(tmp_path / "in"))
