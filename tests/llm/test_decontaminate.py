import hashlib
import random
import re

import pytest

from conjunx.llm import decontaminate as D
from conjunx.llm.suffix_automaton import SuffixAutomaton


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, window=10):
    """(words, hit places, items), by trying every window at every place."""
    doc, hit, found = words(text), set(), set()
    for label, item in items:
        seq = words(item)
        n = min(window, len(seq))
        if not n:
            continue
        windows = {tuple(seq[k : k + n]) for k in range(len(seq) - n + 1)}
        for k in range(len(doc) - n + 1):
            if tuple(doc[k : k + n]) in windows:
                hit.update(range(k, k + n))
                if label is not None:
                    found.add(str(label))
    return len(doc), hit, sorted(found)


@pytest.mark.parametrize("seed", range(40))
def test_automaton_against_brute_force(seed):
    draw = random.Random(seed)
    letters = "abc"[: draw.randint(1, 3)]
    text = lambda n: " ".join(draw.choices(letters, k=n))
    items = [(k, text(draw.randint(0, 12))) for k in range(draw.randint(0, 6))]
    window = draw.randint(1, 6)
    automaton = SuffixAutomaton(((str(k), D.words(t.encode())) for k, t in items), window)
    for _ in range(20):
        doc = " z ".join(text(draw.randint(0, 15)) for _ in range(3))
        n, hits, found = D.find(doc.encode(), automaton)
        wanted = brute(doc, items, window)
        assert (n, {k for a, b in hits for k in range(a, b)}, sorted(found)) == wanted


def test_query_against_brute_force(spark, data):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = D.op5_decontaminate(spark, data).collect()
    assert len(got) == len(docs) and any(r.contaminated for r in got)
    for r in got:
        n, hit, found = brute(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit))


def test_sql_is_the_same(spark, data, frame, folder):
    import duckdb

    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(14))), (2, None), (3, ""), (4, "Solo É"), (None, "null id")], "item_id long, text string")
    odd = folder(documents=frame([(1, None), (2, "a solo é"), (2, "a solo é"), (None, "W0 " * 3 + " ".join(f"w{k}" for k in range(12)) + " null id")], clash=True), benchmark=bench)
    for path in (data, odd):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet{'' if path == data else '/*.parquet'}')")
        assert sorted(map(tuple, D.op5_decontaminate(spark, path).collect()), key=str) == sorted(con.sql(D.OP5_SQL).fetchall(), key=str)


def test_edges_and_blocks(spark, frame):
    item = " ".join(f"w{k}" for k in range(14))
    bench = spark.createDataFrame([(1, item), (10, item), (2, None), (3, ""), (None, "Solo Word"), (4, "é ß x1")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, f"a {item.upper()}, b"), (4, "x " * 100000 + item), (3, f"a {item.upper()}, b"), (None, "a solo-word! é ß x1"), (5, "!!!")]
    for limit in (10**6, 40):
        got = D.scan(frame(rows, clash=True), bench, block_chars=limit)
        seen = [(r.doc_id, r.n_words, [(h.start, h.stop) for h in r.hits], r["items"]) for r in got.collect()]
        one = (3, 16, [(1, 15)], ["1", "10"])
        assert sorted(seen, key=str) == sorted([(1, 0, [], []), (2, 0, [], []), one, (4, 100014, [(100000, 100014)], ["1", "10"]), one, (None, 6, [(1, 6)], ["4"]), (5, 0, [], [])], key=str)
    none = bench.limit(0)
    assert [r.hits for r in D.scan(frame(rows[:3]), none).collect()] == [[], [], []]
    assert D.scan(frame([]), bench).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_blocks_against_brute_force(spark, frame, seed):
    """Many blocks and filters; short items too, and words that are in no item."""
    draw = random.Random(seed)
    text = lambda n, of="abcd": " ".join(draw.choices(of, k=n))
    items = [(k if k % 5 else None, text(draw.randint(0, 9))) for k in range(30)]
    docs = [(k, " z ".join(text(draw.randint(0, 12), "abcdefgh") for _ in range(3))) for k in range(60)] + [(3, None), (None, text(30)), (None, "")]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), frame(docs, clash=True)
    one = D.scan(df, bench, window=5).select("doc_id", "text", "n_words", "hits", "items").collect()
    many = D.scan(df, bench, window=5, block_chars=40, filter_windows=25).select("doc_id", "text", "n_words", "hits", "items").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    for r in many:
        n, hit, found = brute(r.text, items, 5)
        assert (r.n_words, {k for h in r.hits for k in range(h.start, h.stop)}, r["items"]) == (n, hit, found)
        assert all(a.stop < b.start for a, b in zip(r.hits, r.hits[1:], strict=False))
    cut = [sorted(map(str, D.decontaminate(df, bench, window=5, **o).collect())) for o in ({}, {"block_chars": 40, "filter_windows": 25})]
    assert cut[0] == cut[1]


def test_filters_clear_what_has_no_window(spark, frame):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(50)], "item_id long, text string")
    docs = [(k, " ".join(f"d{k}x{j}" for j in range(100))) for k in range(200)] + [(1000, " ".join(f"w7x{j}" for j in range(12)))]
    rows = D._uncleared(frame(docs).select("doc_id", "text"), "text", items.withColumnRenamed("item_id", "id"), 10, 100).where("maybe").collect()
    assert 1000 in {r.doc_id for r in rows} and len(rows) < 20


def test_spans_are_cut_out(spark, frame):
    item = " ".join(f"w{k}" for k in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, f"{'clean ' * 20}({item}), ünd {'more ' * 5}"), (4, f"x {item}"), (5, "clean")]
    df = frame(rows, clash=True)
    got = D.decontaminate(df, bench)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: None, 2: "", 3: f"{'clean ' * 20}(), ünd {'more ' * 5}", 5: "clean"}
