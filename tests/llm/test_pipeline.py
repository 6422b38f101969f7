"""The pipeline against brute force, a stage at a time, and its registration."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conjunx.llm import registry, stages

REPO = Path(__file__).parents[2]


@pytest.fixture(scope="module")
def steps(spark, data, tmp_path_factory):
    """The rows before and after every stage."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, data).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps, spark, data):
    own = spark.read.parquet(f"{data}/documents.parquet").columns
    assert all(after.columns == own for _, after in steps[:-1]) and steps[-1][1].columns[: len(own)] == own


def test_languages_keep_clean_documents(steps):
    before, after = map(by_id, steps[0])
    gone = [r for k, r in before.items() if k not in after]
    assert len(gone) <= 0.01 * len(before) and all(before[k] == r for k, r in after.items())


def shingles(text, n=5):
    w = text.lower().split()
    return {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def test_one_of_each_group_stays(steps):
    before, after = map(by_id, steps[1])
    sets = {k: shingles(r.text) for k, r in before.items()}
    links = {k: [j for j in sets if j != k and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])] for k in sets}
    for k, r in before.items():
        if k not in after:
            assert any(len(sets[k] & sets[j]) > 0.8 * 0.999 * len(sets[k] | sets[j]) for j in sets if j != k)
        assert k not in after or after[k] == r
    missed = [k for k in after if any(j in after and j < k for j in links[k])]
    assert len(missed) <= 0.1 * max(1, sum(bool(x) for x in links.values()))
    exact = {}
    for k, r in sorted(before.items()):
        exact.setdefault(r.text, []).append(k)
    assert all(not set(ks[1:]) & set(after) for ks in exact.values())


def test_benchmark_passages_go(steps, spark, data):
    from test_decontaminate import brute

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    before, after = map(by_id, steps[2])
    for k, r in before.items():
        n, hit, _ = brute(r.text, items)
        if not hit:
            assert after[k] == r
        elif k in after:
            assert len(hit) <= n / 2 and after[k].n_chars == len(after[k].text) < r.n_chars
        else:
            assert len(hit) > n / 2


def test_personal_data_goes(steps):
    from test_pii import base

    before, after = map(by_id, steps[3])
    assert before.keys() == after.keys()
    for k, r in before.items():
        assert not [s for s in base(after[k].text) if s]
        if not base(r.text) and "token" not in r.text.lower():
            assert after[k] == r


def test_mix_draws_from_all(steps):
    before, after = steps[4]
    kept, rows = by_id(before), after.collect()
    assert all((r.text, r.lang, r.source) == (kept[r.doc_id].text, kept[r.doc_id].lang, kept[r.doc_id].source) for r in rows)
    words = sum(len(re.findall(r"[^\x20\x09-\x0d]+", r.text)) for r in kept.values())
    assert sum(r.mix_words for r in rows) == pytest.approx(1.5 * words, abs=len({r.source for r in rows}) + 1)


def test_run(spark, data, steps):
    assert corpus_pipeline.run(spark, data).count() == steps[-1][1].count()
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.STAGES is stages.STAGES


ODD = [
    (1, None, None, None, None),
    (2, "", "en", None, 0),
    (2, "the text of one document", None, None, 24),
    (None, "12 34", "en", "s", 5),
    (None, "write to someone at a@b.co today, for this is a text without an id", None, "s", 0),
    (7, "the address is x@y.zz, and there is some more text of the first row", "en", "s", 0),
    (7, "here is 10.20.30.40 in the second row with this very id, and it stays", "en", "s", 0),
    (7, "here is 10.20.30.40 in the second row with this very id, and it stays", "en", "s", 0),
    (9, "HERE is 10.20.30.40 in the second row with this very id, and it stays", "en", "t", 0),
]


def odd(spark, data, path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int, c0 string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").limit(0).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_tables(spark, data, tmp_path):
    """Null and repeated ids, null and empty texts, equal rows, columns with clashing names: what becomes of each row."""
    sf = odd(spark, data, tmp_path, [(*r, 5, "c") for r in ODD])
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in stages.STAGES:
        docs = stage(spark, docs, sf)
        kept.append((name, sorted((str(r.doc_id), r.text) for r in docs.collect())))
    texts = [(str(r[0]), r[1]) for r in ODD]
    assert kept[0][1] == sorted(x for k, x in enumerate(texts) if k not in (0, 1, 3))  # no letters
    assert kept[1][1] == sorted([texts[2], texts[4], texts[5], texts[6]])  # equal word sequences: one row
    assert kept[2][1] == kept[1][1]
    redacted = sorted((k, t.replace("a@b.co", "<EMAIL>").replace("x@y.zz", "<EMAIL>").replace("10.20.30.40", "<IP>")) for k, t in kept[1][1])
    assert kept[3][1] == redacted and set(kept[4][1]) <= set(redacted)
    assert {"node", "c0"} <= set(docs.columns) and {(r.node, r.c0) for r in docs.collect()} == {(5, "c")}
    sizes = {t: len(t.split()) for _, t in redacted}
    for r in docs.collect():
        assert 0 < r.mix_words <= sizes[r.text] and r.n_chars == len(r.text)


def test_empty_table(spark, data, tmp_path):
    out = corpus_pipeline.run(spark, odd(spark, data, tmp_path, []))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stage_folders_do_not_stay(spark, data, tmp_path):
    from conjunx.llm.common import shared_dir

    top = Path(shared_dir(spark).removeprefix("file:"))
    before = set(top.glob("pipeline-*"))
    corpus_pipeline.run(spark, odd(spark, data, tmp_path, [(*r, 5, "c") for r in ODD])).count()
    (made,) = set(top.glob("pipeline-*")) - before
    assert [p.name for p in made.iterdir()] == [str(len(stages.STAGES) - 1)]


def test_registered():
    names = entry.queries()
    assert set(registry.QUERIES) | {"pipeline"} <= set(names)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert registry.SQL.items() <= entry.oracle_sql().items()


def test_nothing_else_imports_this_subpackage():
    for path in REPO.glob("conjunx/**/*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
