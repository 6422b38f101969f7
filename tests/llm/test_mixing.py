import hashlib
import re

import numpy as np
import pytest

from conjunx.llm import mixing as M


def water(sizes, share=1.5, most=2.0):
    """Targets by filling again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s] + 1e-9}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def check(rows, got, options=None):
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    goal, taken = water(sizes), dict.fromkeys(sizes, 0)
    source_of = {r[0]: r[3] for r in rows}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert taken[s] == int(goal[s] + 1e-6)


def test_mix_reaches_targets(spark, frame, folder):
    rows = [(k, "w " * (k % 37 + 1), None, f"s{k % 7}") for k in range(400)] + [(1000 + k, "x " * 50, None, None) for k in range(5)]
    rows += [(2000, "big " * 3000, None, "s3"), (2001, None, None, "s1"), (2002, "", None, "empty"), (2003, " \t\n", None, "empty"), (2004, "one", None, "tiny")]
    path = folder(documents=frame(rows, clash=True))
    got = M.op7_mix(spark, path).collect()
    assert len(got) == len(rows)
    check(rows, got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, M.op7_mix(spark, path).collect()), key=str)


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def brute(rows, shards=M.SHARDS, seed=11, bits=M.BITS):
    """(doc_id, size, source_size, target, taken, shards) document by document, from the quotas that the tree splits."""
    goal, size_of = {}, {}
    sized = [(i, s, words(t), md5("null" if i is None else i, seed, hashlib.md5((t or "").encode()).hexdigest())) for i, t, _, s in rows]
    for _, s, n, _ in sized:
        size_of[s] = size_of.get(s, 0) + n
    goal = water(size_of) if size_of else {}
    order, blocks = {}, {}
    for _, s, n, mark in sized:
        if n:
            blocks.setdefault(s, {}).setdefault(int(mark[:8], 16) >> (32 - bits), []).append((mark, n))
    for s, of in blocks.items():
        order[s] = sorted(of, key=lambda b: (md5(seed, s or "", "true" if s is None else "false", b), b))  # noqa: B023
    drawn = {}  # source: the blocks that are drawn, in order, the last one cut
    for s in blocks:
        left = int(goal[s] + 1e-9)
        drawn[s] = []
        while left > 0:
            for b in order[s]:
                if left > 0:
                    whole = sum(n for _, n in blocks[s][b])
                    drawn[s].append((b, min(left, whole)))
                    left -= whole
    names = sorted((s for s in blocks if s is not None), key=lambda s: s.encode()) + [s for s in blocks if s is None]
    split = M.split_quotas([len(drawn[s]) for s in names], shards, seed)
    gives = {}
    for k, s in enumerate(names):
        at = 0
        for shard in range(shards):
            for b, most in drawn[s][at : at + split[shard][k]]:
                for mark in sorted({m for m, _ in blocks[s][b]}):
                    same = [n for m, n in blocks[s][b] if m == mark]
                    if most > 0 and min(same[0], most // len(same)):
                        gives.setdefault((s, mark), []).append((shard, min(same[0], most // len(same))))
                    most -= sum(same)
            at += split[shard][k]
        assert at == len(drawn[s])
    return sorted(((i, n, size_of[s], pytest.approx(goal[s]), sum(w for _, w in gives.get((s, m), [])), ",".join(f"{k}:{w}" for k, w in gives.get((s, m), []))) for i, s, n, m in sized), key=lambda r: str(r[:3]) + r[5])


def test_query_against_brute_force(spark, frame, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()] + [(5, "again five", None, "web"), (None, "a b c", None, None), (None, "a b c", None, None), (None, "d " * 90, None, None), (7, None, None, "none")]
    got = sorted(map(tuple, M.op7_mix(spark, folder(documents=frame(rows))).collect()), key=lambda r: str(r[:3]) + r[5])
    assert got == brute(rows)


def test_more_words_more_blocks(frame, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 1)
    monkeypatch.setattr(M, "BITS", 3)
    rows = [(k, "w " * (k % 5 + 1), None, "s") for k in range(300)]  # 900 words: 10 bits
    got = sorted((r.doc_id, sum(d.words for d in r.draws)) for r in M.draws(frame(rows)).collect())
    assert got == sorted((r[0], r[4]) for r in brute(rows, bits=10))


def test_shuffled_joins_give_the_same(frame, monkeypatch):
    rows = [(k, "w " * (k % 9), None, f"s{k % 4}") for k in range(300)]
    one = sorted(map(str, M.mix(frame(rows)).collect()))
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    assert sorted(map(str, M.mix(frame(rows)).collect())) == one


def test_edges(frame):
    assert M.draws(frame([])).count() == 0 and M.mix(frame([], clash=True)).count() == 0
    none = M.draws(frame([(1, None, None, "a"), (2, "", None, None), (None, " ", None, "a")])).collect()
    assert [(r.size, r.target, r.draws) for r in none] == [(0, 0.0, [])] * 3
    twice = [(1, "a b", None, "s"), (1, "a b", None, "s"), (None, "c d e", None, "s"), (None, "c d e", None, "t")]
    got = M.draws(frame(twice)).collect()
    assert len(got) == 4 and 13 <= sum(d.words for r in got for d in r.draws) <= 14  # of 10.7 and 4.3; equal rows give alike


def test_mix_rows(frame):
    rows = [(k, "w " * 20, "en", f"s{k % 3}") for k in range(200)]
    df = frame(rows, clash=True)
    drawn = {r.doc_id: r.draws for r in M.draws(df).collect()}
    got = M.mix(df)
    assert got.columns == [*df.columns, "mix_pass", "mix_words", "mix_shard", "mix_position"]
    found = sorted((r.doc_id, r.mix_pass, r.mix_words, r.mix_shard, r.mix_position) for r in got.collect())
    assert found == sorted((k, d["pass"], d.words, d.shard, d.position) for k, ds in drawn.items() for d in ds)
    assert {f[3] for f in found} <= set(range(M.SHARDS)) and len({f[3] for f in found}) > M.SHARDS // 2


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_tree_splits_exactly(shards):
    quotas = [1024, 0, 7, 300, 2048]
    parts = M.split_quotas(quotas, shards, 3)
    assert len(parts) == shards and [sum(p[k] for p in parts) for k in range(5)] == quotas
    totals = [sum(p) for p in parts]
    assert max(totals) - min(totals) <= 3
    assert parts == M.split_quotas(quotas, shards, 3) and all(x >= 0 for p in parts for x in p)


def test_tree_is_hypergeometric():
    got = np.array([M.split_quotas([30, 70, 0, 100], 5, seed)[0] for seed in range(3000)])  # 40 of 200
    assert got.mean(axis=0) == pytest.approx([6, 14, 0, 20], abs=0.2)
    assert got[:, 0].var() == pytest.approx(40 * 0.15 * 0.85 * 160 / 199, rel=0.1)


def test_blocks_are_permuted_by_seed_and_source(frame):
    rows = [(k, "w " * 5, None, f"s{k % 2}") for k in range(2000)]
    first = {(r.doc_id, d["pass"], d.shard) for r in M.draws(frame(rows)).collect() for d in r.draws}
    other = {(r.doc_id, d["pass"], d.shard) for r in M.draws(frame(rows), seed=12).collect() for d in r.draws}
    assert len(first & other) < 0.2 * len(first)


def test_shards_are_shuffled_inside(frame, monkeypatch):
    """Each task has rows of one shard, in order of position; a shard's tasks follow each other."""
    monkeypatch.setattr(M, "SLICE_WORDS", (100, 100))
    rows = [(k, "w " * 3, None, "s") for k in range(1000)]
    parts = [p for p in M.mix(frame(rows), shards=4).select("doc_id", "mix_shard", "mix_position").rdd.glom().collect() if p]
    order = [(r.mix_shard, r.mix_position) for p in parts for r in p]
    assert order == sorted(order) and len(parts) > 8
    assert all(len({r.mix_shard for r in p}) == 1 for p in parts)
    ids = [r.doc_id for p in parts for r in p]
    assert sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.6 * len(ids)


def test_draws_of_a_source_are_disjoint_by_shard(frame):
    """In each pass a block is in one shard only."""
    rows = [(k, "w " * 5, None, "s") for k in range(3000)]
    seen = {}
    for r in M.draws(frame(rows)).collect():
        for d in r.draws:
            seen.setdefault((r.doc_id, d["pass"]), set()).add(d.shard)
    assert all(len(x) == 1 for x in seen.values())


def test_no_python_on_the_executors(spark, data):
    plan = M.op7_mix(spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rows_without_id_or_with_one_id_are_drawn_by_themselves(frame):
    rows = [(None, f"n{k % 9} " * (k % 9 + 1), None, f"s{k % 2}") for k in range(60)] + [(5, "w " * (k % 4 + 1), None, "s1") for k in range(40)] + [(100 + k, "u " * 20, None, "s0") for k in range(10)]
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    got, goal = M.mix(frame(rows, clash=True)).collect(), water(sizes)
    for s in sizes:
        assert int(goal[s] + 1e-6) - 9 <= sum(r.mix_words for r in got if r.source == s) <= int(goal[s] + 1e-6)  # up to nine rows are equal
    assert all(r.mix_words <= words(r.text) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, M.mix(frame(rows, clash=True).repartition(3)).collect()))
