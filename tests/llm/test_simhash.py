import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from conjunx.llm import covering, simhash
from conjunx.llm.components import stars


def fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    parts = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(ids, fps, radius=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, fps, strict=True):
        for j, b in zip(ids, fps, strict=True):
            if i < j and (a ^ b).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_pair_in_the_radius_meets(radius):
    draw = random.Random(radius)
    tables = covering.masks(radius)
    assert len(tables) == 2 ** (radius + 1) - 1
    for bits in (2**64 - 1, 0xFFFF00FF00F0F00F, 0b1011):
        places = [k for k in range(64) if bits >> k & 1]
        for _ in range(3000):
            differ = sum(1 << k for k in draw.sample(places, min(radius, len(places) - 1)))
            assert any(not differ & m for m in covering.masks(radius, bits))


def close(spark, fps, radius=3):
    rows = [(k, [f - 2**64 if f >= 2**63 else f]) for k, f in enumerate(fps)]
    edges = stars(covering.links(spark.createDataFrame(rows, "node long, fp array<long>"), radius))
    return {k: k for k in range(len(fps))} | {r.a: r.b for r in edges.collect()}


def near(draw, x, n):
    return x ^ sum(1 << k for k in draw.sample(range(64), n))


def clustered(draw, n):
    heads = [draw.getrandbits(64) for _ in range(8)]
    fps = [near(draw, draw.choice(heads), draw.randint(0, 5)) for _ in range(n)]
    chain = [draw.getrandbits(64)]
    for _ in range(12):
        chain.append(near(draw, chain[-1], 3))
    return fps + chain


def test_links_connect_as_all_pairs_do(spark):
    draw = random.Random(5)
    fps = list(dict.fromkeys(clustered(draw, 300)))
    assert close(spark, fps) == components(range(len(fps)), fps)


def test_hot_buckets_are_split_exactly(spark, monkeypatch):
    draw = random.Random(6)
    head = draw.getrandbits(64)
    fps = list(dict.fromkeys([near(draw, head, draw.randint(0, 4)) for _ in range(250)] + clustered(draw, 50)))
    monkeypatch.setattr(covering, "PART_ROWS", 20)
    monkeypatch.setattr(covering, "DIRECT", 16)
    assert close(spark, fps) == components(range(len(fps)), fps)


def test_large_groups_in_a_task(monkeypatch):
    monkeypatch.setattr(covering, "DIRECT", 32)
    draw = random.Random(8)
    fps = np.array(sorted({near(draw, 2**63 + 5, draw.randint(0, 9)) for _ in range(600)}), np.uint64)
    a, b = covering._links(np.zeros(len(fps), np.int64), fps, np.arange(len(fps)), 3)
    assert (np.bitwise_count(fps[a] ^ fps[b]) <= 3).all()
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[max(find(x), find(y))] = min(find(x), find(y))
    assert {k: find(k) for k in range(len(fps))} == components(range(len(fps)), fps.tolist())


def test_no_group_gives_all_its_pairs():
    n = 3000
    a, _ = covering._links(np.zeros(n, np.int64), np.full(n, 7, np.uint64), np.arange(n), 3)
    assert len(a) == n - 1


def test_components_of_hubs_and_chains(spark):
    edges = [(k, 0) for k in range(1, 200)] + [(1000 + k + 1, 1000 + k) for k in range(60)] + [(5000, 150), (5000, 1030)]
    got = {r.a: r.b for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 199 + 61 + 1
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r for r in simhash.op6_simhash(spark, data).collect()}
    fps = {k: fingerprint(t) for k, t in docs.items()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{f:016x}" for k, f in fps.items()}
    assert {k: r.component_id for k, r in got.items()} == components(list(fps), list(fps.values()))


def test_edges(frame):
    rows = [(5, None), (4, ""), (9, " \t\n"), (7, "One two"), (8, "one TWO"), (3, "a " * 100000), (3, "a " * 100000), (None, "one two"), (1, "x y z w é")]
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame(rows, clash=True)).collect()]
    assert len(got) == len(rows)
    by = {k: (f, c) for k, f, c in got}
    assert by[5] == by[4] == by[9] == (0, 4) and by[7] == by[8] == by[None] and by[7][1] == 7 and by[3][1] == 3
    assert simhash.near_duplicates(frame([])).count() == 0


def jaccard(a, b, n=5):
    sets = [{" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_copies(frame):
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(2, 9)))
    text = [word() for _ in range(400)]
    edited = [text[:k] + [word()] + text[k + 1 :] for k in (10, 200, 390)]
    other = [[word() for _ in range(400)] for _ in range(30)]
    rows = [(20, " ".join(text)), (7, " ".join(text).upper()), (8, "  ".join(text))] + [(30 + k, " ".join(t)) for k, t in enumerate(edited)] + [(100 + k, " ".join(t)) for k, t in enumerate(other)]
    rows += [(1, None), (2, ""), (3, " "), (None, " ".join(text)), (20, " ".join(text))]
    df = frame(rows, clash=True)
    got = simhash.drop_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([7, *range(100, 130), 1, 2, 3], key=str)
    assert all(jaccard(rows[0][1], " ".join(t)) > 0.9 for t in edited)
    assert simhash.drop_copies(frame([])).count() == 0


def joined(pairs):
    """All but the smallest of each component."""
    least = {}
    for a, b in pairs:
        least.setdefault(a, a)
        least.setdefault(b, b)
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return {k for k, x in least.items() if x != k}


def test_copies_recall(spark):
    """Of the pairs whose five-word shingles are alike to 0.8 or more, nine in ten at least; of others none."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {k: frozenset(" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for k, t in docs if (w := t.lower().split())}
    where = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in where.values() if len(ks) < 200 for a in ks for b in ks if a < b}
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    must = {b for (_, b), j in alike.items() if j >= 0.8}
    may_pairs = [p for p, j in alike.items() if j >= 0.8]
    gone = {r.doc_id for r in simhash.copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(gone & must) >= 0.9 * len(must) and gone <= joined(may_pairs)


def plain_weighted(text, seeds):
    """The fingerprints bit by bit."""
    counts = {}
    for w in text.lower().split():
        counts[w] = counts.get(w, 0) + 1
    out = []
    for seed in range(seeds):
        bits = 0
        for k in range(64):
            total = 0
            for w, n in counts.items():
                h = int(simhash._mixed(simhash.hashes([w]), seed)[0])
                total += round(16 * (1 + math.log(n))) * (1 if h >> k & 1 else -1)
            bits |= (total > 0) << k
        out.append(bits)
    return out


@pytest.mark.parametrize("together", [3, simhash.TOGETHER])
def test_weighted_against_a_loop(monkeypatch, together):
    monkeypatch.setattr(simhash, "TOGETHER", together)
    draw = random.Random(6)
    texts = [" ".join(draw.choices("abcdefgh", k=n)).encode() for n in (0, 1, 2, 9, 40, 0, 5)] + ["é É é".encode()]
    got = simhash.weighted(texts, 2).view(np.uint64).tolist()
    assert got == [plain_weighted(t, 2) for t in texts]
    assert simhash.weighted([b"", b" "], 3).tolist() == [[0] * 3] * 2


def test_copies_with_any_ids(frame):
    """Ids that are text, null or repeated: of each group one row stays."""
    draw = random.Random(8)
    text = [f"w{draw.randint(0, 10**6)}" for _ in range(300)]
    near = " ".join([*text[:100], "x", *text[101:]])
    text = " ".join(text)
    rows = [("b", text), ("a10", near), ("a10", near.upper()), ("a9", "other words"), ("a9", text), (None, near), (None, "no id here"), (None, "no id  HERE"), (None, None), (None, None), ("c", "other words")]
    kept_near, kept_none = (min(x, key=lambda t: hashlib.md5(t.encode()).digest()) for x in ((near, near.upper()), ("no id here", "no id  HERE")))
    rows += [rows[-1], rows[1], rows[2]]  # equal rows
    df = frame(rows, kind="doc_id string, text string, lang string, source string", clash=True)
    assert sorted(((str(r.doc_id), r.text) for r in simhash.drop_copies(df).collect()), key=str) == sorted([("a10", kept_near), ("a9", "other words"), ("None", kept_none), ("None", None), ("None", None)], key=str)
    assert {(r.doc_id, r.keeper) for r in simhash.copies(df).collect()} == {("b", "a10"), ("a9", "a10"), (None, "a10"), ("c", "a9")}


@pytest.mark.parametrize("part", [simhash.PART_SHINGLES, 5000])
def test_members_less_alike_than_their_base(frame, monkeypatch, part):
    """Fingerprints of words are all equal; the smallest id is like none, members are alike to the base only."""
    monkeypatch.setattr(simhash, "PART_SHINGLES", part)
    draw = random.Random(9)
    base = [f"w{k}" for k in range(120)]

    def swapped(*places):
        words = list(base)
        for k in places:
            words[k], words[k + 1] = words[k + 1], words[k]
        return " ".join(words)

    places = [(i, j) for i in range(6, 112, 2) for j in range(i + 8, 112, 2)]
    members = [swapped(*p) for p in (places if part > 5000 else places[::9])]
    assert jaccard(" ".join(base), members[0]) > 0.8 > jaccard(members[0], members[-1])
    apart = [" ".join(draw.sample(base, len(base))) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(apart + members)] + [(100_000, " ".join(base))]
    gone = {r.doc_id for r in simhash.copies(frame(rows)).collect()}
    assert gone == {*range(21, len(rows) - 1), 100_000}


@pytest.mark.parametrize(("part", "pivots"), [(300, 1), (300, 4), (2000, 8), (10**6, 8)])
def test_large_components_against_all_pairs(spark, monkeypatch, part, pivots):
    """One component of several families, some alike to each other over single members only; parts and pivots change nothing."""
    monkeypatch.setattr(simhash, "PART_SHINGLES", part)
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    draw = random.Random(part + pivots)
    texts = []
    for _ in range(4):
        text = [f"w{draw.randrange(10**6)}" for _ in range(60)]
        for _ in range(draw.choice((3, 30))):
            text = list(text) if draw.random() < 0.7 else list(texts[-1]) if texts else list(text)
            text[draw.randrange(60)] = f"w{draw.randrange(10**6)}"
            texts.append(text)
    texts = list(dict.fromkeys(" ".join(t) for t in texts))
    docs = spark.createDataFrame([(k, t, bytes([k])) for k, t in enumerate(texts)], "doc_id long, text string, raw binary")
    nodes = docs.selectExpr("doc_id + 500 node", "doc_id id", "raw")
    links = spark.createDataFrame([(500 + k, 500) for k in range(1, len(texts))], "a long, b long")
    found = [tuple(r) for r in simhash._verified(links, nodes, docs, 5, 0.8).collect()]
    alike = [(500 + a, 500 + b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    assert set(found) <= set(alike) and joined(found) == joined(alike)
    if part == 300 and pivots == 4:
        assert simhash._tied(spark.createDataFrame([(1, k, list(range(50 - k % 3))) for k in range(40)], "component long, node long, set array<long>"), 0.8)[0].where("tied").count() == 40


def test_forest_against_all_pairs():
    draw = random.Random(3)
    for _ in range(60):
        heads = [draw.sample(range(60), draw.randint(1, 12)) for _ in range(4)]
        sets = [np.array(sorted({*draw.choice(heads), *draw.sample(range(60), draw.randint(0, 3))})) for _ in range(draw.randint(2, 40))]
        least = draw.choice((0.5, 0.8))
        alike = [(j, i) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= least * len(np.union1d(sets[i], sets[j]))]
        found = simhash._forest(sets, list(range(len(sets))), least)
        assert joined(found) == joined(alike) and len(found) == len(joined(alike))
