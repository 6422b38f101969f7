import math
import re
import zlib

import numpy as np
import pytest

from conjunx.llm import toxicity as X


def texts(n, seed, bad):
    draw = np.random.default_rng(seed)
    words = [f"w{''.join(chr(97 + int(c)) for c in draw.integers(0, 26, 5))}" for _ in range(400)]
    out = []
    for _ in range(n):
        w = draw.choice(words, 60).tolist()
        if bad:
            for k in draw.integers(0, 60, 4):
                w[k] = str(draw.choice(["vile", "foulness", "scumlike"]))
        out.append(" ".join(w))
    return out


def rows_of(spark, positive, other):
    return spark.createDataFrame([(t, True, False) for t in positive] + [(t, False, True) for t in other], "text string, p boolean, u boolean")


@pytest.fixture(scope="module")
def model(spark):
    rows, prior = rows_of(spark, texts(150, 1, True), texts(900, 1, False) + texts(100, 1, True)), 0.1
    place = X.select(rows)
    return X.Model(place, *X.fit(*X.vectors(rows, place), prior))


def plain_score(model, text):
    """The score word by word."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    z, width = model.bias, len(model.place)
    for name, k in model.place.items():
        n = sum(w == name[:-1] if name.endswith(".") else len(w) >= len(name) and w.startswith(name) for w in words)
        if n:
            z += float(model.weights[k]) + float(model.weights[width + k]) * math.log1p(200 * n / len(words))
    return 1 / (1 + math.exp(-z))


def test_learns_from_positives_and_unlabelled(model, frame):
    assert {"vile.", "foulness."} <= set(model.place)
    some = texts(100, 1, True) + texts(300, 1, False) + texts(100, 9, False) + ["", "Vile VILE foulnesses scum-like é", "vileness"]
    got = [r.tox_score for r in X.score(frame(list(enumerate(some))), model).orderBy("doc_id").collect()]
    assert got == pytest.approx([plain_score(model, t) for t in some])
    assert np.mean(np.array(got[:100]) >= 0.3) > 0.95
    assert np.mean(np.array(got[100:400]) >= 0.3) < 0.02 and np.mean(np.array(got[400:500]) >= 0.3) < 0.02


def test_selection_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(X, "ABOVE", 1.0)
    positive, other = texts(40, 1, True) + ["vileness it", ""], texts(150, 2, False) + texts(20, 1, True)
    names = lambda t: {x for w in re.findall(r"[^\W\d_]+", t.lower()) for x in [w + ".", *(w[:n] for n in (4, 5, 6, 7) if len(w) >= n)]}
    count = lambda ts, x: sum(x in names(t) for t in ts)
    found = []
    for x in set().union(*map(names, positive)):
        n, expected = count(positive, x), (count(other, x) + 1) * len(positive) / len(other)
        if n >= X.LEAST and (n - expected) / expected**0.5 >= 1:
            found.append((-(n - expected) / expected**0.5, x))
    got = X.select(rows_of(spark, positive, other).repartition(3))
    assert list(got) == [x for _, x in sorted(found)][: X.FEATURES] and list(got.values()) == list(range(len(got)))


@pytest.mark.parametrize("seed", range(6))
def test_slope_against_finite_differences(seed):
    draw = np.random.default_rng(seed)
    x, y, w, b, prior = draw.random((30, 5)), draw.random((40, 5)), draw.normal(0, 2, 5), float(draw.normal()), 0.3 if seed % 2 else 0.9
    negative = X.risk(w, b, x, y, prior)[1]
    loss = lambda v: X.risk(v[:-1], v[-1], x, y, prior)
    value = (lambda v: -loss(v)[1]) if negative < 0 else (lambda v: sum(loss(v)))
    at = np.append(w, b)
    wanted = [(value(at + e) - value(at - e)) / 2e-6 for e in 1e-6 * np.eye(6)]
    assert X.slope(w, b, x, y, prior) == pytest.approx(wanted, abs=1e-6)


def test_risk_against_a_loop():
    x, y, w, b, prior = [[1.0, 0.0], [0.5, 2.0]], [[0.0, 1.0], [3.0, 1.0], [1.0, 1.0]], [0.7, -0.4], 0.1, 0.25
    z = lambda r: sum(p * q for p, q in zip(r, w, strict=True)) + b
    plus = lambda r: math.log(1 + math.exp(-z(r)))
    minus = lambda r: math.log(1 + math.exp(z(r)))
    wanted = prior * sum(map(plus, x)) / 2, sum(map(minus, y)) / 3 - prior * sum(map(minus, x)) / 2
    assert X.risk(np.array(w), b, np.array(x), np.array(y), prior) == pytest.approx(wanted)


def test_both_cases_of_the_slope_are_seen():
    draw = np.random.default_rng(0)
    kinds = {X.risk(draw.normal(0, 2, 5), float(draw.normal()), draw.random((30, 5)), draw.random((40, 5)), 0.9)[1] < 0 for _ in range(20)}
    assert kinds == {True, False}


def test_model_is_the_same_again(spark):
    a, b = (rows_of(spark, texts(50, 1, True), texts(200, 1, False)).repartition(n) for n in (1, 4))
    place = X.select(a)
    assert place == X.select(b)
    one, two = X.fit(*X.vectors(a, place), 0.1), X.fit(*X.vectors(b, place), 0.1)
    assert one[1] == two[1] and (one[0] == two[0]).all()


def test_edges(frame, spark, model):
    rows = [(1, None), (2, ""), (3, "1 2 3"), (4, "vile " * 50000), (4, "vile " * 50000), (None, "quiet")]
    got = [(r.doc_id, r.tox_score) for r in X.score(frame(rows, clash=True), model).collect()]
    assert [k for k, _ in got] == [1, 2, 3, 4, 4, None] and all(0 <= s <= 1 for _, s in got)
    assert got[0][1] == got[1][1] == got[2][1] < 0.3 < got[3][1] == got[4][1]
    assert X.score(frame([]), model).count() == 0
    assert [r.tox_score for r in X.score(frame([(1, "x")]), None).collect()] == [0.0]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (9, 1), (4, 0)], "doc_id long, toxic int")
    docs = frame([(1, "a"), (2, "b"), (3, None), (None, "c"), (1, "a2"), (4, "d")], clash=True)
    found, prior = X.sample(docs, labels)
    assert sorted(map(tuple, found.collect())) == [("a", True, True), ("a2", True, True), ("d", False, True)] and prior == 0.5
    assert X.train(docs, labels).weights.shape == (0,)  # no feature is above chance: the prior's score
    assert X.train(docs, labels.where("toxic = 0")) is None and X.train(frame([]), labels.limit(0)) is None
    assert len({r.tox_score for r in X.score(docs, X.train(docs, labels)).collect()}) == 1


def test_samples_are_bounded(frame, spark):
    docs, labels = frame([(k, f"text {k}") for k in range(2000)]), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(2000)], "doc_id long, toxic int")
    rows = X.sample(docs, labels, positives=100, unlabelled=300)[0].collect()
    assert 70 < sum(r.p for r in rows) < 130 and 230 < sum(r.u for r in rows) < 370


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in X.op4_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got]
    assert len(got) == 1000 and all(r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [r for r in labels if got[r.doc_id].held_out]
    wrong = [r for r in held if not r.toxic and got[r.doc_id].predicted]
    found = [r for r in held if r.toxic and got[r.doc_id].predicted]
    assert len(wrong) <= 0.05 * len(held) and len(found) >= 0.4 * sum(r.toxic for r in held)
