import math
import random
import zlib

import numpy as np
import pytest

from conjunx.llm import language_id as L

EN, DE = "the quick brown fox jumps over the lazy dog and then it goes home with this", "der schnelle braune fuchs springt über den faulen hund und dann geht er nach hause"
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом идет домой"


@pytest.fixture(scope="module")
def model(spark, frame):
    return L.train(frame([(k, t, x) for k, (t, x) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 20)] + [(99, "nothing", None), (98, None, "en")]))


def brute(scores):
    """All label sequences."""
    import itertools

    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        value = sum(scores[k, x] for k, x in enumerate(path)) - L.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))
        if best is None or value > best + 1e-9:
            best = value
    return best


def value(scores, path):
    return sum(scores[k, x] for k, x in enumerate(path)) - L.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_viterbi_is_optimal():
    draw = np.random.default_rng(1)
    sizes = np.array([1, 7, 3, 6, 7])
    scores = -draw.exponential(5.0, (sizes.sum(), 3))
    starts = np.cumsum(sizes) - sizes
    got = L.viterbi(scores, starts, sizes)
    for a, n in zip(starts, sizes, strict=True):
        assert value(scores[a : a + n], got[a : a + n]) == pytest.approx(brute(scores[a : a + n]))


def test_words():
    texts = ["Ab, c1d é́x", "", "Я 2"]
    w = L.words_of(texts)
    found = [(k, texts[k][a:b]) for k, a, b in zip(w.text.tolist(), w.start.tolist(), w.end.tolist(), strict=True)]
    assert found == [(0, "Ab"), (0, "c"), (0, "d"), (0, "é́x"), (2, "Я")]
    marks = L.words_of(["12 \u25cc\u0300\u25cc\u0301 3", "\u0300\u0301", "\u0300\u0301a\u0300\u0301 \u0301\u0300b"])
    assert list(zip(marks.text.tolist(), marks.start.tolist(), marks.end.tolist(), marks.letters.tolist(), strict=True)) == [(2, 2, 5, 3), (2, 8, 9, 1)]
    one, two = L.words_of(["fox dog"]), L.words_of(["x", "dog"])
    assert one.cells[one.first[1] :].tolist() == two.cells[two.first[1] :].tolist()  # a word's cells are its own


def test_identify(frame, model):
    assert model.langs == ["de", "en", "ru"]
    long = " ".join([EN] * 3000)
    rows = [(1, EN), (2, DE.upper()), (3, RU), (4, f"{EN} {EN} {DE} {DE}"), (5, None), (6, ""), (7, "12 \u25cc\u0300\u0301\u25cc\u0301 3"), (8, long), (1, EN), (None, DE)]
    got = L.identify(frame(rows, clash=True), model)
    assert got.columns.count("lang_pred") == 1 and "a.b" in got.columns
    by = [(r.doc_id, r.lang_pred, r.lang_score, r.lang_spans) for r in got.collect()]
    assert [x[1] for x in by] == ["en", "de", "ru", by[3][1], "und", "und", "und", "en", "en", "de"]
    assert [x[2] for x in by[4:7]] == [0, 0, 0] and by[0] == by[8]
    assert [s.lang for s in by[3][3]] == ["en", "de"]
    text = rows[3][1]
    assert text[by[3][3][0].start : by[3][3][0].stop].endswith("this") and text[by[3][3][1].start :].startswith("der")
    assert by[7][3] == [(0, len(long), "en")]


def plain_scores(word, docs):
    """Of a word in each language: the sums of its trigrams' logs, from dictionaries; the word's edges are symbols."""
    grams = lambda w: [("^" + w.lower() + "$")[max(0, k - 2) : k + 1] for k in range(1, len(w) + 2)]
    tables = {}
    for text, lang in docs:
        table = tables.setdefault(lang, {})
        for w in text.split():
            for g in grams(w):
                table[g] = table.get(g, 0) + 1
    out = []
    for lang in sorted(tables):
        total = sum(tables[lang].values()) + 0.5 * L.BUCKETS
        out.append(sum(math.log((tables[lang].get(g, 0) + 0.5) / total) for g in grams(word)))
    return out


def test_word_scores_against_dictionaries(frame):
    docs = [(EN, "en"), (DE, "de"), (RU, "ru"), (EN, "en")]
    model = L.train(frame([(k, t, x) for k, (t, x) in enumerate(docs)]))
    tested = [*EN.split(), *DE.split(), *"lazier Hunde theß a".split()]
    w = L.words_of([" ".join(tested)])
    got = L.word_scores(w, model)
    close = 0
    for k, word in enumerate(tested):
        plain = plain_scores(word, docs)[:2]  # de and en share a script that ru does not use
        wanted = [max(x - max(plain), -L.MOST) for x in plain]
        close += got[k, :2] == pytest.approx(wanted, abs=1e-4)
        assert got[k, 2] == -L.FOREIGN
    assert close >= len(tested) - 1  # cells are hashes: two trigrams may share one


def test_script_narrows(model):
    w = L.words_of(["abc абв"])
    scores = L.word_scores(w, model)
    assert scores[0, 2] == -L.FOREIGN and scores[1, 2] == 0 and set(scores[1, :2]) == {-L.FOREIGN}
    assert (L.word_scores(L.words_of(["日本"]), model) > -L.FOREIGN).all()  # a script of no language leaves all


def test_long_texts_come_in_pieces(frame, model, monkeypatch):
    draw = random.Random(3)
    texts = [" ".join(draw.choices([EN, DE, RU, "12 ", "\n", "x" * 60], k=30)) for _ in range(5)] + ["1 " * 500, "y" * 400, "é " + " " * 300]
    whole = L._label(texts, model)
    trained = L.train(frame([(k, t, "a") for k, t in enumerate(texts)]))
    monkeypatch.setattr(L, "CHUNK", 100)
    assert [L._label([t], model)[0] for t in texts] == [(x, pytest.approx(s), spans) for x, s, spans in whole]
    again = L.train(frame([(k, t, "a") for k, t in enumerate(texts)]))
    assert (again.scores == trained.scores).all() and (again.uses == trained.uses).all()


def test_nothing_to_learn_from(frame, spark):
    none = L.train(frame([(1, "text", None), (2, None, "en")]))
    assert none is None
    assert L.identify(frame([(1, "text")]), none).first().lang_pred == "und"
    assert L.identify(frame([]), none).count() == 0


def test_query(spark, data):
    got = {r.doc_id: r for r in L.op1_language(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 1]
    assert {d.doc_id for d in held} == {k for k, r in got.items() if r.held_out}
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
