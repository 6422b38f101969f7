import random

import numpy as np
import pytest

from conjunx.llm import url_filter as U


def rule(url, rules=U.RULES):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    end = min((k for k in (rest.find(c) for c in "?#") if k >= 0), default=len(rest))
    path = rest[:end]
    fits = [(len(h + p), h + p, say) for say, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("page_id", "url", "1 host", "'x' path", "2 score", "3 label")


ODD = [None, "", "x", "://", "http://", "http://COM/", "http://com", "http://a.com?q", "http://a.com/#f", "http://Example.COM/en/1?x#y", "http://www.example.com/en/", "http://a.www.example.com/en/z", "http://xexample.com/en/", "https://É.net/es/1", "a://b://c.net/fr/", "http://net/fr", "http://user@h.net:80/es/", "ftp://a.org/en/\n", "http://a.net/fr/" + "y" * 20000]


def test_parts_and_rules(spark):
    got = {r.page_id: r for r in U.judge(pages(spark, ODD)).collect()}
    assert len(got) == len(ODD)
    for k, url in enumerate(ODD):
        host, path, text, say = rule(url)
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, text)
        assert r.verdict == say or (say is None and r.verdict in ("allow", "block"))


def test_model_tells_classes_apart(spark):
    draw = random.Random(1)
    word = lambda letters: "".join(draw.choices(letters, k=8))
    good = lambda tld: f"http://{word('abcd')}.{tld}/{word('abcd')}"
    bad = lambda tld: f"http://{word('wxyz')}.{tld}/{word('wxyz')}"
    rules = (("allow", "com", "/"), ("block", "net", "/"))
    urls = [good("com") for _ in range(300)] + [bad("net") for _ in range(300)] + [good("org") for _ in range(100)] + [bad("org") for _ in range(100)]
    got = {r.page_id: r for r in U.judge(pages(spark, urls), rules=rules).collect()}
    assert all(got[k].verdict == ("allow" if k < 300 else "block") and got[k].rule for k in range(600))
    assert np.mean([got[k].verdict == ("allow" if k < 700 else "block") for k in range(600, 800)]) > 0.97
    again = {r.page_id: r for r in U.judge(pages(spark, urls).repartition(5), rules=rules).collect()}
    assert all(again[k].verdict == got[k].verdict and again[k].score == pytest.approx(got[k].score) for k in got)


def folded(u):
    return "".join("0" if c.isdigit() else c for c in u.lower())


def grams(u):
    padded = "\0" * 5 + u
    return [(padded[k + 5 - n : k + 5], c, n) for k, c in enumerate(u) for n in range(6)]


def exact(train):
    """Scores by plain dictionaries."""
    tables = []
    for urls in train:
        context, gram = {}, {}
        for u in urls:
            for at, c, _ in grams(folded(u)):
                context[at] = context.get(at, 0) + 1
                gram[at, c] = gram.get((at, c), 0) + 1
        tables.append((context, gram))

    def score(text):
        total, p = [0, 0], 0
        for at, c, n in grams(folded(text)):
            p = p if n else [1 / 256] * 2
            p = [(g.get((at, c), 0) + 2 * q) / (x.get(at, 0) + 2) for q, (x, g) in zip(p, tables, strict=True)]
            if n == 5:
                total = [s + np.log(q) for s, q in zip(total, p, strict=True)]
        return (total[0] - total[1]) / len(text)

    return score


@pytest.mark.parametrize("ship", [U.SHIP if hasattr(U, "SHIP") else 0, 20_000, 30])
def test_scores_are_exact_where_a_fixed_table_is_full(spark, monkeypatch, ship):
    """More distinct n-grams than 2^20 cells."""
    monkeypatch.setattr(U, "SHIP", ship, raising=False)
    n = 14_000 if ship > 20_000 else 300
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz-_", k=24))
    urls = [f"http://{word()}.{('com', 'net')[k % 2]}/{word()}" for k in range(n)] + [f"http://{word()}.org/{word()}" for _ in range(40)]
    df = pages(spark, urls)
    apart = {r.url for r in df.selectExpr("url", "pmod(xxhash64(url, 'calibration'), 5) = 0 a").where("a").collect()}
    train = [[u for u in urls[k:n:2] if u not in apart] for k in (0, 1)]
    got = {r.page_id: r.score for r in U.judge(df, rules=(("allow", "com", "/"), ("block", "net", "/"))).collect()}
    if n == 14_000:
        assert len(np.unique(np.concatenate(U._grams([u.encode() for u in urls])[1]))) > 1 << 20
    score = exact(train)
    for k in (0, 1, n, n + 1, n + 2) if n > 300 else range(n - 20, n + 40):
        assert got[k] == pytest.approx(score(urls[k]), abs=1e-9)


def plain_threshold(scored):
    """scored: (score, label).  The middle of the cuts with the least sum of both classes' shares of errors."""
    width = 2 * U.SPAN / (U.BINS - 1)
    bins = [(int((max(-U.SPAN, min(U.SPAN, s)) + U.SPAN) / width), y) for s, y in scored]
    total = [max(1, sum(y == k for _, y in bins)) for k in (0, 1)]
    errors = []
    for cut in range(U.BINS + 1):
        lost = sum(b < cut and y == 0 for b, y in bins) / total[0]
        kept = sum(b >= cut and y == 1 for b, y in bins) / total[1]
        errors.append(lost + kept)
    best = [k for k, e in enumerate(errors) if e <= min(errors) + 1e-12]
    return (best[0] + best[-1]) / 2 * width - U.SPAN


@pytest.mark.parametrize("ship", [1_000_000, 30])
def test_verdicts_against_a_plain_model(spark, monkeypatch, ship):
    """Classes that overlap: counts, smoothing, threshold and verdict by dictionaries and loops."""
    monkeypatch.setattr(U, "SHIP", ship)
    draw = random.Random(11)
    word = lambda letters: "".join(draw.choices(letters, k=draw.randint(2, 6)))
    url = lambda tld: f"http://{word('abcdmnop')}.{tld}/{word('abmnopyz' if tld == 'com' else 'cdmnopwx')}{draw.randint(0, 99)}"
    urls = [url(("com", "net")[k % 2]) for k in range(240)] + [url("org") for _ in range(60)] + ["http://odd.org/É", "x"]
    df = pages(spark, urls)
    apart = {r.url for r in df.selectExpr("url", "pmod(xxhash64(url, 'calibration'), 5) = 0 a").where("a").collect()}
    score = exact([[u for u in urls[k:240:2] if u not in apart] for k in (0, 1)])
    cut = plain_threshold([(score(u), k % 2) for k, u in enumerate(urls[:240]) if u in apart])
    got = {r.page_id: r for r in U.judge(df, rules=(("allow", "com", "/"), ("block", "net", "/"))).collect()}
    for k in [*range(240, 300), 301]:
        assert got[k].score == pytest.approx(score(urls[k]), abs=1e-9)
        assert got[k].verdict == ("block" if got[k].score < cut else "allow")
    assert {got[k].verdict for k in range(240, 300)} == {"allow", "block"}


def test_one_class_only_or_none(spark):
    got = U.judge(pages(spark, ["http://a.com/x", "http://b.org/", None])).collect()
    assert [r.verdict for r in got] == ["allow"] * 3
    assert U.judge(pages(spark, ["x"]).limit(0)).count() == 0


def test_query(spark, data):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = U.op10_urls(spark, data).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, text, say = rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, text) and (say is None or r.verdict == say)
