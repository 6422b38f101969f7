import bisect
import hashlib
import re
from zlib import crc32

import numpy as np
import pytest
import xxhash

from conjunx.llm import spotsigs as S
from conjunx.llm.decontaminate import words


def chains(text):
    """The signatures as tuples of words."""
    parts = [w.decode() for w in words(text.encode())]
    out = set()
    for k, w in [(-1, ""), *enumerate(parts)]:
        if k < 0 or w in S.ANCHORS:
            rest = [x for x in parts[k + 1 :] if x not in S.ANCHORS][: S.CHAIN]
            if len(rest) == S.CHAIN:
                out.add((w, *rest))
    return out


def test_one_signature_for_each_chain(spark, data):
    for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect():
        if chains(r.text):
            assert len(S.signatures(r.text)) == len(chains(r.text))


def test_likeness():
    a, b = "the red fox and a grey wolf of old times", "the red fox and a grey wolf of new times"
    x, y = chains(a), chains(b)
    assert S.likeness(S.signatures(a), S.signatures(b)) == pytest.approx(len(x & y) / len(x | y))
    none = np.empty(0, np.uint32)
    assert S.likeness(none, none) == 1 and S.likeness(none, S.signatures(a)) == 0 and S.likeness(S.signatures(a), S.signatures(a)) == 1
    assert S.likeness(S.signatures(a), S.signatures(a)[:1], 0.9) == 0


def test_fallbacks():
    assert len(S.signatures("")) == 0
    assert S.signatures("the alpha of").tolist() == sorted(map(crc32, (b"the", b"alpha", b"of"))) and len(S.signatures("alpha beta")) == 1
    assert len(S.signatures("!!!")) == 1 and S.signatures("!!!").tolist() != S.signatures("??").tolist()


def plain_signatures(text):
    """The set of 32-bit signatures, by plain loops."""
    most = 2**64 - 1
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    parts = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    if not parts:
        return {crc32(text.encode())} if text else set()
    out, content = set(), [k for k, w in enumerate(parts) if w not in S.ANCHORS]
    for k in range(-1, len(parts)):
        if k >= 0 and parts[k] not in S.ANCHORS:
            continue
        after = bisect.bisect(content, k)
        chain = [parts[j] for j in content[after : after + 2]]
        if len(chain) < 2:
            continue
        h = 1 << 32 if k < 0 else crc32(parts[k].encode())
        for w in chain:
            h = (h * 0x9E3779B97F4A7C15 & most) ^ crc32(w.encode())
            h ^= h >> 31
        out.add((h * 0xC2B2AE3D27D4EB4F & most) >> 32)
    return out or {crc32(w.encode()) for w in parts}


def plain_likeness(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def plain_text(x):
    return "".join(f"{v:08x}" for v in sorted(x))


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, int(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).view(np.int64)))
    ordered = sorted(rows, key=key, reverse=True)
    out = []
    for k, (key, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        sig, other, far = map(plain_signatures, (text, new, after))
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), plain_text(sig), plain_text(other), plain_likeness(sig, other), plain_likeness(sig, far)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(map(tuple, S.op9_fingerprint(spark, data).collect()), key=str) == brute(rows)


def test_one_id_is_split(spark, frame):
    """Rows of one id, or of none, are dealt to several ranges; texts that are ids are ranged as well."""
    for ids, kind in (([5] * 400, "long"), ([None] * 400, "long"), ([f"doc-{k % 7}" for k in range(400)], "string")):
        rows = S.with_next(frame([(i, f"the text of row{k}") for k, i in enumerate(ids)], f"doc_id {kind}, text string"), 8)
        found = rows.where("copy = 0").groupBy("part").count().collect()
        assert len(found) >= 7 and max(r["count"] for r in found) < 150


def test_ids_that_are_text(spark, frame, folder):
    rows = [("b", "the x y of z w"), ("a", "one"), ("ab", None), (None, "the q r"), ("é", "of a b"), ("a", "two")]
    got = S.op9_fingerprint(spark, folder(documents=frame(rows, "doc_id string, text string", clash=True)))
    order = [("é", "of a b"), ("b", "the x y of z w"), ("ab", "")]
    assert sorted(r.doc_id or "" for r in got.collect()) == sorted(r[0] or "" for r in rows)
    by = {r.doc_id: r for r in got.collect() if r.doc_id in ("é", "b", "ab")}
    for (key, text), (_, after) in zip(order, order[1:], strict=False):
        assert by[key].near_next == plain_likeness(plain_signatures(text), plain_signatures(after))


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "only one text of the world")],
        [(3, None), (1, ""), (2, "a b c d é😀"), (None, "the null id"), (7, "x " * 100000)],
        [(5, "b b"), (5, "a the x y"), (5, "b b"), (4, "zz"), (9, "q")],
        [(None, "first of nulls"), (None, "second of nulls")],
        [(k, f"the word{k} of text number{k}") for k in range(-20, 60)],
    ],
)
def test_edges(spark, frame, folder, rows):
    got = S.op9_fingerprint(spark, folder(documents=frame(rows, "doc_id long, text string", clash=True)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark, frame, folder):
    assert S.op9_fingerprint(spark, folder(documents=frame([]))).count() == 0
    assert S.fingerprints(frame([(1, None)])).first().signatures == []


def test_classes_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(map(tuple, S.spotsigs_classes(spark, data).collect()), key=str) == brute_classes(rows, 0.8)


def brute_classes(rows, similarity):
    sets = [plain_signatures(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x == y or (x and y and len(x & y) / len(x | y) >= similarity):
                parent[find(a)] = find(b)
    groups = {}
    for k, (key, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(key)
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((key, least[find(k)]) for k, (key, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("part_rows", [20000, 7])
def test_classes_against_brute_force(spark, frame, monkeypatch, part_rows):
    import random

    monkeypatch.setattr(S, "PART_ROWS", part_rows)
    draw = random.Random(4)
    word = lambda: draw.choice(["the", "of", "and"]) if draw.random() < 0.3 else "".join(draw.choices("abcde", k=4))
    texts = []
    for _ in range(12):
        text = [word() for _ in range(draw.randint(5, 150))]
        for _ in range(draw.randint(1, 9)):
            text = list(text)
            for _ in range(draw.randint(0, 4)):
                text[draw.randrange(len(text))] = word()
            texts.append(" ".join(text))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (None, texts[0]), (3, texts[3]), (950, "the " * 50000)]
    for similarity in (0.8, 0.5):
        got = S.classes(frame(rows, "doc_id long, text string", clash=True), similarity=similarity)
        assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows, similarity)
    assert S.classes(frame([])).count() == 0
