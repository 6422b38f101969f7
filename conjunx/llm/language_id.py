"""Language identification by word: script ranges, character-trigram scores, Viterbi with a switching penalty.

A word's script narrows its candidates to the languages that use the script in training; each candidate is
scored by the trigrams of the word and its edges; Viterbi over a document's words, with a penalty for each
switch, labels spans.  The document's language is the one with the most letters in its spans.

Training counts trigrams of at most about ``SAMPLE`` labelled documents a language (a hash decides which), in
``BUCKETS`` hashed cells, so that the model has a fixed size for each language.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from conjunx.llm.common import id_bucket, mapped, pick, pieces, small, table

#: Labelled documents a language that training reads, about.
SAMPLE = 2000
BUCKETS = 1 << 16
#: What a switch of language costs, and the most that one word can count against a language, in nats.
SWITCH, MOST = 8.0, 6.0
#: What a word costs in a language that does not use its script.
FOREIGN = 20.0
#: A language uses a script that has at least this share of its letters.
USES = 0.01
#: Characters that are looked at together; a longer text is looked at piece by piece.
CHUNK = 400_000

#: Ranges of code points by script; what is in none is of the script 0.
SCRIPTS = (
    ("latin", ((0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF))),
    ("greek", ((0x0370, 0x03FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF))),
    ("armenian", ((0x0530, 0x058F),)),
    ("hebrew", ((0x0590, 0x05FF),)),
    ("arabic", ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x0900, 0x097F),)),
    ("bengali", ((0x0980, 0x09FF),)),
    ("tamil", ((0x0B80, 0x0BFF),)),
    ("thai", ((0x0E00, 0x0E7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
)


class Words(NamedTuple):
    """The words of some texts in a row: which text, first and last place in it, letters, script, trigram cells."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    cells: np.ndarray
    first: np.ndarray


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 for a letter and 2 for a mark, the lower case, the script."""
    n = sys.maxunicode + 1
    kind, lower, script = np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8)
    for c in range(n):
        if (x := chr(c)).isalpha():
            kind[c] = 1
            if len(y := x.lower()) == 1:
                lower[c] = ord(y)
        elif c > 0x2FF and unicodedata.category(x)[0] == "M":
            kind[c] = 2
    for k, (_, ranges) in enumerate(SCRIPTS, 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return kind, lower, script


def words_of(texts: list[str]) -> Words:
    """A word is a letter and the letters and marks after it; marks that no letter comes before are in none."""
    kinds, lower, scripts = _tables()
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    kind, place = kinds[raw], np.arange(1, len(raw) + 1, dtype=np.int32)
    inside = (kind > 0) & (np.maximum.accumulate(np.where(kind == 1, place, 0)) > np.maximum.accumulate(np.where(kind == 0, place, 0)))
    edges = np.diff(np.concatenate(([0], inside.view(np.int8))))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep = np.flatnonzero(inside | (np.concatenate(([False], inside[:-1]))))  # the words, each with one place after it
    code = np.where(inside[keep], lower[raw[keep]], 0).astype(np.uint64)
    one = np.concatenate(([0], code[:-1])).astype(np.uint64)
    two = np.where(one == 0, 0, np.concatenate(([0, 0], code[:-2]))[: len(code)]).astype(np.uint64)
    mixed = ((two * np.uint64(1_000_003) + one) * np.uint64(1_000_003) + code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    cells = ((mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(np.int32)
    sizes = end - start + 1
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    text = np.searchsorted(ends, start, side="right")
    base = (ends - np.fromiter(map(len, texts), np.int64, len(texts)) - 1)[text]
    return Words(text, start - base, end - base, sizes - 1, scripts[raw[start]], cells, np.cumsum(sizes) - sizes)


class Model(NamedTuple):
    langs: list[str]
    scores: np.ndarray  # trigram cell x language: log probability
    uses: np.ndarray  # script x language


def _chunks(texts: list[str]) -> list[list[int]]:
    """Places of texts, of like length together, in lists of about CHUNK characters."""
    out, size = [[]], 0
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
        if out[-1] and size + len(texts[k]) > CHUNK:
            out.append([])
            size = 0
        out[-1].append(k)
        size += len(texts[k]) + 1
    return out


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """A model of the non-null values of ``lang``; None if there is no labelled text."""
    rows = pick(docs, doc_id=doc_id, text=text, lang=lang).where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return None
    langs = sorted(counts)
    share = F.element_at(F.map_from_arrays(F.array(*(F.lit(x) for x in langs)), F.array(*(F.lit(min(1.0, sample / counts[x])) for x in langs))), F.col("lang"))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    place = {x: k for k, x in enumerate(langs)}
    width = BUCKETS + 256  # trigram cells, then scripts

    def run(batches):
        total = np.zeros((len(langs), width), np.int64)
        for batch in small(batches):
            both = [(x, place[lang]) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) for _, x in pieces(t, CHUNK)]
            texts, own = [x for x, _ in both], [k for _, k in both]
            for part in _chunks(texts):
                w = words_of([texts[k] for k in part])
                if not len(w.text):
                    continue
                who = np.array([own[k] for k in part])[w.text]
                each = np.repeat(who, w.letters + 1)
                for k in np.unique(who):
                    total[k, :BUCKETS] += np.bincount(w.cells[each == k], minlength=BUCKETS)
                    total[k, BUCKETS:] += np.bincount(w.script[who == k], weights=w.letters[who == k], minlength=256).astype(np.int64)
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["cell", "n"])

    found = mapped(rows, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(langs) * width, np.int64)
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    total = total.reshape(len(langs), width).T
    grams, letters = total[:BUCKETS] + 0.5, total[BUCKETS:]
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), letters >= USES * np.maximum(1, letters.sum(axis=0)))


def word_scores(w: Words, model: Model) -> np.ndarray:
    """Word x language: 0 for the best candidate, else how much worse, but for foreign scripts at most MOST."""
    scores = np.stack([np.add.reduceat(model.scores[w.cells, k], w.first) for k in range(len(model.langs))], axis=1)
    uses = model.uses[w.script]
    uses |= ~uses.any(axis=1, keepdims=True)
    best = np.where(uses, scores, -np.inf).max(axis=1, keepdims=True)
    return np.where(uses, np.maximum(scores - best, -MOST), -FOREIGN)


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best language of each word; the words of text k are scores[starts[k]:][:sizes[k]], texts in a row.

    All texts go a word at a time, longest first; scores are laid out by time, so that a step is a slice."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), side="right")
    begin = np.concatenate(([0], np.cumsum(active)))
    place = begin[np.arange(len(scores)) - np.repeat(starts, sizes)] + np.repeat(rank, sizes)
    by_time = np.empty_like(scores)
    by_time[place] = scores
    back = np.empty(scores.shape, np.uint8 if scores.shape[1] < 256 else np.int32)
    own = np.arange(scores.shape[1], dtype=back.dtype)
    value = np.zeros((len(sizes), scores.shape[1]))
    steps = list(zip(active.tolist(), begin[:-1].tolist(), strict=True))
    for k, at in steps:
        v = value[:k]
        jump = v.max(axis=1, keepdims=True) - SWITCH
        back[at : at + k] = np.where(v >= jump, own, v.argmax(axis=1)[:, None])
        np.maximum(v, jump, out=v)
        v += by_time[at : at + k]
    now = value.argmax(axis=1)
    label = np.empty(len(scores), np.int64)
    rows = np.arange(len(sizes))
    for k, at in reversed(steps):
        label[at : at + k] = now[:k]
        now[:k] = back[at : at + k][rows[:k], now[:k]]
    return label[place]


def _long(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, letters and languages of the words of a text that is looked at piece by piece: as ``viterbi``, the values
    carried on from piece to piece, only the choices kept."""
    n_langs = len(model.langs)
    value, own = np.zeros(n_langs), np.arange(n_langs)
    found, choices = [np.zeros((3, 0), np.int64)], [np.zeros((0, n_langs), np.int32)]
    for offset, piece in pieces(text, CHUNK):
        w = words_of([piece])
        if not len(w.text):
            continue
        found.append(np.stack((w.start + offset, w.end + offset, w.letters)))
        scores, back = word_scores(w, model), np.empty((len(w.text), n_langs), np.uint8 if n_langs < 256 else np.int32)
        for k in range(len(scores)):
            jump = value.max() - SWITCH
            back[k] = np.where(value >= jump, own, value.argmax())
            value = np.maximum(value, jump) + scores[k]
        choices.append(back)
    start, end, letters = np.concatenate(found, axis=1)
    label, at, now = np.empty(len(start), np.int64), len(start), int(value.argmax())
    for back in reversed(choices):
        for k in range(len(back) - 1, -1, -1):
            at -= 1
            label[at] = now
            now = int(back[k, now])
    return start, end, letters, label


def _label(texts: list[str], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Of each text: language, share of its letters, and spans (start, end, language)."""
    if len(texts) == 1 and len(texts[0]) > CHUNK:
        start, end, sizes, label = _long(texts[0], model)
        text = np.zeros(len(start), np.int64)
    else:
        w = words_of(texts)
        text, start, end, sizes = w.text, w.start, w.end, w.letters
        n_words = np.bincount(text, minlength=len(texts))
        some = np.flatnonzero(n_words)
        label = viterbi(word_scores(w, model), (np.cumsum(n_words) - n_words)[some], n_words[some]) if len(text) else text
    out: list = [("und", 0.0, [])] * len(texts)
    if not len(text):
        return out
    letters = np.bincount(text * len(model.langs) + label, weights=sizes, minlength=len(texts) * len(model.langs)).reshape(len(texts), -1)
    begin = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (label[1:] != label[:-1]))))
    stop = np.concatenate((begin[1:], [len(label)])) - 1
    spans: dict[int, list] = {}
    for k, a, b, x in zip(text[begin].tolist(), start[begin].tolist(), end[stop].tolist(), label[begin].tolist(), strict=True):
        spans.setdefault(k, []).append((a, b, model.langs[x]))
    for k, own in spans.items():
        best = int(letters[k].argmax())
        out[k] = model.langs[best], float(letters[k, best] / letters[k].sum()), own
    return out


def identify(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_spans (start, stop, lang; code points, stop exclusive).

    ``und``, score 0 and no spans for a null text, one without letters, or without a model.  The score is the
    share of letters in spans of lang_pred; of languages with equally many letters the first in code point order
    is taken.  Columns of ``docs`` with these names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_spans")
    extra = "lang_pred string, lang_score double, lang_spans array<struct<start:int,stop:int,lang:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in small(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found: list = [("und", 0.0, [])] * len(texts)
            for part in _chunks(texts) if shared.value else []:
                for k, x in zip(part, _label([texts[k] for k in part], shared.value), strict=True):
                    found[k] = x
            spans = pa.array([[{"start": a, "stop": b, "lang": x} for a, b, x in s] for _, _, s in found], kind)
            new = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_spans"])

    own = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(own))))
    schema = StructType([*plain.schema, *docs.sparkSession.createDataFrame([], extra).schema])
    return mapped(plain, run, schema).toDF(*own, "lang_pred", "lang_score", "lang_spans")


def op1_language(spark, sf_dir: str) -> DataFrame:
    """Per document: whether it is held out, its predicted language and the score."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    held_out = id_bucket("doc_id", 3) == 1
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), train(docs.where(~held_out)))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
