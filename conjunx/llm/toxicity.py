"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; the unlabelled texts are drawn from all that have a label, whatever
it says.  A linear classifier is trained in numpy on the risk estimator corrected by the class prior,

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]),

where a mini-batch whose negative part is below zero steps against it.  Features are words and their beginnings
of 4 to 7 letters that are commoner in positives than chance allows: whether a text has one, and how often.

Training reads at most about ``POSITIVES`` confirmed and ``UNLABELLED`` other labelled rows (a hash decides which).
Executors count and select the features and turn texts into them; the driver sees features, no texts.
"""

from __future__ import annotations

import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunx.llm.common import cut, id_bucket, mapped, pick, small, table

POSITIVES, UNLABELLED = 3000, 9000
#: Features, the least positives that have one, and how many standard deviations above chance that must be.
FEATURES, LEAST, ABOVE = 1000, 3, 6.0
BEGINNINGS = (4, 5, 6, 7)
#: Steps of training, texts of each kind in a step, step size, and the weight decay times the number of positives.
STEPS, BATCH, RATE, DECAY = 1500, 512, 0.03, 0.5
#: A text's words that a worker remembers the features of.
REMEMBERED = 500_000

_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    place: dict[str, int]
    weights: np.ndarray  # of presence, then of frequency
    bias: float


def _names(word: str) -> list[str]:
    """The features that a word may be: itself, and its beginnings."""
    return [f"{word}.", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def _occurrences(texts: list[str], place: dict[str, int], known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which text has which feature, and log(1 + how often in 200 words), by text and feature."""
    width, owner, flat, n_words = max(1, len(place)), [], [], []
    for t in texts:
        words = _WORD.findall(t.lower())
        if new := set(words).difference(known):
            if len(known) >= REMEMBERED:
                known.clear()
                new = set(words)
            known.update((w, tuple(place[x] for x in _names(w) if x in place)) for w in new)
        found = list(chain.from_iterable(map(known.__getitem__, words)))
        flat += found
        owner.append(len(found))
        n_words.append(len(words))
    pair, count = np.unique(np.repeat(np.arange(len(texts)), owner) * width + np.array(flat, np.int64), return_counts=True)
    text, feature = pair // width, pair % width
    return text, feature, np.log1p(200 * count / np.array(n_words, np.int64)[text])


def _spread(texts: list[str], positive: list[bool], other: list[bool]) -> dict[str, list[int]]:
    """In how many positive and how many unlabelled texts each feature is."""
    out: dict[str, list[int]] = {}
    for t, p, u in zip(texts, positive, other, strict=True):
        for x in {x for w in set(_WORD.findall(t.lower())) for x in _names(w)}:
            n = out.setdefault(x, [0, 0])
            n[0] += p
            n[1] += u
    return out


def select(rows: DataFrame) -> dict[str, int]:
    """The features, numbered: those most above chance in positives, the first ``FEATURES`` of them.  ``rows``: text, p, u."""

    def run(batches):
        for batch in small(batches):
            found = _spread(*(batch.column(c).to_pylist() for c in ("text", "p", "u")))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array((n[0] for n in found.values()), pa.int64()), pa.array((n[1] for n in found.values()), pa.int64())], names=["name", "p", "u"])

    n_p, n_u = rows.agg(F.coalesce(F.sum(F.col("p").cast("int")), F.lit(0)), F.coalesce(F.sum(F.col("u").cast("int")), F.lit(0))).first()
    if not n_p or not n_u:
        return {}
    spread = mapped(rows.select("text", "p", "u"), run, "name string, p long, u long").groupBy("name").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    expected = (F.col("u") + 1) * (n_p / n_u)
    above = spread.where(F.col("p") >= LEAST).select("name", ((F.col("p") - expected) / F.sqrt(expected)).alias("z")).where(F.col("z") >= ABOVE)
    return {r.name: k for k, r in enumerate(above.orderBy(F.desc("z"), "name").limit(FEATURES).collect())}


def vectors(rows: DataFrame, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The positives' and the unlabelled texts' features: presence, then frequency.  Order does not depend on that of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def run(batches):
        known: dict[str, tuple[int, ...]] = {}
        for batch in small(batches):
            text, feature, often = _occurrences(batch.column("text").to_pylist(), shared.value, known)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("u"), lists(feature, pa.int32()), lists(often, pa.float32())], names=["p", "u", "feature", "often"])

    found = mapped(rows.select("text", "p", "u"), run, "p boolean, u boolean, feature array<int>, often array<float>").toArrow().to_pylist()
    found.sort(key=lambda r: (r["feature"], r["often"]))
    out = []
    for kind in ("p", "u"):
        own = [r for r in found if r[kind]]
        x = np.zeros((len(own), 2 * len(place)), np.float32)
        for row, r in zip(x, own, strict=True):
            at = np.array(r["feature"], np.int64)
            row[at], row[len(place) + at] = 1, r["often"]
        out.append(x)
    return out[0], out[1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, b: float, x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive and the negative part of the risk of positives ``x`` and unlabelled ``y``."""
    zp, zu = x @ w + b, y @ w + b
    return float(prior * np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def slope(w: np.ndarray, b: float, x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """The direction of a step, by weight and for the bias: the gradient of the risk; where its negative part is below zero the model fits
    the sample too well, and it is that part's gradient turned round."""
    sp, su = _sigmoid(x @ w + b), _sigmoid(y @ w + b)
    positive, negative, other = -prior * (1 - sp) / len(x), -prior * sp / len(x), su / len(y)
    if risk(w, b, x, y, prior)[1] < 0:
        return -np.append(x.T @ negative + y.T @ other, negative.sum() + other.sum())
    return np.append(x.T @ (positive + negative) + y.T @ other, (positive + negative).sum() + other.sum())


def fit(x: np.ndarray, y: np.ndarray, prior: float, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias, by Adam over mini-batches of positives ``x`` and unlabelled ``y``."""
    draw = np.random.default_rng(seed)
    w, b, decay = np.zeros(x.shape[1], np.float32), float(np.log(prior / (1 - prior))), DECAY / len(x)
    mean, square = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for step in range(1, STEPS + 1):
        p, u = x[draw.integers(len(x), size=BATCH)], y[draw.integers(len(y), size=BATCH)]
        g = slope(w, b, p, u, prior).astype(np.float32)
        if risk(w, b, p, u, prior)[1] >= 0:
            g[:-1] += decay * w
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def sample(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[DataFrame, float]:
    """Rows of confirmed examples and of unlabelled texts (text, p, u: a row may be both), and the class prior: the
    confirmed share of labelled ids.

    An id counts as confirmed if any of its labels is 1; a null label is none.  Ids of bounded number are broadcast,
    their rows written.  A null text is no example.
    """
    known = pick(labels, id=doc_id, y=label).where("id is not null and y is not null").groupBy("id").agg(F.max((F.col("y") == 1).cast("int")).alias("y"))
    n, n_positive = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    part = lambda salt, share: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000)
    p = (F.col("y") == 1) & part("positive", min(1.0, positives / max(1, n_positive)))
    ids = known.select("id", p.alias("p"), part("unlabelled", min(1.0, unlabelled / max(1, n))).alias("u")).where("p or u")
    rows = pick(docs, doc_id=doc_id, text=text).where("text is not null")
    rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("text", "p", "u")
    return cut(rows), min(0.9, max(0.001, n_positive / max(1, n)))


def train(docs: DataFrame, labels: DataFrame, **options) -> Model | None:
    """The classifier, with the options of ``sample``; None without positives or unlabelled texts."""
    rows, prior = sample(docs, labels, **options)
    place = select(rows)
    x, y = vectors(rows, place)
    return Model(place, *fit(x, y, prior)) if len(x) and len(y) else None


def score(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """``docs`` with tox_score, the estimated probability of toxicity; the prior's where a text has no feature,
    also for null and empty ones; 0 without a model.  A column of that name is replaced.  No shuffle."""
    docs = docs.drop("tox_score")
    own = docs.columns
    plain, at = docs.toDF(*(f"c{k}" for k in range(len(own)))), own.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, known = shared.value, {}
        for batch in small(batches):
            out = np.zeros(batch.num_rows)
            if m:
                text, feature, often = _occurrences([t or "" for t in batch.column(at).to_pylist()], m.place, known)
                given = (m.weights[feature] + m.weights[len(m.place) + feature] * often) if len(text) else often
                out = _sigmoid(m.bias + np.bincount(text, weights=given, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "tox_score"])

    return mapped(plain, run, plain.withColumn("tox_score", F.lit(0.0)).schema).toDF(*own, "tox_score")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document: whether it is held out, its score, and 1 if that is at least 0.3."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    held_out = id_bucket("doc_id", 4) == 2
    seen = docs.where(~held_out)
    model = train(seen, table(spark, sf_dir, "labels").where(~held_out))
    found = score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.3).cast("int").alias("predicted"))
