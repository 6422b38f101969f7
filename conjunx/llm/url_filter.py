"""URL filtering: rules first, else the ratio of two character language models, of accepted and rejected URLs.

The models are variable-order Markov models over bytes, orders 0 to ``ORDER``, each order smoothed towards the one
below it.  Counts come from all URLs that a rule decides, as labelled by it; every fifth (by a hash) is kept for
calibration.  Counts are exact, in a table keyed by order, context and byte, which fit a long, and grow with the
input.  Up to ``SHIP`` n-grams are sent to every task; of more, those of the most frequent contexts are, and the
others are joined to the URLs that have their contexts.  A URL's score is the log-likelihood difference a byte; the threshold is the one
with the least mean error of both classes on the calibration URLs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conjunx.llm.common import cut, mapped, pick, small, table, utf8

ORDER = 5
#: N-grams that are sent to every task, some 100 MB there.
SHIP = 1_000_000
#: What tells a context's key from a gram's.
CONTEXT = 1 << 60
#: Weight, in observations, of the next lower order.
STRENGTH = 2.0
#: Bins of the calibration histogram over scores from -SPAN to SPAN.
BINS, SPAN = 4001, 8.0

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower case; every digit is one symbol; 0 is the start symbol and does not occur otherwise.
_FOLD = bytes(48 if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c or 1 for c in range(256))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, as text, and its verdict; null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text, verdict = F.when(fits, host + path).otherwise(text), F.when(fits, say).otherwise(verdict)
    return text, verdict


class _Model(NamedTuple):
    """Counts n (class, gram) of the sorted ``grams`` that are sent to tasks; a table of the others, if there are any."""

    grams: np.ndarray
    n: np.ndarray
    far: DataFrame | None


def _grams(urls: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For the bytes of ``urls`` in a row: where each URL starts, for each order the keys (order, context, byte) of
    its n-grams, whose eighth bits and up are the context's, and the URLs' lengths."""
    pad = b"\0" * ORDER
    raw = np.frombuffer(b"".join(pad + u.translate(_FOLD) for u in urls), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, urls), np.int64, len(urls))
    begin = np.cumsum(sizes + ORDER) - sizes
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    here, context, out = raw[at], np.zeros(len(at), np.int64), []
    for n in range(ORDER + 1):
        if n:
            context = context | raw[at - n] << 8 * (n - 1)
        out.append((n << 48) | context << 8 | here)
    return np.cumsum(sizes) - sizes, out, sizes


def _cells(urls: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """As ``_grams``, with the places of contexts and of grams in the sorted ``keys``, or the place after the last."""
    starts, grams, sizes = _grams(urls)

    def cell(key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, key)
        return np.where(keys[np.minimum(at, len(keys) - 1)] == key, at, len(keys))

    return starts, [(cell(g >> 8 | CONTEXT), cell(g)) for g in grams], sizes


def _table(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of grams and their contexts, and counts (class, context or gram, place), with a place for none."""
    context, first = np.unique(grams >> 8, return_index=True)
    counts = np.zeros((2, 2, len(grams) + len(context) + 1), np.int64)
    counts[:, 1, : len(grams)] = n
    if len(grams):
        counts[:, 0, len(grams) : -1] = np.add.reduceat(n, first, axis=1)
    return np.concatenate((grams, context | CONTEXT)), counts


def _counted(urls: DataFrame) -> _Model | None:
    """The model from url and label (0 accepted, 1 rejected); none if one label has no n-grams."""

    def run(batches):
        for batch in small(batches):
            label = batch.column("label").to_numpy(zero_copy_only=False)
            texts = utf8(batch.column("url"))
            for k in (0, 1):
                gram, n = np.unique(np.concatenate(_grams([texts[i] for i in np.flatnonzero(label == k)])[1]), return_counts=True)
                none = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(none if k else n), pa.array(n if k else none)], names=["gram", "n0", "n1"])

    counted = cut(mapped(urls, run, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    total = counted.agg(F.count("*").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not total.n0 or not total.n1:
        return None
    near, far = counted, None
    if total.n > SHIP:
        counted = counted.withColumn("context", F.shiftright("gram", 8))
        often = counted.groupBy("context").agg(F.floor(F.log2(F.sum(F.col("n0") + F.col("n1")))).cast("int").alias("level"), F.count("*").alias("n"))
        often = cut(often)
        level, sent = 64, 0
        for r in sorted(often.groupBy("level").agg(F.sum("n").alias("n")).collect(), reverse=True):
            if (sent := sent + r.n) > SHIP:
                break
            level = r.level
        both = cut(counted.join(often.select(F.col("context").alias("c"), "level"), F.col("context") == F.col("c")))
        near = both.where(F.col("level") >= level)
        far = cut(both.where(F.col("level") < level).groupBy("context").agg(F.collect_list(F.struct("gram", "n0", "n1")).alias("grams")))
    found = near.select("gram", "n0", "n1").toArrow().sort_by("gram")
    return _Model(found["gram"].to_numpy(), np.stack((found["n0"].to_numpy(), found["n1"].to_numpy())), far)


def _score(urls: list[bytes], counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Log-likelihood difference a byte, accepted less rejected; 0 for an empty URL."""
    starts, cells, sizes = _cells(urls, keys)
    if not sizes.sum():
        return np.zeros(len(urls))
    logs = []
    for k in (0, 1):
        p = np.full(sizes.sum(), 1 / 256)
        for context, gram in cells:
            p = (counts[k, 1][gram] + STRENGTH * p) / (np.maximum(counts[k, 0][context], counts[k, 1][gram]) + STRENGTH)
        logs.append(np.log(p))
    some = sizes > 0
    out = np.zeros(len(urls))
    out[some] = np.add.reduceat(logs[0] - logs[1], starts[some]) / sizes[some]
    return out


def _scored(df: DataFrame, model: _Model) -> DataFrame:
    """``df`` with score, from its column url."""
    shared = df.sparkSession.sparkContext.broadcast((model.grams, model.n))
    schema = df.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        keys, counts = _table(*shared.value)
        for batch in small(batches):
            texts = [t or b"" for t in utf8(batch.column("url"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_score(texts, counts, keys), pa.float64())], names=[*batch.schema.names, "score"])

    if model.far is None:
        return mapped(df, run, schema)

    def wanted(batches):
        context = np.unique(shared.value[0] >> 8)
        for batch in small(batches):
            starts, grams, sizes = _grams(utf8(batch.column("url")))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pair = np.unique(np.stack((np.tile(owner, ORDER + 1), np.concatenate(grams) >> 8), 1), axis=0)
            pair = pair[~np.isin(pair[:, 1], context)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(pair[:, 0])), pa.array(pair[:, 1])], names=["id", "wanted"])

    def run_far(batches):
        grams, n = shared.value
        for batch in small(batches):
            texts = [t or b"" for t in utf8(batch.column("url"))]
            more = batch.column("_far").flatten().flatten()  # the same grams may come with several URLs
            own, first = np.unique(more.field("gram").to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
            all_, both = np.concatenate((grams, own)), np.concatenate((n, np.stack([more.field(c).to_numpy(zero_copy_only=False).astype(np.int64)[first] for c in ("n0", "n1")])), 1)
            order = np.argsort(all_, kind="stable")
            keys, counts = _table(all_[order], both[:, order])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_score(texts, counts, keys), pa.float64())], names=[*batch.schema.names[:-1], "score"])

    urls = df.where("url is not null").select("url").distinct().select(F.xxhash64("url").alias("id"), "url")
    found = mapped(urls, wanted, "id long, wanted long").join(model.far, F.col("wanted") == F.col("context"))
    found = found.groupBy("id").agg(F.collect_list("grams").alias("_far"))
    return mapped(df.join(found, F.xxhash64("url") == F.col("id"), "left").select(*df.columns, "_far"), run_far, schema)


def _threshold(scored: DataFrame) -> float:
    """The score below which a URL is blocked: least mean error of both classes, the middle of the best range."""
    place = F.floor((F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), "score")) + SPAN) * ((BINS - 1) / (2 * SPAN))).cast("int")
    n = np.zeros((2, BINS))
    for r in scored.groupBy("label", place.alias("place")).count().toArrow().to_pylist():
        n[r["label"], r["place"]] = r["count"]
    total = np.maximum(n.sum(axis=1), 1)
    accepted_lost = np.concatenate(([0], np.cumsum(n[0]))) / total[0]  # at cut k: bins below k are blocked
    rejected_kept = 1 - np.concatenate(([0], np.cumsum(n[1]))) / total[1]
    error = accepted_lost + rejected_kept
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 * (2 * SPAN / (BINS - 1)) - SPAN)


def judge(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (accepted less rejected log-likelihood a byte).

    ``rules``: (allow or block, host, path); few.  A rule's verdict holds; every other URL is blocked if its
    score is below the calibrated threshold.  If no rule gives accepted, or none gives rejected URLs, nothing is
    known of one class and the rest is allowed.  A null or empty URL has score 0.  Equal URLs get equal
    verdicts.  No rows in, no rows out.
    """
    text, verdict = rule_for(rules)
    rows = pick(pages, page_id=page_id, url=url).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("rule", text).withColumn("ruled", verdict)
    known = rows.where("ruled is not null and url is not null").select("url", (F.col("ruled") == "block").cast("int").alias("label"))
    apart = F.pmod(F.xxhash64("url", F.lit("calibration")), F.lit(5)) == 0
    if (model := _counted(known.where(~apart))) is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    cut_at = _threshold(_scored(known.where(apart), model))
    judged = _scored(rows, model)
    own = F.when(F.col("score") < cut_at, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


def op10_urls(spark, sf_dir: str) -> DataFrame:
    """Per page: host, path, the rule that fits if any, and the verdict."""
    return judge(table(spark, sf_dir, "pages"))
