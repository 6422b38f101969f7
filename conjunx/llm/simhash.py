"""SimHash fingerprints, and near-duplicates among them by covering locality-sensitive hashing.

``near_duplicates`` links documents whose fingerprints of word shingles are within a radius.  ``drop_copies`` is
the stage for corpora: its fingerprints are of single words weighted by 1 + log(count), several with different
seeds, which stay within the radius for texts that share most of their five-word shingles; documents so connected
are then compared by the sets of those shingles, and only pairs alike make groups.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conjunx.llm import covering
from conjunx.llm.common import cut, mapped, pick, session_parts, small, table, utf8
from conjunx.llm.components import stars

SEED = 42
#: Words whose bits are summed together, few enough for exact sums in single precision.
TOGETHER = 1 << 12
#: A component of more shingles is split into parts, and every pair of parts is looked at by itself.
PART_SHINGLES = 700_000
#: Nodes of a component of several parts that are compared with all others, and how many of these are broadcast at most.
PIVOTS, MOST_PIVOTS = 8, 4000
#: Ids of copies are broadcast up to this number of rows, some 80 MB.
BROADCAST_ROWS = 2_000_000


def shingles(text: bytes, size: int) -> list[bytes]:
    """Runs of ``size`` words, joined by a space, repeats included; the whole sequence if there are fewer."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))


def _bits(h: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, the highest first."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none, as a signed long."""
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        total += _bits(h[k : k + 65536]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h)).view(">u8")[0].astype(np.uint64).view(np.int64))


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = h + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 2**64 - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def weighted(texts: list[bytes], seeds: int) -> np.ndarray:
    """Of each text ``seeds`` fingerprints of its words, weighted by 1 + log(count): a bit is 1 if over half of the
    weight sets it.  Weights are whole sixteenths, so that sums are exact in any order."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes, flat = [], []
    for t in texts:
        words = t.lower().split()
        sizes.append(len(words))
        flat.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    number.default_factory = None  # else the dictionary holds itself, and stays until a cycle is looked for
    out = np.zeros((len(texts), seeds), np.int64)
    if not number:
        return out
    pair, count = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(number) + np.concatenate(flat), return_counts=True)
    owner, word = pair // len(number), pair % len(number)
    weight = np.rint(16 * (1 + np.log(count))).astype(np.float32)
    h = hashes(list(number))
    bits = np.concatenate([_mixed(h, seed).astype(">u8").view(np.uint8).reshape(-1, 8) for seed in range(seeds)], axis=1)
    ends = np.flatnonzero(np.concatenate((owner[1:] != owner[:-1], [True]))) + 1
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        total = np.zeros(64 * seeds)
        for k in range(start, end, TOGETHER):
            piece = slice(k, min(k + TOGETHER, end))
            total += weight[piece] @ np.unpackbits(bits[word[piece]], axis=1).astype(np.float32)
        out[owner[start]] = np.packbits(2 * total > weight[start:end].sum(dtype=np.float64)).view(">u8").astype(np.uint64).view(np.int64)
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit SimHash of the text's shingles of ``size`` words).  A null text has no words."""

    def run(batches):
        for batch in small(batches):
            fps = [fingerprint(hashes(shingles(t or b"", size))) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    plain = pick(docs, doc_id=doc_id, text=text)
    return mapped(plain, run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, fp long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of fingerprints within ``radius``.

    Copies share a fingerprint and are one node; only distinct fingerprints are hashed into tables.  Null and
    empty texts have fingerprint zero and are linked like any other.  Rows with equal ids each stay; a null id
    is no component's smallest unless all of its ids are null.  No rows in, no rows out.
    """
    docs = cut(fingerprints(docs, doc_id=doc_id, text=text, size=size))
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = covering.links(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("fp")), radius)
    roots = stars(edges)
    linked = nodes.join(roots, F.col("fp") == F.col("a"), "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    linked = cut(linked)
    component = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.join(component, "root").select(F.col("fp").alias("key"), "component_id")
    return docs.join(of, F.col("fp") == F.col("key")).select("doc_id", "fp", "component_id")


def _raw(text: Column) -> Column:
    """A digest of the text as it is; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))


def _features(docs: DataFrame, seeds: int) -> DataFrame:
    """doc_id, raw, whole (a digest of the lower-cased word sequence; null for none) and fps of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in small(batches, 500, 2_000_000):
            texts = [b" ".join((t or b"").lower().split()) for t in utf8(batch.column("text"))]
            whole = pa.array([xxhash.xxh3_128_digest(t) if t else None for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), whole, pa.array(list(weighted(texts, seeds)), pa.list_(pa.int64()))], names=["doc_id", "raw", "whole", "fps"])

    return mapped(docs, run, f"doc_id {kind}, raw binary, whole binary, fps array<long>")


def _forest(sets: list[np.ndarray], nodes: list[int], similarity: float) -> list[tuple[int, int]]:
    """Pairs of nodes whose sets have a Jaccard similarity of at least ``similarity``, enough to connect all that
    such pairs connect: a node is done with only when a pair of it is verified.  Two sets alike share one of their
    n - ceil(similarity x n) + 1 rarest elements, so others need not be compared."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    starts, owner = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(sets), dtype=np.int32), lengths)
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ids, often = ids.astype(np.int32), often.astype(np.int32)
    ids = ids[np.lexsort((ids, often[ids], owner))]
    rare = np.arange(len(ids)) - starts[owner] <= (lengths - np.ceil(similarity * lengths - 1e-9))[owner]
    order = np.argsort(ids[rare], kind="stable")
    element, holder = ids[rare][order], owner[rare][order]
    own, left, out = np.zeros(len(often), bool), np.ones(len(sets), bool), []
    n_left = len(sets)
    for first in range(len(sets)):
        if not left[first]:
            continue
        queue, left[first] = [first], False
        n_left -= 1
        while queue and n_left:
            x = queue.pop()
            mine = ids[starts[x] : starts[x] + lengths[x]]
            key = mine[rare[starts[x] : starts[x] + lengths[x]]]
            low, high = np.searchsorted(element, key), np.searchsorted(element, key, "right")
            if (high - low).sum() < len(sets):
                near = np.unique(np.concatenate([holder[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)]))
                near = near[left[near]]
            else:
                near = np.flatnonzero(left)
            near = near[np.minimum(lengths[near], lengths[x]) >= similarity * np.maximum(lengths[near], lengths[x]) - 1e-9]
            if not len(near):
                continue
            ends = np.cumsum(lengths[near])
            own[mine] = True
            hit = own[ids[np.repeat(starts[near] - ends + lengths[near], lengths[near]) + np.arange(ends[-1])]]
            own[mine] = False
            same = np.add.reduceat(hit.astype(np.int64), ends - lengths[near])
            found = near[same >= similarity * (lengths[x] + lengths[near] - same) - 1e-9]
            out += [(nodes[x], nodes[k]) for k in found.tolist()]
            queue.extend(found.tolist())
            left[found] = False
            n_left -= len(found)
    return out


def _verified(links: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b), a > b: among the nodes that ``links`` connect, pairs whose sets of shingles have a Jaccard similarity
    of at least ``similarity``, enough to connect all that such pairs connect.

    Every pair of a component counts, not the links alone: these are a forest for the fingerprints, and a pair
    alike may be joined in it over a third node that is like neither.  A component of more than
    ``PART_SHINGLES`` shingles is split into parts, and each pair of parts is looked at by itself, but for pairs of
    parts that verified pairs with pivots connect (``_tied``).
    ``nodes``: node, id and raw of a row of it; ``docs``: doc_id, raw, text."""
    roots = stars(links)
    members = roots.toDF("id", "component").unionAll(roots.select("b", "b")).distinct()
    members = cut(members.join(nodes.select("node", F.col("id").alias("of"), F.col("raw").alias("w")), F.col("id") == F.col("node")).select("component", "node", "of", "w"))
    members = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members

    def shingled(batches):
        seen = set()
        for batch in small(batches):
            rows, sets = [], []
            for row, (node, t) in enumerate(zip(batch.column("node").to_pylist(), utf8(batch.column("text")), strict=True)):
                if node not in seen:  # rows equal in id and words
                    seen.add(node)
                    rows.append(row)
                    sets.append(np.unique(hashes(shingles(t, size))).view(np.int64))
            keep = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("component").take(keep), batch.column("node").take(keep), pa.array(sets, pa.list_(pa.int64()))], names=["component", "node", "set"])

    found = docs.join(members, (F.col("raw") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("component", "node", "text")
    sets = cut(mapped(found, shingled, "component long, node long, set array<long>"))
    sets, tied = _tied(sets, similarity)
    of = lambda which: F.ceil(F.coalesce(F.sum(F.when(which, F.size("set"))), F.lit(0)) / PART_SHINGLES).cast("long")
    parts = sets.groupBy(F.col("component").alias("c")).agg(of(~F.col("tied")).alias("q"), of(F.col("tied")).alias("p"))
    rows = sets.join(parts, F.col("component") == F.col("c"))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit("part")), F.greatest(n, F.lit(1)))
    part = F.when(F.col("tied"), F.col("q") + own(F.col("p"))).otherwise(own(F.col("q")))
    last = F.when(F.col("tied"), F.col("q") - 1).otherwise(F.col("q") + F.col("p") - 1)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0))), lambda k: F.struct(F.least(k, part).alias("i"), F.greatest(k, part).alias("j")))
    pairs = F.when(last >= 0, pairs).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))
    rows = rows.select("component", "node", "set", F.inline(pairs).alias("i", "j"))
    keys = ("component", "i", "j")
    rows = rows.select(*keys, "node", "set").repartition(session_parts(docs.sparkSession), *keys).sortWithinPartitions(*keys, "node")

    def run(batches):
        at, held, names = None, [], []

        def give():
            found = [p for p in _forest(held, names, similarity) if p[0] != p[1]] if len(held) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in found], pa.int64()), pa.array([min(p) for p in found], pa.int64())], names=["a", "b"])

        for batch in small(batches, 500):
            for *group, name, own in zip(*(batch.column(c).to_pylist() for c in (*keys, "node")), batch.column("set"), strict=True):
                if group == at and names[-1] == name:
                    continue  # again, from another task
                if group != at:
                    yield from give()
                    at, held, names = group, [], []
                held.append(own.values.to_numpy())
                names.append(name)
        yield from give()

    found = mapped(rows, run, "a long, b long")
    return found if tied is None else found.unionAll(tied)


def _tied(sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """``sets`` with tied: whether a node of a component of several parts is connected to most others by verified pairs
    with pivots; and these pairs.

    ``PIVOTS`` nodes of such a component are compared with all others.  Nodes of the largest group that this makes are connected
    already, so pairs among them need not be looked at: a large group of near copies costs its size, and its size times
    what is not in that group.  No result depends on it.  Pivots are broadcast up to ``MOST_PIVOTS``; of more large components,
    nothing is tied."""
    large = sets.groupBy(F.col("component").alias("c")).agg(F.sum(F.size("set")).alias("n")).where(F.col("n") > PART_SHINGLES)
    large = cut(large.select("c"))
    if large.isEmpty() or large.count() * PIVOTS > MOST_PIVOTS:
        return sets.withColumn("tied", F.lit(False)), None
    own = sets.join(F.broadcast(large), F.col("component") == F.col("c")).select("component", "node", "set")
    rank = F.xxhash64("node", F.lit("pivot"))
    chosen = own.groupBy("component", F.pmod(rank, F.lit(PIVOTS)).alias("k")).agg(F.min_by(F.struct("node", "set"), rank).alias("s")).collect()
    pivots: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in chosen:
        pivots.setdefault(r.component, []).append((r.s.node, np.array(r.s.set, np.int64)))
    shared = sets.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in small(batches):
            a, b = [], []
            for component, node, own_set in zip(batch.column("component").to_pylist(), batch.column("node").to_pylist(), batch.column("set"), strict=True):
                mine = own_set.values.to_numpy()
                for pivot, other in shared.value[component]:
                    n, m = len(mine), len(other)
                    if node == pivot or min(n, m) < similarity * max(n, m) - 1e-9:
                        continue
                    same = len(np.intersect1d(mine, other, assume_unique=True))
                    if same >= similarity * (n + m - same) - 1e-9:
                        a.append(max(node, pivot))
                        b.append(min(node, pivot))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    pairs = cut(mapped(own, run, "a long, b long").distinct())
    rooted = cut(own.select("component", "node").join(stars(pairs), F.col("node") == F.col("a"), "left").select("component", "node", F.coalesce("b", "node").alias("root")))
    most = rooted.groupBy("component", "root").count().groupBy(F.col("component").alias("c")).agg(F.max_by("root", "count").alias("most"))
    ties = rooted.join(F.broadcast(most), (F.col("component") == F.col("c")) & (F.col("root") == F.col("most"))).select(F.col("node").alias("tie"))
    return sets.join(ties, F.col("node") == F.col("tie"), "left").select("component", "node", "set", F.col("tie").isNotNull().alias("tied")), pairs


def _groups(docs: DataFrame, size: int, similarity: float, seeds: int, radius: int) -> DataFrame:
    """``docs``: doc_id, raw, text.  Their doc_id and raw, and those of the row of their group that stays: keeper, kept."""
    rows = cut(_features(docs, seeds).where("whole is not null"))
    own = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), "raw")
    first = rows.groupBy("whole").agg(F.min(own).alias("s"), F.any_value("fps").alias("fps"))
    nodes = cut(first.select("whole", "s.*", "fps").withColumn("node", F.monotonically_increasing_id()))  # numbers hold once they are written
    found = covering.links(nodes.select("node", F.col("fps").alias("fp")), radius)
    roots = stars(_verified(found, nodes, docs, size, similarity))
    rooted = cut(nodes.join(roots, F.col("node") == F.col("a"), "left").select("whole", F.struct("none", "id", "raw").alias("s"), F.coalesce("b", "node").alias("root")))
    kept = rooted.groupBy("root").agg(F.min("s").alias("s")).withColumnRenamed("root", "r")
    groups = rooted.drop("s").join(kept, F.col("root") == F.col("r")).select(F.col("whole").alias("w"), F.col("s.id").alias("keeper"), F.col("s.raw").alias("kept"))
    return rows.join(groups, F.col("whole") == F.col("w")).select("doc_id", "raw", "keeper", "kept")


def copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, seeds: int = 6, radius: int = 3) -> DataFrame:
    """doc_id, keeper, distinct: of documents whose shingles of ``size`` words have a Jaccard similarity of at least
    ``similarity``, linked to groups, each id with its group's smallest; keepers with themselves are left out.

    Ids are of any type that has an order.  Equal word sequences (ASCII case aside) are one node.  A text without
    words has no copies.  A null id is no keeper unless all ids of its group are null.  Similarities are computed
    from the texts.  Rows of one word sequence, or of one group, may be any share of all: they meet in joins that
    adaptive execution splits and in aggregations that combine before the shuffle.
    """
    found = _groups(pick(docs, doc_id=doc_id, text=text).withColumn("raw", _raw(F.col("text"))), size, similarity, seeds, radius)
    return found.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "keeper").distinct()


def drop_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, seeds: int = 6, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each group of ``copies``: one of its smallest id.

    Rows are told apart by id and text, also those with equal or null ids; of rows equal in both one stays, that with the
    least hash of its other columns.  Texts without words stay, all of them.  No rows in, no rows out."""
    own = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(own))))
    key, body = f"c{own.index(doc_id)}", f"c{own.index(text)}"
    plain = plain.withColumn("raw", _raw(F.col(body)))
    found = _groups(plain.select(F.col(key).alias("doc_id"), F.col(body).alias("text"), "raw"), size, similarity, seeds, radius)
    stays = (F.col("raw") == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("keeper"))
    # of all rows but the single ones that stay: how many rows there are, and whether one of them stays
    listed = found.groupBy(F.col("doc_id").alias("id"), F.col("raw").alias("w")).agg(F.first(stays).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    listed = cut(listed.select("id", "w", "stays"))
    same = (F.col("raw") == F.col("w")) & F.col(key).eqNullSafe(F.col("id"))
    few = listed.count() <= BROADCAST_ROWS
    out = plain.join(F.broadcast(listed) if few else listed, same, "left_anti").drop("raw")  # not few: texts are shuffled
    again = listed.where("stays")
    if again.isEmpty():
        return out.toDF(*own)
    again = F.broadcast(again) if few else again
    hashed = [c for c, kind in plain.dtypes if "map<" not in kind and "variant" not in kind]
    many = plain.join(again, same, "left_semi").groupBy(key, "raw").agg(F.min_by(F.struct(*out.columns), F.xxhash64(*hashed)).alias("s"))
    return out.unionAll(many.select("s.*")).toDF(*own)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint and its component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
