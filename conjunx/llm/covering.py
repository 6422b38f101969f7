"""Covering locality-sensitive hashing of 64-bit fingerprints: every pair within the radius shares a bucket.

Each bit gets a vector of r + 1 bits, not all zero, in turn.  For each non-zero vector v there is a table, whose
mask holds the bits with odd inner product with v.  At most r differing bits span at most r dimensions, so some v
is orthogonal to all of them: that table's mask leaves out every differing bit and the pair meets there.  That is
2^(r+1) - 1 tables, 15 for r = 3, with some 34 bits in each key.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunx.llm.common import mapped, session_parts

#: A bucket of more rows is split into parts; every pair of parts becomes a bucket of its own.
PART_ROWS = 100_000
#: Inside a task, groups of more distinct fingerprints are covered again over the bits in which they differ.
DIRECT = 512
#: Groups of up to so many rows are compared pair by pair in one vectorised pass.
SMALL = 8


@functools.cache
def masks(radius: int, bits: int = 2**64 - 1) -> tuple[int, ...]:
    """The tables' masks over the set bits of ``bits``."""
    places = [k for k in range(64) if bits >> k & 1]
    vectors = [1 + k % (2 ** (radius + 1) - 1) for k in range(len(places))]
    tables = (sum(1 << p for p, m in zip(places, vectors, strict=True) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1)))
    return tuple(dict.fromkeys(tables))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _tree(fp: np.ndarray, radius: int, at: np.ndarray, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Adds to ``out`` links among the distinct fingerprints fp[at], enough to connect all that links connect."""
    if len(at) <= DIRECT:
        left = at
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(fp[left] ^ fp[x]) <= radius
                if near.any():
                    found = left[near]
                    out.append((np.full(len(found), x), found))
                    queue.extend(found.tolist())
                    left = left[~near]
        return
    differ = int(np.bitwise_or.reduce(fp[at] ^ fp[at[0]]))
    for mask in masks(radius, differ):
        key = fp[at] & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        key = key[order]
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for part in np.split(at[order], cuts):
            if len(part) > 1:
                _tree(fp, radius, part, out)


def _links(bucket: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes whose fingerprints are within ``radius`` and share a bucket; rows come sorted by bucket, fp."""
    n = len(bucket)
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    group = np.repeat(sizes, sizes)
    a_s, b_s = [], []
    small = (group > 1) & (group <= SMALL)
    for shift in range(1, SMALL):
        a = np.flatnonzero(small[:-shift] & (bucket[shift:] == bucket[:-shift])) if n > shift else np.empty(0, np.int64)
        if not len(a):
            break
        a = a[np.bitwise_count(fp[a] ^ fp[a + shift]) <= radius]
        a_s.append(a)
        b_s.append(a + shift)
    for s, k in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        rows = fp[s : s + k]
        first = np.concatenate(([True], rows[1:] != rows[:-1]))
        heads = np.flatnonzero(first)
        if len(heads) < k:  # equal fingerprints: each row is linked to the first that has its fingerprint
            rest = np.flatnonzero(~first)
            a_s.append(s + heads[np.cumsum(first)[rest] - 1])
            b_s.append(s + rest)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        _tree(rows, radius, heads, out)
        for x, y in out:
            a_s.append(s + x)
            b_s.append(s + y)
    if not a_s:
        return node[:0], node[:0]
    a, b = node[np.concatenate(a_s)], node[np.concatenate(b_s)]
    keep = a != b
    return np.maximum(a, b)[keep], np.minimum(a, b)[keep]


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """nodes: node (long), fp (array of longs, fingerprints of 64 bits each).  Returns (a, b), a > b, distinct:
    pairs of nodes of which fingerprints at the same place are within ``radius``.

    In groups of up to ``SMALL`` rows every such pair; in larger ones a spanning forest of them, so that no
    group gives all its pairs and yet all that is linked is connected.  A bucket of more than ``PART_ROWS``
    rows is split into parts, and each pair of parts is looked at in a task of its own.
    """
    spark = nodes.sparkSession
    tables = F.array(*(F.lit(_signed(m)) for m in masks(radius)))
    rows = nodes.select("node", F.posexplode("fp").alias("place", "fp")).select("node", "fp", "place", F.posexplode(tables).alias("table", "mask"))
    rows = rows.select("node", "fp", F.xxhash64("place", "table", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    rate = max(1, PART_ROWS // 1000)  # buckets to split are found by every rate-th node: where a split begins need not be exact
    counted = rows.where(F.pmod(F.xxhash64("node", F.lit("rate")), F.lit(rate)) == 0).groupBy("bucket").count().withColumn("count", F.col("count") * rate)
    hot = counted.where(F.col("count") > PART_ROWS).select(F.col("bucket").alias("hot"), F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts"))
    rows = rows.join(hot, F.col("bucket") == F.col("hot"), "left")
    own = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1), lambda k: F.xxhash64("bucket", F.least(k, own), F.greatest(k, own)))
    rows = rows.withColumn("bucket", F.explode(F.when(F.col("parts").isNull(), F.array("bucket")).otherwise(pairs))).select("bucket", "fp", "node")
    rows = rows.repartition(session_parts(spark), "bucket").sortWithinPartitions("bucket", "fp", "node")

    def run(batches):
        held = [np.empty(0, np.int64)] * 3

        def give(parts):
            a, b = _links(parts[0], parts[1].view(np.uint64), parts[2], radius)
            if len(a):
                pair = np.unique(np.stack((a, b), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
            if not len(held[0]):
                continue
            whole = int(np.searchsorted(held[0], held[0][-1]))
            yield from give([h[:whole] for h in held])
            held = [h[whole:] for h in held]
        yield from give(held)

    return mapped(rows, run, "a long, b long").distinct()
