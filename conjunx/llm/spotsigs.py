"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A signature is an anchor with the next ``CHAIN`` content words; a text's fingerprint is its set of signatures.  The
start of a text is an anchor too, so that short texts have one.  A text without any signature is fingerprinted by its words, one without words by itself, so that only empty
texts have empty fingerprints.

``classes`` joins documents by similarity: sets are partitioned by length so that a set can match only sets of its
own or the next partition, meet where they share one of their rarest signatures, and are compared by a Jaccard
similarity that lengths prune.
"""

from __future__ import annotations

import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunx.llm.common import cut, mapped, pick, session_parts, small, table
from conjunx.llm.components import stars
from conjunx.llm.decontaminate import words

CHAIN = 2

#: Common words of English, German, French and Spanish, the anchors.
ANCHORS = """
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
der die das und in zu den mit von ist des sich auf für nicht ein eine dem im auch es an als
le la les de des et un une en que est du dans pour au ce il qui ne pas sur avec
el los las y del se lo con por su al más como para una
""".split()

_START = np.uint64(1 << 32)
_ANCHORS = np.unique(np.array([crc32(w.encode()) for w in ANCHORS], np.uint32))


def signatures(text: str) -> np.ndarray:
    """The text's distinct signatures, 32 bits each, in order."""
    parts = words(text.encode())
    if not parts:
        return np.array([crc32(text.encode())], np.uint32) if text else np.empty(0, np.uint32)
    h = np.fromiter(map(crc32, parts), np.uint32, len(parts))
    near = np.minimum(np.searchsorted(_ANCHORS, h), len(_ANCHORS) - 1)
    anchor = _ANCHORS[near] == h
    content = np.flatnonzero(~anchor)
    at = np.flatnonzero(anchor)
    k = np.concatenate(([0], np.searchsorted(content, at)))
    whole = k + CHAIN <= len(content)
    k, sig = k[whole], np.concatenate(([_START], h[at].astype(np.uint64)))[whole]
    if not len(k):
        return np.unique(h)
    for j in range(CHAIN):
        sig = (sig * np.uint64(0x9E3779B97F4A7C15)) ^ h[content[k + j]]
        sig ^= sig >> np.uint64(31)
    return np.unique(((sig * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets; 0 without a look at them if their sizes rule ``least`` out."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate((a, b))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(both) - same)


def as_text(sig: np.ndarray) -> str:
    """Eight hex digits for each signature, in order."""
    return sig.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, signatures: the sorted set of each text; null is an empty text."""
    plain = pick(docs, doc_id=doc_id, text=text)

    def run(batches):
        for batch in small(batches):
            sets = [signatures(t or "").astype(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "signatures"])

    return mapped(plain, run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, signatures array<long>")


#: Keys that are looked at for each range of documents.
PER_PART = 200
#: A group of more sets is split into parts, and every pair of parts is looked at by itself.
PART_ROWS = 20_000


def _partition(length, similarity: float):
    """The partition of a set's length: each covers lengths up to 1 / ``similarity`` times its first."""
    return F.floor(F.log(length.cast("double")) / math.log(1 / similarity)).cast("int")


def _alike(sets: list[np.ndarray], nodes: list[int], similarity: float) -> list[tuple[int, int]]:
    """Pairs of nodes with alike sets, enough to connect all that are alike.  ``sets`` go by length."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    left, out = np.arange(len(sets)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            n = lengths[left]
            low, high = np.searchsorted(n, math.ceil(similarity * lengths[x] - 1e-9)), np.searchsorted(n, math.floor(lengths[x] / similarity + 1e-9), "right")
            near = left[low:high]  # lengths of others rule them out
            if not len(near):
                continue
            flat = np.concatenate([sets[k] for k in near.tolist()])
            own = sets[x]
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            same = np.add.reduceat(hit.astype(np.int64), np.cumsum(lengths[near]) - lengths[near])
            good = same >= similarity * (lengths[x] + lengths[near] - same) - 1e-9
            found = near[good]
            out += [(nodes[x], nodes[k]) for k in found.tolist()]
            queue.extend(found.tolist())
            left = np.concatenate((left[:low], near[~good], left[high:]))
    return out


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """doc_id, class_id: the smallest doc_id reachable over pairs whose signature sets have a Jaccard similarity of
    at least ``similarity``.

    Equal sets are one node.  Null and empty texts have no signatures and, alike, are one class.  Rows with equal
    ids each stay; a null id is a class's smallest only if all its ids are null.  A set meets others under its
    n - ceil(similarity x n) + 1 rarest signatures, in its own length partition and the next one: two alike sets
    always share one of these.  Groups give no more pairs than connect them, and large ones are split, so that
    hot signatures and large groups of copies cost no task more than ``PART_ROWS`` sets squared.
    """
    sets = cut(fingerprints(docs, doc_id=doc_id, text=text).withColumn("set", F.xxhash64("signatures")))
    nodes = sets.groupBy("set").agg(F.min("doc_id").alias("least"), F.any_value("signatures").alias("signatures"))
    nodes = cut(nodes)
    each = nodes.where(F.size("signatures") > 0).select("set", F.size("signatures").alias("length"), F.explode("signatures").alias("s"))
    often = each.groupBy("s").count()
    ranked = each.join(often.withColumnRenamed("s", "t"), F.col("s") == F.col("t")).groupBy("set", "length").agg(F.array_sort(F.collect_list(F.struct("count", "s"))).alias("by"))
    prefix = ranked.select("set", "length", F.explode(F.slice("by", 1, (F.col("length") - F.ceil(F.lit(similarity) * F.col("length") - 1e-9) + 1).cast("int"))["s"]).alias("s"))
    own = _partition(F.col("length"), similarity)
    keys = prefix.select("set", "length", F.explode(F.array(F.xxhash64("s", own), F.xxhash64("s", own + 1))).alias("bucket"))
    counts = keys.groupBy("bucket").count().where(F.col("count") > 1).withColumnRenamed("bucket", "b")
    keys = keys.join(counts, F.col("bucket") == F.col("b")).withColumn("parts", F.ceil(F.col("count") / PART_ROWS).cast("long"))
    part = F.pmod(F.xxhash64("set", F.lit("part")), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.xxhash64("bucket", F.least(k, part), F.greatest(k, part)))
    rows = keys.select("set", F.explode(pairs).alias("bucket")).distinct().join(nodes.select(F.col("set").alias("k"), "signatures"), F.col("set") == F.col("k"))
    rows = rows.select("bucket", F.size("signatures").alias("length"), "set", "signatures").repartition(session_parts(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "length", "set")

    def run(batches):
        at, held, names = None, [], []

        def give():
            found = _alike(held, names, similarity) if len(held) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in found], pa.int64()), pa.array([min(p) for p in found], pa.int64())], names=["a", "b"])

        for batch in small(batches):
            for bucket, name, sig in zip(*(batch.column(c).to_pylist() for c in ("bucket", "set", "signatures")), strict=True):
                if bucket != at:
                    yield from give()
                    at, held, names = bucket, [], []
                held.append(np.array(sig, np.int64))
                names.append(name)
        yield from give()

    roots = stars(mapped(rows, run, "a long, b long"))
    linked = cut(nodes.join(roots, F.col("set") == F.col("a"), "left").select("set", "least", F.coalesce("b", "set").alias("root")))
    smallest = linked.groupBy("root").agg(F.min("least").alias("class_id"))
    of = linked.join(smallest, "root").select(F.col("set").alias("k"), "class_id")
    return sets.join(of, F.col("set") == F.col("k")).select("doc_id", "class_id")


def _range_index(value, bounds: list) -> F.Column:
    """How many of the sorted ``bounds`` (columns) are at most ``value``, looked up in two steps of about their root."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    every = F.array(*bounds)
    coarse = F.array(*bounds[step - 1 :: step])
    first = F.size(F.filter(coarse, lambda b: b <= value)) * step
    return first + F.size(F.filter(F.slice(every, first + 1, F.lit(step)), lambda b: b <= value))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, with rows dealt to ranges of doc_id (column part) and sorted in them by descending doc_id,
    nulls last; each range ends with rows with ``copy`` = 1, the first of the next range.

    Ids are of any type that has an order.  Rows with equal ids go by a hash of their texts, then by these, and
    ranges are of ids with such hashes: an id that many rows have is split.  Only rows equal in id and text share
    a range for sure.  Where ranges begin is taken from some ``PER_PART`` keys for each."""
    value = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    keys = cut(docs.select(value.alias("key")))
    rate = max(1, keys.count() // (PER_PART * parts))
    some = sorted((r.key for r in keys.where(F.pmod(F.xxhash64("key.doc_id", "key.h"), F.lit(rate)) == 0).distinct().toLocalIterator()), key=lambda k: (k.doc_id is not None, 0 if k.doc_id is None else k.doc_id, k.h))
    kind = docs.schema["doc_id"].dataType
    literal = lambda k: F.struct(F.lit(k.doc_id).cast(kind).alias("doc_id"), F.lit(k.h).alias("h"))
    bounds = [literal(k) for k in some[:: max(1, -(-len(some) // parts))][1:]]
    part = lambda key: _range_index(key, bounds)
    heads = {r.part: r.head for r in keys.groupBy(part(F.col("key")).alias("part")).agg(F.max("key").alias("head")).toLocalIterator()}
    docs = docs.select("doc_id", "text", value.alias("key")).withColumn("part", part(F.col("key")))
    if not heads:
        return docs.drop("key").withColumn("copy", F.lit(0))
    order = sorted(heads, reverse=True)
    to = {k: order[i - 1] for i, k in enumerate(order)}  # the head of a range goes to the range before, the first to the last
    none = F.lit(None).cast(keys.schema["key"].dataType)
    every = range(len(bounds) + 1)
    head = F.element_at(F.array(*(literal(heads[k]) if k in heads else none for k in every)), F.col("part") + 1)
    target = F.element_at(F.array(*(F.lit(to.get(k, 0)) for k in every)), F.col("part") + 1)
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("copy"))
    both = F.when(F.col("key").eqNullSafe(head), F.array(own, F.struct(target.alias("part"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    rows = docs.select("doc_id", "text", "key", F.inline(both).alias("part", "copy"))
    rows = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.desc("part"), "copy", F.desc_nulls_last("doc_id"), F.desc("key.h"), "text")
    return rows.drop("key")


def edited(text: str, after: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first as many of ``after``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def op9_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Per document: fingerprints of its text and its edited text, and likenesses to that and to the next one."""
    rows = with_next(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"), session_parts(spark))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        last = None
        for batch in small(batches):
            out: list[list] = [[] for _ in names]
            for doc_id, text, part, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "copy")), strict=True):
                text = text or ""
                sig = None if last is not None and last[4] and copy and last[2] == part else signatures(text)
                if last is not None and not last[4] and last[2] == part:
                    old_id, old, _, old_sig, _ = last
                    new = edited(old, text)
                    new_sig = signatures(new)
                    row = old_id, len(old), hashlib.sha256(new.encode()).hexdigest(), as_text(old_sig), as_text(new_sig), likeness(old_sig, new_sig), likeness(old_sig, sig)
                    for to, x in zip(out, row, strict=True):
                        to.append(x)
                last = doc_id, text, part, sig, copy
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, k or batch.schema.field("doc_id").type) for x, k in zip(out, kinds, strict=True)], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def spotsigs_classes(spark, sf_dir: str) -> DataFrame:
    """Per document: the class of documents whose fingerprints are alike to 0.8 or more."""
    return classes(table(spark, sf_dir, "documents"))
