"""Benchmark decontamination: a generalised suffix automaton of the test items, streamed over by every document.

The automaton is broadcast, so its size is checked: the items are split into blocks of at most ``BLOCK_CHARS``
characters by a hash of the item, one automaton a block.  An ordinary test set is one block and one pass, with no
shuffle.  Of larger ones, documents are first held against a Bloom filter of all windows, which never misses one;
only those that it does not clear, which are few, are written to the shared folder and streamed over the blocks'
automata, each pass giving no more than hits.  The filter is split as well, at ``FILTER_WINDOWS`` windows.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conjunx.llm.common import cut, mapped, pick, small, table, utf8
from conjunx.llm.suffix_automaton import SuffixAutomaton

#: Most characters of items in one automaton (some 100 MB in a worker).
BLOCK_CHARS = 1_000_000

#: Most windows in one Bloom filter, 32 to 64 bits (64 MB at most) and 8 places for each: of other windows it passes
#: one in 170,000 or fewer.
FILTER_WINDOWS = 8_000_000
PLACES = 8

#: A-Z in lower case, every other ASCII character but digits and letters a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_ADDED = ("n_words", "hits", "items")
_HITS = "array<struct<start:int,stop:int>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _runs(known: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, stop) of the runs of at least ``least`` words that all occur in the items."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
    starts, stops = edge[::2], edge[1::2]
    keep = stops - starts >= least
    return list(zip(starts[keep].tolist(), stops[keep].tolist(), strict=True))


def _union(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find(text: bytes, automaton: SuffixAutomaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, the word ranges that windows cover, and the items whose windows occur."""
    parts = words(text)
    hits: list[tuple[int, int]] = []
    labels: set[str] = set()
    if automaton.shortest and len(parts) >= automaton.shortest:
        get = automaton.vocabulary.get
        ids = [get(w, -1) for w in parts]
        for a, b in _runs(np.fromiter(ids, np.int64, len(ids)) >= 0, automaton.shortest):
            automaton.scan(ids, a, b, hits, labels)
    return len(parts), _union(hits), labels


def _hits(found: list) -> pa.Array:
    return pa.array([[{"start": a, "stop": b} for a, b in s] for s in found], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))


def _scan(df: DataFrame, text: str, automaton: SuffixAutomaton) -> DataFrame:
    """``df`` with n_words, hits and items."""
    shared, at = df.sparkSession.sparkContext.broadcast(automaton), df.columns.index(text)

    def run(batches):
        for batch in small(batches):
            rows = [find(t or b"", shared.value) for t in utf8(batch.column(at))]
            new = pa.array([n for n, _, _ in rows], pa.int64()), _hits([h for _, h, _ in rows]), pa.array([sorted(x) for _, _, x in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *_ADDED])

    return mapped(df, run, f"{_ddl(df)}, n_words long, hits {_HITS}, items array<string>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _cut_out(df: DataFrame, text: str, most_covered: float) -> DataFrame:
    """``df`` without n_words, hits and items, with hits cut out of texts and without texts that are covered too far."""
    own = [c for c in df.columns if c not in _ADDED]

    def run(batches):
        for batch in small(batches):
            spans = [[(h["start"], h["stop"]) for h in x] for x in batch.column("hits").to_pylist()]
            keep = pa.array([sum(b - a for a, b in s) <= n * most_covered for n, s in zip(batch.column("n_words").to_pylist(), spans, strict=True)], pa.bool_())
            place = batch.schema.names.index(text)
            if any(spans):
                new = [_without(t, s) if s else t for t, s in zip(batch.column(place).to_pylist(), spans, strict=True)]
                batch = batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
            yield batch.select(own).filter(keep)

    return mapped(df, run, _ddl(df.select(*own)))


def _window_hashes(parts: list[bytes], sizes: list[int]) -> np.ndarray:
    """A hash of each run of so many words, for each size."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    out, own, factor = [np.empty(0, np.uint64)], np.zeros(len(h), np.uint64), 1
    for n in range(1, min(max(sizes, default=0), len(h)) + 1):
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
        own = own[: len(h) - n + 1] + h[n - 1 :] * np.uint64(factor)
        if n in sizes:
            mixed = (own ^ (own >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93 + 2 * n)
            out.append(mixed ^ (mixed >> np.uint64(32)))
    return np.concatenate(out)


def _place(h: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th place of each hash in a filter of 2**bits bits: the byte and the bit in it."""
    at = ((h >> np.uint64(32)) + np.uint64(k) * (h & np.uint64(2**32 - 1) | np.uint64(1))) & np.uint64(2**bits - 1)
    return (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)


def _filters(source: DataFrame, window: int, filter_windows: int) -> tuple[list[int], list[tuple[int, np.ndarray]]]:
    """The sizes that windows have, and Bloom filters (places, bits) that together have all windows."""
    total = source.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil((total / 2 + 1) / filter_windows))  # a word has a character and a space at least
    sizes, filters = set(), []
    for k in range(parts):
        found = [np.empty(0, np.uint64)]
        for r in source.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).select("text").toLocalIterator():
            if item := words(r.text.encode()):
                sizes.add(min(window, len(item)))
                found.append(_window_hashes(item, [min(window, len(item))]))
        h = np.unique(np.concatenate(found))
        bits = max(20, (32 * len(h)).bit_length())
        out = np.zeros(1 << (bits - 3), np.uint8)
        for j in range(PLACES):
            byte, bit = _place(h, j, bits)
            np.bitwise_or.at(out, byte, np.uint8(1) << bit)
        filters.append((bits, out))
    return sorted(sizes), filters


def _passes(h: np.ndarray, bits: int, table: np.ndarray) -> bool:
    """Whether one of the hashes may be in the filter."""
    for k in range(PLACES):
        byte, bit = _place(h, k, bits)
        h = h[(table[byte] >> bit & 1).astype(bool)]
    return len(h) > 0


def _uncleared(df: DataFrame, text: str, source: DataFrame, window: int, filter_windows: int) -> DataFrame:
    """``df`` with n_words and the boolean maybe: whether a window may occur, as the filters say."""
    sizes, filters = _filters(source, window, filter_windows)
    for k, one in enumerate(filters):
        shared, at = df.sparkSession.sparkContext.broadcast(one), df.columns.index(text)

        def run(batches, shared=shared, first=not k, at=at):
            for batch in small(batches):
                parts = [words(t or b"") for t in utf8(batch.column(at))]
                maybe = np.array([_passes(_window_hashes(x, sizes), *shared.value) for x in parts], bool)
                if first:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, parts), pa.int64()), pa.array(maybe)], names=[*batch.schema.names, "n_words", "maybe"])
                else:
                    maybe |= batch.column("maybe").to_numpy(zero_copy_only=False)
                    yield batch.set_column(len(batch.columns) - 1, batch.schema.field("maybe"), pa.array(maybe))

        df = mapped(df, run, _ddl(df) + ("" if k else ", n_words long, maybe boolean"))
    return df


def _found(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, window: int, block_chars: int, filter_windows: int) -> DataFrame:
    """``docs`` with n_words, hits and items.  ``text`` is a column of strings."""
    source = pick(items, id=item_id, text=item_text).where("text is not null")
    blocks = max(1, math.ceil((source.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))

    def automaton(k: int) -> SuffixAutomaton:
        rows = source.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).select(F.col("id").cast("string"), "text").toLocalIterator()
        return SuffixAutomaton(((r.id, words(r.text.encode())) for r in rows), window)

    if blocks == 1:
        return _scan(docs, text, automaton(0))
    own = docs.columns
    seen = _uncleared(docs, text, source, window, filter_windows)
    clear = seen.where(~F.col("maybe")).select(*own, "n_words", F.array().cast(_HITS).alias("hits"), F.array().cast("array<string>").alias("items"))
    rest = cut(seen.where("maybe").withColumn("row_", F.monotonically_increasing_id()))  # numbers hold once they are written
    passes = [_scan(rest.select("row_", F.col(text)), text, automaton(k)).where(F.size("hits") > 0).select("row_", "hits", "items") for k in range(blocks)]
    each = functools.reduce(DataFrame.unionAll, passes)
    each = each.groupBy(F.col("row_").alias("r")).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array()
    hits = F.coalesce(_joined(F.array_sort("hits")), none.cast(_HITS))
    rest = rest.join(each, F.col("row_") == F.col("r"), "left").select(*own, "n_words", hits.alias("hits"), F.coalesce("items", none.cast("array<string>")).alias("items"))
    return clear.unionAll(rest)


def _joined(hits: Column) -> Column:
    """Sorted ranges, those that touch or overlap as one."""
    start = F.array().cast(_HITS)

    def step(out, h):
        last = F.element_at(out, -1)
        touches = (F.size(out) > 0) & (h["start"] <= last["stop"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], h["stop"]).alias("stop"))
        return F.when(touches, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(h)))

    return F.aggregate(hits, start, step)


def scan(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_chars: int = BLOCK_CHARS, filter_windows: int = FILTER_WINDOWS) -> DataFrame:
    """``docs`` with n_words (long), hits (word ranges inside occurring windows, united and in order) and items
    (ids, as text in code point order, of the items with occurring windows).

    A null or empty text has no words and no hits.  A null item text has no windows; the windows of an item
    whose id is null count, but it is not named.  Repeated items and documents are judged each by itself; an
    empty item table hits nothing.  Columns of ``docs`` named n_words, hits or items are replaced.
    """
    own = [c for c in docs.columns if c not in _ADDED]
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)))
    column = f"c{own.index(text)}"
    df = _found(plain.withColumn(column, F.col(column).cast("string")), column, items, item_id, item_text, window, block_chars, filter_windows)
    return df.toDF(*own, *_ADDED)


def _without(text: str, hits: list) -> str:
    """``text`` without the words of ``hits`` and the separators inside each range."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, pos = [], 0
    for a, b in hits:
        out.append(raw[pos : at[a][0]])
        pos = at[b - 1][1]
    return b"".join([*out, raw[pos:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, most_covered: float = 0.5, block_chars: int = BLOCK_CHARS, filter_windows: int = FILTER_WINDOWS) -> DataFrame:
    """``docs``, same columns, with every hit word range cut out of its text; a document of which more than
    ``most_covered`` of the words are hit is dropped.  Documents without hits pass unchanged, null texts too; rows are
    judged each by itself, whatever their ids; an empty item table changes nothing."""
    own = docs.columns
    plain, column = docs.toDF(*(f"c{k}" for k in range(len(own)))), f"c{own.index(text)}"
    df = _found(plain.withColumn(column, F.col(column).cast("string")), column, items, item_id, item_text, window, block_chars, filter_windows)
    return _cut_out(df, column, most_covered).toDF(*own)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document: words, words inside windows of 10 item words, and the items these come from."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["stop"] - h["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

OP5_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, {_SQL_WORDS} AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS s
  FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(k) WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT row_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS s
  FROM docs, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(k)
), found AS (
  SELECT row_id, k, n, item_id FROM doc_windows JOIN item_windows USING (n, s)
), hits AS (
  SELECT row_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT row_id, k, n FROM found) AS f, unnest(generate_series(k, k + n - 1)) AS t(p) GROUP BY row_id
), named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row_id, item_id FROM found WHERE item_id IS NOT NULL) AS f GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (row_id) LEFT JOIN named USING (row_id)
"""
