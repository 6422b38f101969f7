"""Main text of web pages by a suffix array over the token streams of each host's pages: long substrings that distinct
pages repeat are boilerplate and go, unique runs stay, and text that an article's markup encloses is protected.

A page is cut into blocks, and what its elements say sorts them: blocks of the article are kept; furniture by its
elements, and what stands beside an article, is gone; about the rest the host decides.  That is all text of pages
without an article, and blocks in elements whose names only half say furniture (class="related-work").

Every page gives its blocks but the protected ones, furniture too, to the suffix array of its host: word streams
one after another, suffixes sorted by their first ``LEAST`` words.  Runs that occur on ``PAGES`` distinct pages or
more, and whole blocks that do, are boilerplate; what they do not cover of the undecided blocks is kept.  A passage
of an article that other pages have too is text: articles neither lose it nor bear witness against it.

A host of more than ``SHARD_CHARS`` characters is dealt, by a hash of its pages, into shards, each with an array
of its own: a task's memory is bounded and no host meets in one task.  Pages are counted over all shards: each
gives the hashes of its runs of ``LEAST`` words and of its blocks with their numbers of pages, and gets back those
that the host has on ``PAGES`` pages, so that shards change nothing in what is found.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunx.llm.common import cut, mapped, pick, small, table
from conjunx.llm.url_filter import host_of

LEAST, PAGES = 8, 3
SHARD_CHARS = 1_000_000
#: Hosts of several shards are broadcast up to this number, some 50 MB.
BROADCAST_ROWS = 200_000
#: What is known of a block: text, undecided, furniture.
KEEP, OPEN, GONE = 0, 1, 2

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*?)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")

# HTML's elements by what they mean here.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul caption".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe title svg math object xmp noframes".split())
FURNITURE = set("aside button dialog footer form head header menu nav search select label input fieldset".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id names that mark furniture, and those of them that mark headers.
MARKS = set("""
ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist consent
cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices
pager pagination popup promo promoted promotion related replies respond share sharebar sharing sidebar signup
social sponsor sponsored subscribe subscription toolbar widget
""".split())
HEADERS = {"header", "masthead", "banner"}
#: Words that do not change what a name with such a mark says; with others the name leaves it open.
NEUTRAL = set("""
area article articles author avatar bar block body bottom box bottombar button buttons center column container
content count counter date desktop fixed form global group head heading holder inner item items left link links
list main meta mobile module new outer page panel post posts primary reply right row secondary section single site
slot small space sticky story strip text thread title top topbar unit user wide wrap wrapper zone
""".split())
#: Marks that say of an article element that it is not the page's.
LESSER = {"comment", "related", "promo", "sponsored", "ad"}
#: Open elements that an element's start ends, besides p.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class _Element(NamedTuple):
    """An open element, and what holds inside it: in an article; in furniture, surely (2) or perhaps (1); in an
    article's own header."""

    name: str
    article: bool = False
    furniture: int = 0
    header: bool = False


def _named(element: str, value: str) -> tuple[int, set[str]]:
    """Whether names of class or id say furniture: surely (2), perhaps (1), not (0); and the marks among them."""
    sure, marks = 0, set()
    for name in value.split():
        parts = set(_TOKEN.findall(name))
        if found := parts & (LESSER if element == "article" else MARKS):
            whole = all(x in MARKS or x in NEUTRAL or x.isdigit() for x in parts)
            if whole or element != "article":
                sure, marks = max(sure, 1 + whole), marks | found
    return sure, marks


def _meaning(name: str, attributes: str) -> tuple[int, bool, bool]:
    """Whether an element is furniture, whether as a header, and whether it is an article."""
    furniture, header, article = 2 * (name in FURNITURE), name == "header", name in ("article", "main")
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id") and name not in ("html", "body", "main"):
                sure, found = _named(name, value)
                if sure == 2:
                    furniture, header, article = 2, found <= HEADERS and (header or not furniture), False
                elif not furniture:
                    furniture = sure
            elif key == "role":
                if value == "main":
                    article = True
                elif value in ROLES:
                    furniture, header = 2, value == "banner"
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                furniture, header = 2, False
    return furniture, header, article


def blocks(page: str) -> list[tuple[bool, int, str]]:
    """(in an article, furniture: 2 surely, 1 perhaps, text) of the page's blocks in page order, white space made single."""
    out: list[tuple[bool, int, str]] = []
    stack: list[_Element] = []
    opened: dict[str, int] = {}
    pieces: list[str] = []
    beside: list[str] = []  # of furniture inside the block
    pos, here = 0, _Element("")

    def flush() -> None:
        for parts, furniture in ((pieces, here.furniture % 2), (beside, 2)):
            if parts:
                if text := " ".join(html.unescape("".join(parts)).split()):
                    out.append((here.article, furniture, text))
                parts.clear()

    def close(depth: int) -> None:
        nonlocal here
        for e in stack[depth:]:
            opened[e.name] -= 1
        del stack[depth:]
        here = stack[-1] if stack else _Element("")

    while True:
        start, match = page.find("<", pos), None
        while start >= 0 and not (match := _TAG.match(page, start)):
            start = page.find("<", start + 1)
        (beside if here.furniture == 2 or here.header else pieces).append(page[pos : start if start >= 0 else len(page)])
        if start < 0:
            break
        pos = match.end()
        name = (match[2] or "").lower()
        block = name in BLOCKS
        if block:
            flush()
        elif name == "br":
            (beside if here.furniture == 2 or here.header else pieces).append(" ")
        if not name or name in VOID:
            continue
        if match[1]:
            if opened.get(name):
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth].name == name:
                        close(depth)
                        break
                    if not block and stack[depth].name in BLOCKS:  # an inline element does not end blocks
                        break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(page, pos)
            if not match[3].endswith("/") or name not in ("svg", "math"):
                pos = (page.find(">", end.start()) + 1) or len(page) if end else len(page)
            continue
        furniture, header, article = _meaning(name, match[3])
        if not block and furniture == 1:  # inside a block nothing is left open
            furniture = 0
        article = article and furniture < 2
        if article and not here.article:  # an article ends what was left open before it
            close(0)
        if block:
            while stack and (stack[-1].name == "p" or stack[-1].name in CLOSES.get(name, ())):
                close(len(stack) - 1)
        if not (block or furniture or article or opened.get(name)) or (match[3].endswith("/") and not block):
            continue  # other inline elements mean nothing here
        own = furniture == 2 and header and here.article
        here = _Element(name, here.article or article, here.furniture if own else max(here.furniture, furniture), (here.header or own) and name not in HEADINGS)
        stack.append(here)
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def parts(page: str) -> tuple[list[int], list[str]]:
    """What is known of each of the page's blocks (KEEP, OPEN or GONE), and their texts."""
    found = blocks(page)
    article = any(inside and furniture < 2 for inside, furniture, _ in found)
    known = [GONE if furniture == 2 or inside < article else OPEN if furniture or not article else KEEP for inside, furniture, _ in found]
    return known, [t for _, _, t in found]


def suffix_array(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``stream`` sorted by their first ``depth`` words, and by place the rank of that prefix.

    Prefix doubling: ranks of w words give ranks of up to 2 w.  A suffix that ends early ranks before others."""
    _, rank = np.unique(stream, return_inverse=True)
    width = 1
    while width < depth:
        step = min(width, depth - width)
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - step] = rank[step:]
        pair = rank.astype(np.int64) * (len(rank) + 1) + after + 1
        _, rank = np.unique(pair, return_inverse=True)
        width += step
    return np.argsort(rank, kind="stable"), rank


def _fits(page: np.ndarray, least: int) -> np.ndarray:
    """At which places ``least`` words follow before the page ends."""
    ends = np.concatenate((np.flatnonzero(page < 0), [len(page)]))
    return ends[np.searchsorted(ends, np.arange(len(page)))] - np.arange(len(page)) >= least


def repeated(stream: np.ndarray, page: np.ndarray, least: int = LEAST, pages: int = PAGES, also: np.ndarray | None = None) -> np.ndarray:
    """Which places of ``stream`` lie in a substring of ``least`` words or more that ``pages`` distinct pages have,
    or that starts at a place of ``also``.  Places of page -1 are ends of pages and are in none."""
    covered = np.zeros(len(stream) + 1, np.int64)
    if len(stream) >= least:
        order, rank = suffix_array(stream, least)
        order = order[_fits(page, least)[order]]
        seen = np.unique(np.stack((rank[order], page[order]), 1), axis=0)
        common = np.bincount(seen[:, 0], minlength=rank.max() + 1) >= pages
        at = order[common[rank[order]] if also is None else common[rank[order]] | also[order]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + least, -1)
    return np.cumsum(covered)[:-1] > 0


def _stream(pages_: list[list[str | None]], keys: list | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, int], dict[str, set[int]]]:
    """The pages' numbered words, their pages, the numbers, and which pages have each block.  0 is an edge of a block,
    a number below 0 the end of a page or a block left out (None).  Pages with equal ``keys`` are one."""
    number: dict[str, int] = {}
    stream, owner, whole, breaks = [], [], {}, 0
    names: dict = {}
    for k, page in enumerate(pages_):
        name = k if keys is None else names.setdefault(keys[k], k)
        for text in [*page, None]:
            if text is None:
                breaks += 1
                stream.append(-breaks)
                owner.append(-1)
                continue
            whole.setdefault(text, set()).add(name)
            stream.append(0)
            stream.extend(number.setdefault(w, len(number) + 1) for w in text.split(" "))
            owner.extend([name] * (len(stream) - len(owner)))
    return np.array(stream, np.int64), np.array(owner, np.int64), number, whole


def _runs(stream: np.ndarray, number: dict[str, int], least: int) -> np.ndarray:
    """By place the hash of the ``least`` words from there, equal in all shards; of no meaning where the page ends before."""
    word = np.array([0x9E3779B97F4A7C15, *(xxhash.xxh64_intdigest(w) for w in number)], np.uint64)
    own, out, factor = word[np.maximum(stream, 0)], np.zeros(len(stream), np.uint64), 1
    for k in range(min(least, len(stream))):
        factor = factor * 0xC2B2AE3D27D4EB4F % 2**64
        out[: len(stream) - k] += own[k:] * np.uint64(factor)
    return out.view(np.int64)


def _block(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text, 1)).view(np.int64))


def marks(pages_: list[list[str | None]], least: int = LEAST, keys: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pages' runs of ``least`` words and of their blocks, and how many of the pages have each."""
    stream, page, number, whole = _stream(pages_, keys)
    fits = _fits(page, least)
    seen = np.unique(np.stack((_runs(stream, number, least)[fits], page[fits]), 1), axis=0)
    run, n = np.unique(seen[:, 0], return_counts=True)
    return np.concatenate((run, np.array([_block(b) for b in whole], np.int64))), np.concatenate((n, np.array([len(x) for x in whole.values()], np.int64)))


def unique_runs(pages_: list[list[str | None]], least: int = LEAST, pages: int = PAGES, known: np.ndarray | None = None, keys: list | None = None) -> list[list[str]]:
    """Each page's blocks without the runs of words that ``pages`` pages share, empty where nothing is left; a block
    as a whole, however short, is such a run.  Edges of blocks count as words, so that rows of short blocks are found
    as well.  A block that is None is not looked at.  ``known``: marks of runs and blocks that as many pages share,
    these and others of the host.  Pages with equal ``keys`` are one."""
    stream, owner, number, whole = _stream(pages_, keys)
    also = None if known is None else np.isin(_runs(stream, number, least), known)
    gone = repeated(stream, owner, least, pages, also)
    blocks_known = set() if known is None else set(known.tolist())
    common = {b for b, of in whole.items() if len(of) >= pages or (blocks_known and _block(b) in blocks_known)}
    out, pos = [], 0
    for page in pages_:
        kept = []
        for text in page:
            words = text.split(" ") if text is not None else []
            left = [w for w, g in zip(words, gone[pos + 1 : pos + 1 + len(words)].tolist(), strict=True) if not g]
            pos += len(words) + 1
            kept.append("" if text in common else " ".join(left))
        pos += 1
        out.append(kept)
    return out


def _cleaned(group: pa.Table, known: np.ndarray | None = None) -> pa.Table:
    """page_id, url, text of the pages that have undecided blocks, each as often as it has rows."""
    states, texts = group["known"].to_pylist(), group["blocks"].to_pylist()
    found = unique_runs(_shown(states, texts), known=known, keys=_keys(group))
    at, out = [], []
    for k, (own, page, left, n) in enumerate(zip(states, texts, found, group["n"].to_pylist(), strict=True)):
        if OPEN in own:
            text = "\n".join(x for s, t, y in zip(own, page, left, strict=True) if (x := t if s == KEEP else y if s == OPEN else ""))
            at += [k] * n
            out += [text] * n
    rows = pa.array(at, pa.int64())
    return pa.table({"page_id": group["page_id"].take(rows), "url": group["url"].take(rows), "text": pa.array(out, pa.string())})


def _shown(states: list[list[int]], texts: list[list[str]]) -> list[list[str | None]]:
    return [[None if s == KEEP else t for s, t in zip(*both, strict=True)] for both in zip(states, texts, strict=True)]


def _keys(group: pa.Table) -> list:
    return [(i, u, tuple(b)) for i, u, b in zip(*(group[c].to_pylist() for c in ("page_id", "url", "blocks")), strict=True)]


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", body: str = "html", shard_chars: int | None = None) -> DataFrame:
    """page_id, url, text: blocks of main text in page order, joined by newlines.

    A null or empty page has an empty text, as has one of furniture only.  Every row has its result; rows equal in
    id, URL and blocks are one page when pages are counted.  A null URL is of the host that has no name.  No rows in,
    no rows out.  Texts of pages on which nothing is open are not shuffled.
    """
    rows = pick(pages, page_id=page_id, url=url, html=body)
    rows = rows.withColumn("html", F.coalesce(F.col("html").cast("string"), F.lit(""))).withColumn("host", host_of(F.col("url")))
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"

    def closed(batches):
        for batch in small(batches):
            at, out = [], []
            for k, page in enumerate(batch.column("html").to_pylist()):
                states, texts = parts(page)
                if OPEN not in states:
                    at.append(k)
                    out.append("\n".join(t for s, t in zip(states, texts, strict=True) if s == KEEP))
            keep = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(keep), batch.column("url").take(keep), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    def streams(batches):
        for batch in small(batches):
            seen: dict[tuple, int] = {}
            found: list[tuple[int, list[int], list[str]]] = []
            times: list[int] = []
            for k, (i, u, page) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)):
                if (i, u, page) in seen:
                    times[seen[i, u, page]] += 1
                    continue
                states, texts = parts(page)
                if OPEN not in states:  # only a witness: of protected blocks no more than where they are
                    shown = [(s, t if s == GONE else "") for j, (s, t) in enumerate(zip(states, texts, strict=True)) if s == GONE or j == 0 or states[j - 1] == GONE]
                    states, texts = [s for s, _ in shown], [t for _, t in shown]
                if any(s != KEEP for s in states):
                    seen[i, u, page] = len(found)
                    found.append((k, states, texts))
                    times.append(1)
            keep = pa.array([k for k, _, _ in found], pa.int64())
            new = pa.array([x for _, x, _ in found], pa.list_(pa.int8())), pa.array([x for _, _, x in found], pa.list_(pa.string())), pa.array(times, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in ("page_id", "url", "host")), *new], names=["page_id", "url", "host", "known", "blocks", "n"])

    limit = shard_chars or SHARD_CHARS
    sizes = rows.groupBy("host").agg(F.ceil(F.sum(F.length("html")) / limit).cast("int").alias("shards"))
    large = cut(sizes.where("shards > 1").withColumnRenamed("host", "h"))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    shown = mapped(rows, streams, f"page_id {kind}, url string, host string, known array<tinyint>, blocks array<string>, n int")
    shown = shown.join(large, F.col("host") == F.col("h"), "left").drop("h").withColumn("shards", F.coalesce("shards", F.lit(1)))
    shown = cut(shown.withColumn("shard", F.pmod(F.xxhash64("page_id", "url", "blocks"), F.col("shards"))))

    def marked(group: pa.Table) -> pa.Table:
        mark, n = marks(_shown(group["known"].to_pylist(), group["blocks"].to_pylist()), keys=_keys(group))
        return pa.table({"host": pa.repeat(group["host"][0], len(mark)), "shard": pa.repeat(group["shard"][0], len(mark)), "mark": mark, "n": n})

    def clean(group: pa.Table) -> pa.Table:
        return _cleaned(group)

    def clean_shard(group: pa.Table, known: pa.Table) -> pa.Table:
        return _cleaned(group, known["mark"].to_numpy())

    whole = shown.where("shards = 1").drop("shards").groupBy("host", "shard").applyInArrow(clean, schema)
    split = shown.where("shards > 1").drop("shards").groupBy("host", "shard")
    counted = split.applyInArrow(marked, "host string, shard long, mark long, n long").groupBy("host", "mark").agg(F.sum("n").alias("n"), F.collect_list("shard").alias("of"))
    known = counted.where(F.col("n") >= PAGES).select("host", F.explode("of").alias("shard"), "mark")
    return mapped(rows, closed, schema).unionAll(whole).unionAll(split.cogroup(known.groupBy("host", "shard")).applyInArrow(clean_shard, schema))


def op8_text(spark, sf_dir: str) -> DataFrame:
    """Per page: its main text and the number of its characters."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
