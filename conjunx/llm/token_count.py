"""Counts of word pieces by a linear longest-match automaton: greedy longest match without building the pieces.

A trie of the vocabulary gets failure links: where a node has no child for the next byte, the link leads to the
node of what remains unmatched after the longest tokens of the node's string are popped, and how many are popped
is precomputed.  Links are followed at build time for every node and byte, so that counting takes one look-up a
byte, however long the word.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunx.llm.common import mapped, pick, pieces, small, table

#: Where the query finds a vocabulary: the session's setting of this name, or else here.
VOCABULARY_SETTING, VOCABULARY = "spark.conjunx.vocabulary", "/opt/tokenizers/word_bpe_49k.json"
END = "</w>"
#: Contractions, runs of letters, single digits, runs of other symbols: the words of this vocabulary.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words whose counts a worker remembers, and characters that it looks at together; a longer text comes in pieces.
REMEMBERED, CHUNK = 500_000, 2_000_000
#: Words of more bytes are walked one by one, others side by side.
LONG = 64


def _bytes_of() -> dict[str, int]:
    """The usual printable stand-ins of bytes: printable Latin-1 stands for itself, the rest for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str, end: str = END) -> list[bytes]:
    """The distinct tokens as bytes, without their end-of-word mark."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    of = _bytes_of()
    return sorted({bytes(of[c] for c in t.removesuffix(end)) for t in tokens if t.removesuffix(end)})


class LongestMatch:
    """The automaton.  State 0 is the root; the last state is dead: a word that comes there is one unknown token."""

    def __init__(self, tokens: list[bytes]):
        children: list[dict[int, int]] = [{}]
        parent, byte, is_token = [0], [0], [False]
        for token in tokens:
            at = 0
            for b in token:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    parent.append(at)
                    byte.append(b)
                    is_token.append(False)
                at = children[at][b]
            is_token[at] = at > 0
        n = len(children)
        self.dead = n
        self.to = np.full((n + 1, 256), n, np.int32)
        self.pops = np.zeros((n + 1, 256), np.min_scalar_type(max(map(len, tokens), default=1)))  # a node pops no more tokens than it has bytes
        self.flush = np.zeros(n + 1, np.int32)
        link, popped = [n] * (n + 1), [0] * (n + 1)
        level = [0]
        while level:  # by depth: links lead to shallower nodes
            for v in level:
                if v:
                    if is_token[v]:
                        link[v], popped[v] = 0, 1
                    elif (z := link[parent[v]]) != n:
                        link[v] = int(self.to[z, byte[v]])
                        popped[v] = popped[parent[v]] + int(self.pops[z, byte[v]])
                    if link[v] != n:
                        self.to[v] = self.to[link[v]]
                        self.pops[v] = self.pops[link[v]] + popped[v]
                        self.flush[v] = -1 if self.flush[link[v]] < 0 else self.flush[link[v]] + popped[v]
                    else:
                        self.flush[v] = -1
                for b, c in children[v].items():
                    self.to[v, b], self.pops[v, b] = c, 0
            level = [c for v in level for c in children[v].values()]
        self.flush[n] = -1

    def _one(self, word: bytes) -> int:
        state = n = 0
        to, pops = self.to, self.pops
        for b in word:
            n += int(pops[state, b])
            state = int(to[state, b])
        return 1 if self.flush[state] < 0 else n + int(self.flush[state])

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each word; 1 for a word that the vocabulary cannot spell, 0 for an empty one."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        long = int(np.searchsorted(-sizes[order], -LONG))
        out = np.zeros(len(words), np.int64)
        for k in order[:long].tolist():
            out[k] = self._one(words[k])
        order = order[long:]
        flat = np.frombuffer(b"".join(words[k] for k in order.tolist()), np.uint8)
        sizes = sizes[order]
        starts = np.cumsum(sizes) - sizes
        state, n = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            k = int(np.searchsorted(-sizes, -t, side="left"))
            b = flat[starts[:k] + t]
            n[:k] += self.pops[state[:k], b]
            state[:k] = self.to[state[:k], b]
        end = self.flush[state]
        out[order] = np.where(end < 0, 1, n + end)
        return out


@functools.lru_cache(maxsize=2)
def _automaton(tokens: tuple[bytes, ...]) -> tuple[LongestMatch, dict[str, int]]:
    return LongestMatch(list(tokens)), {}


def count_texts(texts: list[str], automaton: LongestMatch, known: dict[str, int]) -> tuple[list[int], list[int]]:
    """Words and pieces of each text; ``known`` holds the counts of words seen before."""
    parts = [WORD.findall(t.lower()) for t in texts]
    new = list({w for p in parts for w in p}.difference(known))
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list({w for p in parts for w in p})
    known.update(zip(new, automaton.counts([w.encode() for w in new]).tolist(), strict=True))
    return [len(p) for p in parts], [sum(map(known.__getitem__, p)) for p in parts]


def token_counts(docs: DataFrame, vocabulary: list[bytes], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every row's whole text, lower-cased.  Null and empty texts have 0 of both; a
    word that the vocabulary cannot spell is one token.  Rows are independent; there is no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))
    plain = pick(docs, doc_id=doc_id, text=text)

    def run(batches):
        automaton, known = _automaton(shared.value)
        for batch in small(batches):
            counts = np.zeros((2, batch.num_rows), np.int64)
            rows, part, size = [], [], 0
            for row, t in enumerate(batch.column("text").to_pylist()):
                for _, piece in pieces(t or "", CHUNK):
                    rows.append(row)
                    part.append(piece)
                    size += len(piece)
                    if size > CHUNK:
                        np.add.at(counts, (slice(None), rows), count_texts(part, automaton, known))
                        rows, part, size = [], [], 0
            if part:
                np.add.at(counts, (slice(None), rows), count_texts(part, automaton, known))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts[0]), pa.array(counts[1])], names=["doc_id", "n_words", "n_tokens"])

    return mapped(plain, run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")


def op2_tokens(spark, sf_dir: str) -> DataFrame:
    """Per document: words, and word pieces by greedy longest match."""
    path = spark.conf.get(VOCABULARY_SETTING, VOCABULARY)
    return token_counts(table(spark, sf_dir, "documents"), load_vocabulary(path))
