import random

import pytest
from tokenizers.models import WordPiece

from conjunx.llm import token_count as T


def greedy(word, vocabulary):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


@pytest.mark.parametrize("seed", range(30))
def test_random_vocabularies(seed):
    draw = random.Random(seed)
    letters = b"abc"
    vocabulary = {bytes(draw.choices(letters, k=draw.randint(1, 6))) for _ in range(draw.randint(1, 25))}
    words = [bytes(draw.choices(letters, k=draw.randint(1, 90))) for _ in range(60)]
    got = T.LongestMatch(sorted(vocabulary)).counts(words).tolist()
    assert got == [greedy(w, vocabulary) for w in words]


def test_against_a_library(spark, data):
    of = {b: c for c, b in T._bytes_of().items()}
    tokens = T.load_vocabulary(T.VOCABULARY)
    names = {"".join(of[b] for b in t): k for k, t in enumerate(tokens)} | {"[UNK]": len(tokens)}
    model = WordPiece(names, unk_token="[UNK]", continuing_subword_prefix="", max_input_chars_per_word=10**6)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in T.op2_tokens(spark, data).collect():
        words = T.WORD.findall(docs[r.doc_id].lower())
        assert r.n_words == len(words)
        assert r.n_tokens == sum(len(model.tokenize("".join(of[b] for b in w.encode()))) for w in words)


def test_edges(frame, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 50)
    long = "abcab" * 40000
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "abc ABC q"), (5, long), (4, "abc ABC q"), (None, "a")]
    got = [tuple(r) for r in T.token_counts(frame(rows, clash=True), [b"ab", b"c", b"a", b"b", b"abcd"]).collect()]
    assert got == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 3, 5), (5, 1, 120000), (4, 3, 5), (None, 1, 1)]
    assert T.token_counts(frame([]), [b"a"]).count() == 0
    assert T.LongestMatch([]).counts([b"ab"]).tolist() == [1]


def test_many_pops():
    """More tokens are popped at once than a byte counts."""
    run = b"a" * 300
    automaton = T.LongestMatch([b"a", b"c", run + b"b"])
    assert automaton.counts([run + b"c", run + b"b", run, b"c" + run * 2]).tolist() == [301, 1, 300, 601]
    assert automaton._one(run + b"c") == 301
