import os

import pytest
from processgraph.llm import bpe as B

pytestmark = pytest.mark.skipif(not os.path.exists(B.VOCABULARY), reason="no vocabulary file")
TEXTS = ["Hello world, it's  a test.\n\n  Two   spaces ", "naïve façade 12²½三 ok", "日本語 テスト 😀😀", "'tis they'll we've", "x" * 500 + "ab" * 400, " " * 90, "!!!!????" * 30, "   mixed\r\n\tspace"]


def test_same_as_a_known_encoder(spark, table):
    tiktoken = pytest.importorskip("tiktoken")
    pat = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    own = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=B.load()["tokens"], special_tokens={})
    got = {r.doc_id: r for r in B.encode(table(list(enumerate(TEXTS)))).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k].ids == own.encode_ordinary(t) and got[k].exact and got[k].n_tokens == len(got[k].ids)


def _known():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("word", pat_str=r"[\s\S]+", mergeable_ranks=B.load()["tokens"], special_tokens={})


def _contracted(words):
    ids, sizes = B.Coder(B.load()).contract([w.encode() for w in words])
    to = [0, *sizes.cumsum()]
    return [list(ids[a:b]) for a, b in zip(to, to[1:])]


def test_contractions_of_one_round_commute():
    import random

    r, known = random.Random(5), _known()
    tokens = [t.decode() for t in B.load()["tokens"] if all(32 <= b < 127 for b in t)]
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    words += ["".join(r.choice(tokens) for _ in range(r.randint(1, 8))) for _ in range(1500)]
    words += ["".join(r.choice("aeinrst") for _ in range(r.randint(1, 4))) * r.randint(1, 40) + r.choice(["", "a", "x"]) for _ in range(1500)]
    words = list(dict.fromkeys(words))
    assert _contracted(words) == [known.encode_ordinary(w) for w in words]


def test_many_and_very_long_words():
    import numpy as np

    r, known = np.random.default_rng(1), _known()
    words = [bytes(x).decode() for x in r.integers(97, 123, (4000, 150)).astype(np.uint8)]
    assert _contracted(words) == [known.encode_ordinary(w) for w in words]
    for w in (bytes(r.integers(97, 123, 1_000_000).astype(np.uint8)).decode(), "na" * 200_000):
        (ids,) = _contracted([w])
        assert b"".join(known.decode_single_token_bytes(t) for t in ids) == w.encode()
        assert ids[:2000] == known.encode_ordinary(w[:20_000])[:2000]


def test_rounds_continue_where_a_query_stopped(monkeypatch):
    known = _known()
    monkeypatch.setattr(B, "ROWS", 1)
    words = [" international", "ababababab", "aaaaaaaaaaaaa", "0000111", "", "x"]
    assert _contracted(words) == [known.encode_ordinary(w) if w else [] for w in words]


def test_edges_and_round_trip(spark, table, edges):
    out = B.encode(table(edges)).collect()
    assert len(out) == len(edges)
    by = {r.doc_id: r for r in out}
    assert by[1].ids is None and by[1].exact is None and by[2].ids == [] and by[2].exact
    assert all(r.exact for r in out if r.ids is not None)
    assert B.encode(table([])).count() == 0
    back = {r.doc_id: r.text for r in B.decode(B.encode(table(edges))).collect()}
    assert back == dict(edges)
    odd = spark.createDataFrame([(1, [10_000_000]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in B.decode(odd).collect()} == {1: "", 2: None, 3: ""}
