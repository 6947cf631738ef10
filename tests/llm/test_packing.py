import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from processgraph.llm import bpe
from processgraph.llm import packing as K

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")


def best_sum(items, capacity):
    reach = {0}
    for x in items:
        reach |= {s + x for s in reach if s + x <= capacity}
    return max(reach)


def test_fill_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        items = [r.randrange(1, 40) for _ in range(r.randrange(1, 14))]
        capacity = r.randrange(1, 120)
        if min(items) > capacity:
            continue
        counts = Counter(items)
        got = K.fill(sorted(counts.items(), reverse=True), capacity)
        assert all(0 < n <= counts[x] for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == best_sum(items, capacity)


def test_each_window_is_closest_to_capacity():
    r = random.Random(2)
    left = Counter(r.randrange(1, 60) for _ in range(200))
    for choice, times in K.pack_lengths(dict(left), 64):
        for _ in range(times):
            assert sum(x * n for x, n in choice.items()) == best_sum(list(left.elements()), 64)
            left.subtract(choice)
            assert min(left.values()) >= 0
            left = +left
    assert not left


def test_pieces_cover_every_token_once(spark, table, prose):
    rows = [(k, prose(k, n)) for k, n in enumerate([1, 5, 64, 65, 200, 63, 32, 32, 128, 10, 54] * 4)]
    coder = bpe.Coder(bpe.load())
    flat, to = coder.encode([x for _, x in rows])
    tokens = {d: list(flat[a:b]) for (d, _), a, b in zip(rows, to, to[1:])}
    for shard_docs in (20_000, 10):
        out = K.pack(table(rows), capacity=64, shard_docs=shard_docs).collect()
        seen = {(r.doc_id, r.start + k): t for r in out for k, t in enumerate(r.ids)}
        assert len(seen) == sum(r.n_tokens for r in out) and seen == {(d, k): t for d, x in tokens.items() for k, t in enumerate(x)}
        windows = {}
        for key, group in itertools.groupby(sorted(out, key=lambda r: (r.shard, r.window, r.position)), key=lambda r: (r.shard, r.window)):
            at = 0
            for r in group:
                assert r.position == at and len(r.ids) == r.n_tokens
                at += r.n_tokens
            assert 0 < at <= 64
            windows[key] = [r for r in out if (r.shard, r.window) == key]
        for shard in {s for s, _ in windows}:  # each window as full as the items left at its turn allow
            left = Counter(r.n_tokens for r in out if r.shard == shard and not (r.n_tokens == 64 and len(tokens[r.doc_id]) > r.n_tokens or r.n_tokens == 64))
            for w in sorted(w for s, w in windows if s == shard):
                own = [r.n_tokens for r in windows[shard, w]]
                if own != [64]:
                    assert sum(own) == best_sum(list(left.elements()), 64)
                    left.subtract(own)
            assert not +left


def test_edges(spark, table, edges):
    out = K.pack(table(edges)).collect()
    flat, to = bpe.Coder(bpe.load()).encode([t for d, t in edges if d is not None])
    assert sum(r.n_tokens for r in out) == len(flat)
    assert {r.doc_id for r in out} == {3, 4, 5, 6, 7, 8, 9, 10}
    assert K.pack(table([])).count() == 0
    named = spark.createDataFrame([("7", "a b"), ("x", "c")], "doc_id string, text string")
    assert [r.doc_id for r in K.pack(named).collect()] == [7]


TEXTS = ["a  b\n\nc \t d", "'s 's it's ''s we're'd x've'll y'm'tz 'Q a'", " leading and trailing  ", "12ab² ½三 1'2'3 'red 'vex", "\u00a0nbsp\u00a0 x\u2003\u2003y \u3000z", "日本語 テスト😀😀 naïve façade", "", "\n", " '", "w" * 300 + " " + "ab" * 500, "é" * 40 + "x" * 129 + "y" * 128, "\x1c\x1d \x85x \x00"]


def test_tokens_of_whole_batches_against_a_coder(monkeypatch):
    """The same as bpe has, whatever the words, and also where hashes collide and where words are forgotten."""
    from processgraph.llm import tokens as T

    r = random.Random(3)
    signs = "abstrevmld'' \n\t 019.,!-éßЖ語½\u00a0\u2009😀"
    texts = TEXTS + ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(1500)] + ["".join(r.choice("aeinrstlo") for _ in range(r.randrange(1, 150))) for _ in range(150)]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"skipped" + b"".join(raw), np.uint8), 7 + np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    words = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in bpe.cut_words(t)))}
    ids, sizes = bpe.Coder(bpe.load()).contract([w.encode() for w in words])
    of = np.split(ids, np.cumsum(sizes)[:-1])
    per = [np.concatenate([of[words[w]] for w in bpe.cut_words(t)] or [ids[:0]]) for t in texts]
    flat, bounds = np.concatenate(per), np.concatenate([[0], np.cumsum([len(x) for x in per])])
    encoder = T.Encoder(bpe.load(), T.classes())
    for k in range(4):
        if k == 1:
            monkeypatch.setattr(T, "CACHE", 100)
        if k == 2:
            monkeypatch.setattr(T, "HASHED", 50)
        if k == 3:
            monkeypatch.setattr(T, "word_hashes", lambda buf, starts, ends, fold: np.asarray(ends - starts, np.uint64) % np.uint64(5))
        got, to = encoder.encode(buf, off)
        assert (to == bounds).all() and (got == flat).all()


def test_tokens_are_kept_as_small_as_the_vocabulary_allows(spark, table, prose, monkeypatch):
    """Two bytes a token in the checkpoint folder and in the shuffle; four for a vocabulary of more tokens gives the same rows."""
    kept = []
    cut = K.cut
    monkeypatch.setattr(K, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    frame = table([(k, prose(k, 300)) for k in range(20)])
    want = sorted(map(tuple, K.pack(frame).collect()))
    assert kept[0].where("octet_length(ids) = 2 * n").count() == 20
    load = bpe.load
    monkeypatch.setattr(bpe, "load", lambda path: load(path) | {"tokens": load(path)["tokens"] | {b"\xff" * 99: 70_000}})
    assert sorted(map(tuple, K.pack(frame).collect())) == want
    assert kept[1].where("octet_length(ids) = 4 * n").count() == 20
