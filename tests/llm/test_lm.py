import math
from collections import Counter

import numpy as np
import pytest
from processgraph.llm import lm as M
from processgraph.llm import queries
from processgraph.llm.textnp import U64


def grams(texts, order=M.ORDER):
    """(order, bytes) to count; an n-gram lies inside one text."""
    out = Counter()
    for t in texts:
        raw = (t or "").encode()
        out[0, b""] += len(raw)
        for n in range(1, order + 1):
            for k in range(n, len(raw) + 1):
                out[n, raw[k - n : k]] += 1
    return out


def key(n, raw):
    return (int.from_bytes(raw, "big") | n << 56) if n else 0


def test_counts_against_brute_force(spark, table, prose):
    texts = [prose(k, 30) for k in range(20)] + ["", None, "é", "ab"]
    want = {key(n, g): c for (n, g), c in grams(texts).items()}
    got = {r.key & (2**64 - 1): r.n for r in M.counts(table(list(enumerate(texts)))).collect()}
    assert got == want


def test_filter_is_never_too_low_and_seldom_too_high():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 20_000).astype(U64)
    count = rng.zipf(1.5, 20_000).clip(1, 10**6)
    levels = M.level(count)
    segments = -(-int(levels.sum()) * M.BITS // M.SEGMENT)
    at = M.segment_of(keys, segments)
    f = M.Filter(np.concatenate([M.segment_bits(keys[at == s], levels[at == s]) for s in range(segments)]), segments)
    got = f.levels(keys)
    assert (got >= levels).all() and (got > levels).mean() < 0.02
    assert (f.levels(rng.integers(0, 2**63, 20_000).astype(U64)) > 0).mean() < 0.02
    assert (np.abs(M.size_of(levels) / count - 1) <= 0.5).all()


def test_scores_against_brute_force(spark, table, prose):
    texts = [prose(k, 60) for k in range(25)]
    frame = table(list(enumerate(texts)))
    held = grams(texts)

    def quantised(n, raw):
        c = held[n, raw]
        return float(M.size_of(M.level(np.array([c])))[0]) if c else 0.0

    def total(text):
        raw, out = text.encode(), 0.0
        for k in range(len(raw)):
            p = 1 / 256
            for n in range(1, min(M.ORDER, k + 1) + 1):
                own, before = quantised(n, raw[k - n + 1 : k + 1]), quantised(n - 1, raw[k - n + 1 : k])
                p = (own + M.MASS * p) / (max(before, own) + M.MASS)
            out += math.log(p)
        return out

    got = {r.doc_id: r for r in M.score(frame, M.fit(frame)).collect()}
    for k in (0, 7, 24):
        assert abs(got[k].log_prob - total(texts[k])) < 0.02 * abs(total(texts[k]))
        assert abs(got[k].perplexity - math.exp(-got[k].log_prob / got[k].n_bytes)) < 1e-9
    noise = M.score(table([(1, "xq#zj vkw" * 20)]), M.fit(frame)).first()
    assert noise.perplexity > 3 * got[0].perplexity


def test_edges(spark, table, edges):
    model = M.fit(table(edges))
    out = M.score(table(edges), model).collect()
    assert len(out) == len(edges)
    by = {r.doc_id: r for r in out}
    assert all(by[k].n_bytes == 0 and by[k].log_prob == 0 and by[k].perplexity is None for k in (1, 2)) and by[7].n_bytes == 150_000
    assert M.score(table([]), model).count() == 0
    empty = M.fit(table([]))
    assert abs(M.score(table([(1, "ab")]), empty).first().perplexity - 256) < 1e-6


def test_words_before_a_word_count(spark, table, prose):
    """Counts of word n-grams against brute force, and a score that word order and repeated passages change."""
    texts = [prose(k, 200) for k in range(20)] + ["", None, "é  ab\n"]
    frame = table(list(enumerate(texts)))
    longer = M.fit_words(frame)
    want = Counter(tuple(w[k : k + n]) for w in ((t or "").split() for t in texts) for n in range(1, M.WORDS + 1) for k in range(len(w) - n + 1))
    data = np.frombuffer(texts[0].encode(), np.uint8)
    keys = M.word_keys(data, np.array([0, len(data)]))[3]
    w = texts[0].split()
    for n in range(M.WORDS):
        got = longer.counts(keys[n][n:])
        exact = M.size_of(M.level(np.array([want[tuple(w[k - n : k + 1])] for k in range(n, len(w))])))
        assert (got >= exact).all() and (got > exact).mean() < 0.05
    assert longer.total == sum(len((t or "").split()) for t in texts)
    model = M.fit(frame)
    turned = " ".join(reversed(w))
    own, other = (M.score(table([(1, t)]), model, words=longer).first() for t in (texts[0], turned))
    short, turned_short = (M.score(table([(1, t)]), model).first() for t in (texts[0], turned))
    assert own.n_bytes == other.n_bytes == len(data)
    assert own.log_prob - other.log_prob > 2 * abs(short.log_prob - turned_short.log_prob) + 50
    assert M.score(table([(1, None), (2, "")]), model, words=longer).where("log_prob = 0 and perplexity is null").count() == 2
    nothing = M.fit_words(table([]))
    assert nothing.total == 0 and M.score(table([(1, "ab")]), model, words=nothing).count() == 1


def test_corpus_is_scored_without_the_whole_filter(spark, table, prose, edges, tmp_path, monkeypatch):
    """The same rows as with a filter that is broadcast, also of chunks that repeat, and beyond LIMIT_MB."""
    texts = [prose(k % 30, 150) for k in range(40)] + ["same words again " * 400]
    frame = table([*enumerate(texts), *edges, (50, None)])
    want = M.score(frame, M.fit(frame), words=M.fit_words(frame)).collect()
    row = lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_bytes, round(r.log_prob, 5), r.perplexity and round(r.perplexity, 6))
    assert sorted(map(row, M.score_corpus(frame).collect()), key=str) == sorted(map(row, want), key=str)
    one = table([(k, texts[0]) for k in range(3)]).coalesce(1)
    assert [r.n_bytes for r in M.score_corpus(one.union(one)).collect()] == [len(texts[0])] * 6
    assert M.score_corpus(table([])).count() == 0
    assert M.score_corpus(table([(1, None), (2, "")])).where("log_prob = 0 and perplexity is null").count() == 2
    large = table([(k, prose(100 + k, 3000)) for k in range(30)])
    want = sorted(map(row, M.score(large, M.fit(large), words=M.fit_words(large)).collect()))
    large.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(M, "LIMIT_MB", 0.14)
    with pytest.raises(ValueError, match="filter of words"):
        M.fit_words(large)
    assert sorted(map(row, queries.op8_language_model(spark, str(tmp_path)).collect())) == want
