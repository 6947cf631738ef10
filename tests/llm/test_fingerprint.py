import numpy as np
from processgraph.llm import fingerprint as P
from processgraph.llm.textnp import U64, text_shingles


def shingles(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return text_shingles(raw, np.array([0, len(raw)]), P.SHINGLE)[0]


def brute(text):
    """Bin by bin, with the same hashes."""
    least = {}
    for h in map(int, shingles(text)):
        b, v = h >> 56, (h >> 8) & 0x7FFFFFFF
        least[b] = min(least.get(b, 1 << 40), v)
    out = []
    for b in range(P.BINS):
        at, attempt = b, 0
        while at not in least:
            attempt += 1
            at = int(P.mix(np.array([b * 0x10001 + (attempt << 32)], U64))[0] % U64(P.BINS))
        out.append(least[at])
    return out


def test_bins_against_brute_force_and_packing(spark, table, prose):
    texts = [prose(k, n) for k, n in enumerate([1, 2, 3, 10, 80, 600])]
    got = {r.doc_id: r for r in P.fingerprints(table(list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        want = P.pack(np.array([brute(t)], np.uint32))[0].tobytes()
        assert bytes(got[k].fingerprint) == want and len(want) == P.BINS * P.BITS // 8
        assert got[k].n_shingles == max(1, len(t.split()) - 2)


def test_estimates_are_unbiased(spark, table, prose):
    errors = []
    for k in range(30):
        base = prose(k, 300).split()
        other = base[: 10 * (k % 30)] + prose(1000 + k, 300 - 10 * (k % 30)).split()
        a, b = set(shingles(" ".join(base)).tolist()), set(shingles(" ".join(other)).tolist())
        x, y = (P.pack(P.densify(P.bins(s, np.array([0, len(s)]))))[0].tobytes() for s in (shingles(" ".join(base)), shingles(" ".join(other))))
        errors.append(P.similarity(x, y) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15
    assert P.similarity(x, x) == 1 and P.similarity(None, x) is None


def test_edges(spark, table, edges):
    out = P.fingerprints(table(edges)).collect()
    assert len(out) == len(edges)
    by = {r.doc_id: r for r in out}
    assert all(by[k].fingerprint is None and by[k].n_shingles == 0 for k in (1, 2, 3)) and by[4].n_shingles == 1
    same = [bytes(r.fingerprint) for r in out if r.doc_id == 8]
    assert len(same) == 2 and same[0] == same[1]
    assert P.fingerprints(table([])).count() == 0
