import itertools
import random

import numpy as np
from processgraph.llm import neardup as N
from processgraph.llm.components import components


def shingled(text):
    w = text.lower().split()
    return set(zip(w, w[1:], w[2:])) if len(w) > 2 else ({tuple(w)} if w else set())


def corpus(prose):
    r, rows = random.Random(3), []
    for k in range(60):
        base = prose(k, 80).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(k % 4):
            w = list(base)
            for _ in range(k % 7):
                w[r.randrange(len(w))] = "changed%d" % r.randrange(99)
            rows.append((len(rows), " ".join(w)))
    return rows + [(len(rows) + k, "exactly the same words in every copy of it") for k in range(12)]


def brute(rows, least):
    sets = {d: shingled(t) for d, t in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_groups_against_brute_force(spark, table, prose):
    rows = corpus(prose)
    for leaf in (400, 4):
        got = {r.doc_id: r.group_id for r in N.near_duplicates(table(rows), leaf=leaf).collect()}
        assert set(got) == {d for d, _ in rows}
        sure = brute(rows, 0.6)
        assert sum(got[a] == got[b] for a, b in sure) >= 0.95 * len(sure)
        root = {d: d for d, _ in rows}
        for a, b in sorted(brute(rows, 0.35)):
            x, y = root[a], root[b]
            root = {d: min(x, y) if v in (x, y) else v for d, v in root.items()}
        assert all(root[d] == root[g] for d, g in got.items())
        assert all(g <= d and got[g] == g for d, g in got.items())


def test_edges_and_empty(spark, table, edges):
    got = {r.doc_id: r.group_id for r in N.near_duplicates(table(edges)).collect()}
    assert got == {d: d for d, _ in edges if d is not None}
    assert N.near_duplicates(table([])).count() == 0
    kept = N.drop_near_duplicates(table(edges))
    assert kept.columns == table([]).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(d) for d, _ in edges})
    assert N.drop_near_duplicates(table([])).count() == 0


def test_one_of_each_group_stays(spark, table, prose):
    rows = corpus(prose)
    kept = {r.doc_id for r in N.drop_near_duplicates(table(rows)).collect()}
    groups = {r.doc_id: r.group_id for r in N.near_duplicates(table(rows)).collect()}
    assert kept == set(groups.values())


def test_exhaust_links_what_all_pairs_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**32, (5, N.TOKENS), dtype=np.uint32)
    sig = base[rng.integers(0, 5, 70)].copy()
    sig[rng.random(sig.shape) < 0.3] = 1
    want = [(i, j) for i in range(70) for j in range(i) if (sig[i] == sig[j]).sum() >= N.THRESHOLD * N.TOKENS]

    def parts(links):
        label = list(range(70))
        for i, j in links:
            x, y = label[i], label[j]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    assert parts(N.exhaust(sig)) == parts(want)
    a, b = N._groups(np.zeros(20, int), np.arange(20), sig[:20], N.THRESHOLD)
    small = [(i, j) for i, j in want if i < 20]
    assert parts(zip(np.concatenate(a).tolist(), np.concatenate(b).tolist())) == parts(small)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
