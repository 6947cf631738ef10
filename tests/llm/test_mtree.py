import numpy as np
from processgraph.llm import mtree as M


def brute(ids, x, k):
    out = set()
    for i, q in zip(ids, x):
        d = M.distances(x, q)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out |= {(int(i), r + 1, int(ids[j]), round(float(d[j]), 6)) for r, j in enumerate(order)}
    return out


def test_all_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 5, (6, 8))
    x = centres[rng.integers(0, 6, 700)] + rng.normal(0, 1, (700, 8))
    x[50:60] = x[40]
    ids = rng.permutation(5000)[:700]
    rows = [(int(i), v.tolist(), 1, 0.5) for i, v in zip(ids, x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, distance double")
    for cell, part in ((8192, 16384), (90, 60), (700, 50)):
        got = {tuple(r) for r in M.neighbours(frame, 5, cell=cell, part=part).collect()}
        assert got == brute(ids, x, 5)
    monkeypatch.setattr(M, "BLOCK", 10)
    got = {tuple(r) for r in M.neighbours(frame, 5, every=7, cell=90, part=60).collect()}
    assert got == {r for r in brute(ids, x, 5) if r[0] % 7 == 0}


def test_bounds_save_distances():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 20, (40, 6))[rng.integers(0, 40, 4000)] + rng.normal(0, 0.3, (4000, 6))
    tree = M.Tree(np.arange(4000), x)
    rows = next(iter(tree.leaves()))
    _, _, computed = tree.search(x[rows], rows, 5, np.full(len(rows), np.inf))
    assert computed < 0.3 * len(rows) * 4000


def test_edges(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0]), (3, [3.0, 4.0]), (4, None), (None, [1.0, 1.0]), (5, [nan, 0.0]), (6, [1.0]), (7, []), (8, [None, 1.0])]
    got = {tuple(r) for r in M.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 1, 2, 0.0), (1, 2, 3, 5.0), (2, 1, 1, 0.0), (2, 2, 3, 5.0), (3, 1, 1, 5.0), (3, 2, 2, 5.0)}
    assert M.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = M.neighbours(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"))
    assert one.count() == 0
