import numpy as np
import pyarrow as pa
from processgraph.llm import quality as Q
from processgraph.llm.textnp import utf8


def texts(prose, n):
    good = [prose(k, 20 + k % 50) for k in range(n)]
    return good, [t.upper().replace(" ", "!! ") if k % 2 else t.replace(" ", "%%% ") for k, t in enumerate(good)]


def fitted(prose):
    good, bad = texts(prose, 150)
    return Q.fit_arrays(*utf8(pa.array(good + bad)), np.array([1] * 150 + [0] * 150), epochs=8)


def slow(text, m):
    """The network byte by byte."""
    raw = list(text.encode())
    n = -(-(len(raw) + Q.KERNEL - 1) // Q.HALF) * Q.HALF
    raw += [0] * (n + Q.KERNEL - len(raw))
    logits = []
    for c in range(max(1, n // Q.HALF - 1)):
        span = range(c * Q.HALF, min(n, c * Q.HALF + Q.CHUNK))
        top = np.max([sum(m["embed"][raw[i + k]] @ m["filters"][k] for k in range(Q.KERNEL)) + m["bias"] for i in span], 0)
        logits.append(np.maximum(top, 0) @ m["out"] + m["out_bias"][0])
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_held_out_accuracy_and_plain_network(prose):
    m = fitted(prose)
    good, bad = texts(prose, 400)
    p = Q.score(*utf8(pa.array(good[150:] + bad[150:])), m)
    assert (p[:250] >= 0.5).mean() > 0.95 and (p[250:] < 0.5).mean() > 0.95
    for t in ["x", good[3], bad[4], "é" * 40, "a" * 61, "b" * 64, "c" * 65]:
        assert abs(Q.score(*utf8(pa.array([t])), m)[0] - slow(t, m)) < 1e-4


def test_tables(spark, table, edges, prose):
    good, bad = texts(prose, 40)
    rows = [(k, t) for k, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    m = Q.fit(table(rows), labels)
    got = {r.doc_id: r.prob for r in Q.classify(table(rows), m).collect()}
    assert np.mean([(got[k] >= 0.5) == (k < 40) for k in range(80)]) > 0.9
    kept = Q.keep_good(table(rows), m)
    assert kept.columns == table([]).columns and {r.doc_id for r in kept.collect()} == {k for k in got if got[k] >= 0.5}
    out = Q.classify(table(edges), m).collect()
    assert len(out) == len(edges) and all(r.prob == 0 for r in out if r.doc_id in (1, 2))
    assert Q.classify(table([]), m).count() == 0 and Q.keep_good(table([]), m).count() == 0
    assert {1, 2}.isdisjoint(r.doc_id for r in Q.keep_good(table(edges), m, least=0.0).collect())
    alone = Q.fit(table(rows), labels.where("quality = 1"))
    assert Q.keep_good(table(rows), alone).count() == 80
