import random

import numpy as np
from processgraph.llm import langid as L

EN = "the house and water with stone where people think about nothing which should have been there".split()
DE = "das haus und wasser mit stein welche leute denken über nichts die schon dort gewesen wären zwischen".split()


def texts(words, n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(30)) for _ in range(n)]


MODEL = L.fit_texts(texts(EN, 60, 1) + texts(DE, 60, 2), ["en"] * 60 + ["de"] * 60)


def brute(scores, switch):
    """Viterbi for one document, word by word."""
    n, k = scores.shape
    best, back = scores[0].astype(float), []
    for t in range(1, n):
        step = [[best[a] - (switch if a != b else 0) for a in range(k)] for b in range(k)]
        back.append([int(np.argmax(s)) for s in step])
        best = np.array([max(s) for s in step]) + scores[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    total = lambda p: sum(scores[t, s] for t, s in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
    return total(path[::-1]), total


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 2, 9, 30, 0, 17]
    scores = -rng.exponential(3, (sum(sizes), 3)).astype(np.float32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got = L.viterbi(scores, bounds, 4.0)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            want, total = brute(scores[a:b], 4.0)
            assert abs(total(got[a:b].tolist()) - want) < 1e-3


def test_spans_of_mixed_text(spark, table):
    mixed = texts(EN, 1, 5)[0] + " " + texts(DE, 1, 6)[0] + " Это русский текст 12 345"
    row = L.identify(table([(1, mixed)]), MODEL).first()
    assert [s.lang for s in row.spans] == ["en", "de", "ru"]
    assert row.spans[0].start == 0 and row.spans[-1].end == row.n_words == 65
    assert all(a.end == b.start for a, b in zip(row.spans, row.spans[1:]))
    assert abs(row.spans[0].end - 30) <= 2


def test_held_out_accuracy(spark, table):
    rows = [(k, t, "en") for k, t in enumerate(texts(EN, 40, 9))] + [(40 + k, t, "de") for k, t in enumerate(texts(DE, 40, 10))]
    got = L.identify(table(rows), L.fit(table(rows))).collect()
    want = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang == want[r.doc_id] for r in got]) > 0.97
    kept = L.keep_identified(table(rows + [(90, "12 34 ..", "en"), (91, "Это русский текст", "en")]), MODEL)
    assert kept.columns == table([]).columns and {r.doc_id for r in kept.collect()} == set(range(80))


def test_edges(spark, table, edges):
    got = L.identify(table(edges), MODEL).collect()
    assert len(got) == len(edges)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang == "und" and by[k].share == 0 and not by[k].spans for k in (1, 2, 3))
    assert by[6].n_words == 60_000 and by[7].n_words == 1
    assert L.identify(table([]), MODEL).count() == 0 and L.keep_identified(table([]), MODEL).count() == 0
    nothing = L.fit(table([]))
    assert {r.lang for r in L.identify(table([(1, "текст"), (2, "")]), nothing).collect()} == {"ru", "und"}


def test_rare_languages_of_a_large_table_are_known(spark, table):
    """A share of 1 in 1,000, and a bound that most documents exceed."""
    fr = "la maison et eau avec pierre où les gens pensent rien qui aurait dû être là depuis toujours".split()
    rows = [(k, t, "en") for k, t in enumerate(texts(EN, 4000, 11))] + [(4000 + k, t, "fr") for k, t in enumerate(texts(fr, 4, 12))]
    rows += [(5000 + k, "Это русский текст о доме и воде", "ru") for k in range(4)] + [(None, "το σπίτι και το νερό", "el")]
    frame = table(rows + [(6000 + k, "no language is named", None) for k in range(4000)])
    model = L.fit(frame, most=100)
    assert model["langs"] == ["el", "en", "fr", "ru"]
    kept = [r.doc_id for r in L.keep_identified(frame, model).where("doc_id >= 4000 and doc_id < 6000").collect()]
    assert sorted(kept) == [4000, 4001, 4002, 4003, 5000, 5001, 5002, 5003]
    assert {r.lang for r in L.identify(frame.where("lang = 'fr'"), model).collect()} == {"fr"}


def test_sample_is_bounded_by_language():
    assert L.quotas({"en": 10**7, "de": 10**6, "el": 3}, 3000) == {"el": 3, "de": 1498, "en": 1499}
    assert sum(L.quotas({f"l{k}": 5 + k for k in range(1000)}, 3000).values()) <= 1000 * L.LEAST_DOCS
