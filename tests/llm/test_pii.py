import random

import numpy as np
from processgraph.llm import pii as P


def luhn_number(r, start="4"):
    head = start + "".join(r.choice("0123456789") for _ in range(15 - len(start)))
    return next(head + c for c in "0123456789" if P.luhn(head + c))


def planted(prose, n=120):
    """Texts with true spans, and with numbers that only look like cards."""
    r, rows, truth = random.Random(4), [], {}
    for k in range(n):
        kinds = {
            "EMAIL": f"{r.choice('abcdef')}{r.randrange(99)}.x@mail{r.randrange(9)}.example.com",
            "PHONE": f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}",
            "IP": ".".join(str(r.randrange(1, 255)) for _ in range(4)),
            "CARD": luhn_number(r),
            "SECRET": 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"',
        }
        kind = P.KINDS[k % 5]
        fake = "7" + "".join(r.choice("0123456789") for _ in range(15))
        while P.luhn(fake):
            fake = str(int(fake) + 1)
        value = kinds[kind].split('"')[1] if kind == "SECRET" else kinds[kind]
        rows.append((k, f"{prose(k, 9)} {kinds[kind]} {prose(k + 500, 7)} {fake} end"))
        truth[k] = (kind, value)
    return rows, truth


def test_planted_spans(spark, table, prose):
    rows, truth = planted(prose)
    frame = table(rows)
    out = {r.doc_id: r for r in P.find(frame, P.fit(frame)).collect()}
    texts = dict(rows)
    hits = sum([(s.kind, texts[k][s.start : s.end]) for s in r.spans] == [truth[k]] for k, r in out.items())
    assert hits >= 0.97 * len(rows)
    assert all(truth[k][1] not in r.text and f"[{truth[k][0]}]" in r.text for k, r in out.items() if r.spans)
    clean = P.redact_table(frame, P.fit(frame))
    got = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == frame.columns and all(got[k].text == out[k].text and got[k].n_chars == len(out[k].text) for k in got)


def test_expectation_maximisation_finds_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.97, 0.9, 0.75, 0.6])
    votes = np.where(rng.random((20_000, 4)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    pattern, counts = np.unique(votes, axis=0, return_counts=True)
    p, share, table = P.estimate(pattern, counts.astype(float))
    assert abs(share - 0.3) < 0.05 and (np.diff(table[:, 1, 2]) < 0).all()
    each = p[[int(np.flatnonzero((pattern == v).all(1))[0]) for v in votes[:2000]]]
    assert ((each > 0.5) == truth[:2000]).mean() > 0.96


def test_candidates_cover_and_dont_overlap():
    text = "a.b@c.example.org, +1 (706) 555-3138 4644348398010899 10.0.0.1 4111 1111 1111 1111 (212) 555-1234 170.1.2.3 555-123-4567"
    found = P.candidates(text)
    assert [k for _, _, k in found] == ["EMAIL", "PHONE", "CARD", "IP", "CARD", "PHONE", "IP", "PHONE"]
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert P.candidates("no numbers 12 here, section 3.4.") == []


def test_numbers_after_a_word_that_ends_in_a_digit():
    cases = {
        "IPv4 192.168.1.10": ("192.168.1.10", "IP"), "user7 4111 1111 1111 1111": ("4111 1111 1111 1111", "CARD"), "B12 555-867-5309": ("555-867-5309", "PHONE"),
        "me.555-867-5309": ("555-867-5309", "PHONE"), "id_9 (212) 555-1234": ("(212) 555-1234", "PHONE"),
    }
    for text, want in cases.items():
        assert [(text[s:e], k) for s, e, k in P.candidates(text)] == [want], text
    assert P.candidates("b4644348398010899 x_5558675309 550e8400-1234-5678-9012-446655440000") == []


def test_edges(spark, table, edges):
    frame = table(edges)
    model = P.fit(frame)
    out = P.find(frame, model).collect()
    assert len(out) == len(edges) and all(r.spans == [] for r in out)
    assert {r.doc_id: r.text for r in out} == dict(edges)
    assert P.find(table([]), model).count() == 0 and P.fit(table([])) == {}
    same = P.redact_table(frame, model)
    assert sorted(map(str, same.collect())) == sorted(map(str, frame.collect()))


def test_addresses_against_brute_force():
    """Of all stretches around an @ that have the form of an address, the longest."""
    import re

    r, form = random.Random(8), re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
    for _ in range(300):
        text = "".join(r.choice("ab.@@- x_") for _ in range(r.randrange(1, 24)))
        every = [(a, b) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if form.fullmatch(text[a:b])]
        longest, want = {}, []
        for a, b in every:
            longest[text.index("@", a)] = max(longest.get(text.index("@", a), (0, 0)), (b - a, -a))
        for n, a in sorted(longest.values(), key=lambda x: (-x[1], -x[0])):
            if not want or -a >= want[-1][1]:
                want.append((-a, -a + n))
        assert [(s, e) for s, e, k in P.candidates(text) if k == "EMAIL"] == want, text
    far = "a" * 500 + "@example.com"
    assert P.candidates("x " + far) == [(2, 2 + len(far), "EMAIL")]


def test_expectation_maximisation_against_brute_force():
    """The same steps over single spans in place of counted patterns."""
    rng = np.random.default_rng(1)
    votes = rng.integers(-1, 2, (300, 4))
    pattern, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    got = P.estimate(pattern, counts.astype(float), rounds=5)
    p = []
    for v in votes:
        pro, con = (v > 0).any(), (v < 0).any()
        p.append(0.9 if pro and not con else 0.2 if pro else 0.1 if con else 0.5)
    for _ in range(5):
        share = (sum(p) + 1) / (len(p) + 2)
        table = np.zeros((4, 2, 3))
        for k in range(4):
            for c in (0, 1):
                for j in (0, 1, 2):
                    table[k, c, j] = sum((q if c else 1 - q) for q, v in zip(p, votes) if v[k] + 1 == j) + 0.5 + (len(p) * P.PRIOR * P._BELIEF[c][j] if k < 2 else 0)
                table[k, c] /= table[k, c].sum()
        new = []
        for v in votes:
            a, b = share, 1 - share
            for k in range(4):
                a, b = a * table[k, 1, v[k] + 1], b * table[k, 0, v[k] + 1]
            new.append(a / (a + b))
        p = new
    assert np.allclose(got[0][inverse.ravel()], p) and abs(got[1] - share) < 1e-9 and np.allclose(got[2], table)
