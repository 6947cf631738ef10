"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs the votes.

Loose patterns propose spans of five kinds. Labelers of three sorts vote +1, -1 or 0 (no opinion) on
each: strict patterns (with check digits and octet ranges), gazetteers (domain endings, card issuers,
dialling codes, reserved addresses) and the words before the span. For each kind, the numbers of all
vote patterns in the corpus go to the driver - a table whose size depends on the labelers, not on the
corpus - and expectation-maximisation finds the share of true spans and each labeler's reliability.
Its posteriors, weighted by the numbers, train a logistic span classifier on votes and span features,
which decides. Accepted spans are replaced by their kind in brackets.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["EMAIL", "PHONE", "IP", "CARD", "SECRET"]
LABELERS, LEAST, ROUNDS = 4, 0.5, 200
PRIOR, _BELIEF = 0.1, np.array([[0.5, 0.3, 0.2], [0.002, 0.1, 0.898]])
_NUMBER = re.compile(r"[+(\d](?:[\d()]|[ .\-](?=[\d(])){6,}")
_DIGITS, _UUID = re.compile(r"\d*"), re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_RUN = re.compile(r"[=:]\s{0,3}[\"']?([A-Za-z0-9+/_\-]{12,}={0,2})")
_HEX = re.compile(r"[0-9a-fA-F]{32,}(?![A-Za-z0-9])")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}|(?:ghp|sk|pk|xox[bp])[_\-][A-Za-z0-9_\-]{16,}")
_MARKS = ("AKIA", "ghp", "sk_", "sk-", "pk_", "pk-", "xox")
_LOCAL, _DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)")
_PART = re.compile(r"[+(]?\d[\d()\-. ]*\d")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .\-]?)?\(?\d{2,4}\)?[ .\-]\d{3,4}[ .\-]\d{3,4}")
_MAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_ENDINGS = {"com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "us", "eu", "it", "nl", "ch", "at", "be", "ca", "au", "jp", "cn", "ru", "br", "in", "mx"}
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30[0-5]|36|38")
_DIAL = re.compile(r"\+(?:1|7|20|27|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?=\D|\d)")
_CONTEXT = {
    "EMAIL": re.compile(r"e-?mail|contact|write to|mailto|correo|courriel|@", re.I),
    "PHONE": re.compile(r"phone|tel|call|fax|mobile|cell|whatsapp|sms|anruf|appel|llam", re.I),
    "IP": re.compile(r"\bip\b|host|server|address|login|from|client|ping", re.I),
    "CARD": re.compile(r"card|visa|credit|payment|pay|master|amex|karte|carte|tarjeta", re.I),
    "SECRET": re.compile(r"token|secret|passw|api|key|auth|credential|bearer", re.I),
}
_AGAINST = re.compile(r"version|\bv\.?$|§|section|chapter|isbn|doi|page|\bno\.?$|figure|table|commit|sha|checksum|md5", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by loose patterns, in order, without overlaps: the first and then the longest wins."""
    found: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        start, b = at, _DOMAIN.match(text, at + 1)
        while b and start and text[start - 1] in _LOCAL:
            start -= 1
        if b and start < at:
            found.append((start, b.end(), "EMAIL"))
        at = text.find("@", at + 1)
    for m in _NUMBER.finditer(text):
        s, e = m.start(), m.end()
        if s and (text[s - 1].isalnum() or text[s - 1] == "_"):
            if any(u.start() <= s < u.end() for u in _UUID.finditer(text, max(0, s - 36), s + 36)):
                continue
            s = _DIGITS.match(text, s).end()  # these belong to the word before; the rest of the run doesn't
        found += _numbers(text, s, e)
    for pattern in (_RUN, _HEX, _KEY) if any(x in text for x in _MARKS) else (_RUN, _HEX):
        for m in pattern.finditer(text):
            s, e = m.span(m.lastindex or 0)
            value = text[s:e]
            if pattern is _HEX and s and text[s - 1].isalnum():
                continue
            if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                found.append((s, e, "SECRET"))
    found.sort(key=lambda x: (x[0], -x[1], KINDS.index(x[2])))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _numbers(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """The spans of a run of digits and separators: addresses, card numbers, phone numbers, and then what lies between them."""
    out, rest = [], [(start, end)]
    for pattern, kind in ((_IP, "IP"), (_CARD, "CARD"), (_PHONE, "PHONE")):
        left = []
        for s, e in rest:
            for m in pattern.finditer(text, s, e):
                out.append((*m.span(), kind))
                left.append((s, m.start()))
                s = m.end()
            left.append((s, e))
        rest = left
    for s, e in rest:
        if m := _PART.search(text, s, e):
            n = sum(c.isdigit() for c in m.group())
            if 7 <= n <= 19:
                out.append((*m.span(), "CARD" if n >= 13 and m.group()[0] not in "+(" else "PHONE"))
    return out


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """The labelers' votes (strict pattern, gazetteer, words before, words against), then span features."""
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = re.sub(r"\D", "", span)
    strict = book = 0
    if kind == "EMAIL":
        strict = 1 if _MAIL.fullmatch(span) else -1
        book = 1 if span.rpartition(".")[2].lower() in _ENDINGS else -1
    elif kind == "PHONE":
        strict = 1 if _PHONE.fullmatch(span) else -1
        book = 1 if _DIAL.match(span) else 0
    elif kind == "IP":
        octets = [int(x) for x in span.split(".")]
        strict = 1 if all(x < 256 for x in octets) and not re.search(r"(?:^|\.)0\d", span) else -1
        book = -1 if octets[0] in (0, 127) or octets == [255] * 4 else 1
    elif kind == "CARD":
        strict = 1 if luhn(digits) else -1
        book = 1 if _ISSUERS.match(digits) and len(digits) in (13, 14, 15, 16, 19) else -1
    else:
        strict = 1 if _HEX.fullmatch(span) or _KEY.fullmatch(span) else 0
        kinds = sum(bool(re.search(p, span)) for p in ("[a-z]", "[A-Z]", r"\d"))
        book = 1 if len(set(span)) >= 10 and len(span) >= 20 or kinds == 3 else -1
    words = 1 if _CONTEXT[kind].search(before) else 0
    against = -1 if _AGAINST.search(before[-16:]) else 0
    quoted = int(bool(before) and before[-1] in "\"'<([=:")
    bounded = int(end == len(text) or not text[end].isalnum())
    return strict, book, words, against, quoted, bounded, min(len(digits), 20) // 4


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Posteriors of vote patterns, the share of true spans, and P(vote | truth) as (labelers, 2, 3) for votes -1, 0, 1.

    Dawid-Skene with two classes, started from unanimity: a span that some labeler is for and none
    against starts at 0.9, one with votes both ways at 0.2, one with votes against only at 0.1, one
    that nobody has an opinion on at 0.5. Strict patterns and gazetteers are built so that true spans
    seldom fail them and false ones often do; priors that weigh PRIOR times the data say so, or else the two
    classes, or two labelers alone, couldn't be told from their exchange.
    """
    vote = patterns.astype(int) + 1
    pro, con = (patterns > 0).any(1), (patterns < 0).any(1)
    p = np.select([pro & ~con, pro & con, con], [0.9, 0.2, 0.1], 0.5)
    share, table = 0.5, np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        w = np.stack([counts * (1 - p), counts * p])
        share = (w[1].sum() + 1) / (w.sum() + 2)
        for k in range(patterns.shape[1]):
            for c in (0, 1):
                own = np.bincount(vote[:, k], w[c], 3) + 0.5 + (counts.sum() * PRIOR * _BELIEF[c] if k < 2 else 0)
                table[k, c] = own / own.sum()
        logit = np.log(share / (1 - share)) + sum(np.log(table[k, 1, vote[:, k]] / table[k, 0, vote[:, k]]) for k in range(patterns.shape[1]))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p, float(share), table


def features(pattern: np.ndarray) -> np.ndarray:
    """Each vote as for and against, the span features, and a constant."""
    v, rest = pattern[:, :LABELERS], pattern[:, LABELERS:]
    return np.concatenate([v > 0, v < 0, rest[:, :2], rest[:, 2:] == np.arange(6), np.ones((len(pattern), 1))], 1).astype(float)


def train(rows: list[tuple[str, tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """A logistic weight vector for each kind from (kind, votes and features, number); kinds that don't occur have none."""
    model = {}
    for kind in KINDS:
        own = [(v, n) for k, v, n in rows if k == kind]
        if not own:
            continue
        pattern, counts = np.array([v for v, _ in own]), np.array([n for _, n in own], float)
        target, _, _ = estimate(pattern[:, :LABELERS], counts)
        x = features(pattern)
        weight = np.zeros(x.shape[1])
        scale = np.log1p(counts) / np.log1p(counts).sum()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
            g = x.T @ (scale * (p - target)) + 1e-4 * weight
            h = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(weight))
            weight -= np.linalg.solve(h, g)
        model[kind] = weight
    return model


def spans(text: str, model: dict[str, np.ndarray], known: dict | None = None) -> list[tuple[int, int, str, float]]:
    """All candidates with the classifier's probability. known remembers the pattern's answer."""
    out, known = [], {} if known is None else known
    for s, e, kind in candidates(text):
        v = votes(text, s, e, kind)
        if (kind, v) not in known:
            z = float((features(np.array([v])) @ model[kind])[0]) if kind in model else -30.0
            known[kind, v] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        out.append((s, e, kind, float(known[kind, v])))
    return out


def redact(text: str, found: list[tuple[int, int, str, float]], least: float = LEAST) -> str:
    out, at = [], 0
    for s, e, kind, p in found:
        if p >= least:
            out += [text[at:s], f"[{kind}]"]
            at = e
    return text if not out else "".join(out) + text[at:]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple, int] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for s, e, kind in candidates(text) if text else ():
                key = (kind, votes(text, s, e, kind))
                seen[key] = seen.get(key, 0) + 1
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen]), pa.array([list(v) for _, v in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["kind", "votes", "n"])


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, np.ndarray]:
    """The classifier from the votes on all texts of docs; only the numbers of vote patterns leave the workers."""
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(_count, "kind string, votes array<int>, n long")
    counted = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    return train(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counted))


def find(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, text, spans): the redacted text and the accepted spans of the text before, one row for each row of docs.

    Spans are [start, end) in characters, in order, without overlaps; where candidates overlap, the first
    and then the longest counts. A null text stays null, an empty one empty, both with no spans; texts of
    any length are read whole. Repeated rows give repeated rows, null ids stay null, no rows give no
    rows, other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("prob", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts, out = [], []
            for text in batch.column(1).to_pylist():
                found = [x for x in spans(text, held.value, known) if x[3] >= least] if text else []
                texts.append(redact(text, found, least) if found else text)
                out.append([{"kind": k, "start": s, "end": e, "prob": round(p, 6)} for s, e, k, p in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(out, shape)], ["doc_id", "text", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text string, spans array<struct<kind:string,start:int,end:int,prob:double>>")


def redact_table(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", chars_col: str | None = "n_chars", least: float = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, with redacted texts and, if there is such a column, their new lengths.

    Null and empty texts stay as they are, and so does the length of a text that isn't altered. Of spans that overlap the
    first and then the longest counts; repeated rows are redacted alike; no rows give no rows. No column is added.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [redact(t, spans(t, held.value, known), least) if t else t for t in texts]
            cols = list(batch.columns)
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if n_at is not None:
                cols[n_at] = pa.array([n if a is b else len(b) for n, a, b in zip(batch.column(n_at).to_pylist(), texts, new)], batch.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
