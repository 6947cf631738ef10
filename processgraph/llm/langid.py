"""Language identification of mixed text: script ranges, word scores and Viterbi spans.

Each word has a main script, by the ranges of its characters; only languages of that script are
candidates for it. Among those, hashed byte trigrams (with the word's borders) give each word a
log-probability by language. Over the words of a document, the best sequence of languages under a
penalty for each switch is found by Viterbi, and runs of one language are its spans. Words without a
letter fit every language alike. All documents of a chunk advance together, word by word.

The languages are all that any document names, by a count over the whole table. Training takes documents
of each of them, chosen by a hash: TRAIN_DOCS in all, shared evenly, and LEAST_DOCS of each language at least,
as far as it has them; the bound is a parameter of fit(). Labelling has no bounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from processgraph.llm.sample import by_stratum
from processgraph.llm.textnp import LOWER, SPACE, chunks, utf8, words

TRAIN_DOCS, LEAST_DOCS, SWITCH, BUCKETS, NEVER = 3000, 10, 12.0, 1 << 16, -60.0
#: First code point of a range, its script; '' has no letters of its own.
RANGES = [
    (0x0, ""), (0x41, "Latin"), (0x5B, ""), (0x61, "Latin"), (0x7B, ""), (0xC0, "Latin"), (0xD7, ""), (0xD8, "Latin"), (0xF7, ""), (0xF8, "Latin"), (0x250, "Latin"), (0x2B0, ""),
    (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, ""), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, ""), (0xB80, "Tamil"), (0xC00, ""),
    (0xE00, "Thai"), (0xE80, ""), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0xA000, ""),
    (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""), (0x20000, "Han"), (0x30000, ""),
]
ALONE = {"Greek": "el", "Cyrillic": "ru", "Armenian": "hy", "Hebrew": "he", "Arabic": "ar", "Devanagari": "hi", "Bengali": "bn", "Tamil": "ta", "Thai": "th", "Georgian": "ka", "Hangul": "ko", "Kana": "ja", "Han": "zh"}
SCRIPTS = ["", "Latin", *ALONE]
_FIRST = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in RANGES])
_ASCII = np.array([_SCRIPT[np.searchsorted(_FIRST, c, "right") - 1] for c in range(128)], np.uint8)


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lead bytes above ASCII, and their code points."""
    at = np.flatnonzero(buf >= 0xC0)
    b = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.int64)
    x = b[at]
    two = ((x & 0x1F) << 6) | (b[at + 1] & 0x3F)
    three = ((x & 0x0F) << 12) | ((b[at + 1] & 0x3F) << 6) | (b[at + 2] & 0x3F)
    four = ((x & 0x07) << 18) | ((b[at + 1] & 0x3F) << 12) | ((b[at + 2] & 0x3F) << 6) | (b[at + 3] & 0x3F)
    return at, np.where(x < 0xE0, two, np.where(x < 0xF0, three, four))


def word_scripts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The script that most letters of each word belong to, 0 if it has no letter; on a tie the one listed first."""
    script = np.where(buf < 128, _ASCII[buf & 127], 0).astype(np.uint8)
    at, code = code_points(buf)
    script[at] = _SCRIPT[np.searchsorted(_FIRST, code, "right") - 1]
    if not len(starts):
        return np.zeros(0, np.int64)
    present = np.flatnonzero(np.bincount(script, minlength=len(SCRIPTS))[1:]) + 1
    best, most = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for s in present:
        run = np.concatenate([[0], np.cumsum(script == s)])
        n = run[ends] - run[starts]
        best, most = np.where(n > most, s, best), np.maximum(n, most)
    return best


def trigrams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram centred on each byte, words being bordered by zeros; bounds (starts, ends) stay those of the words."""
    low = LOWER[buf].astype(np.uint32)
    before, after = np.zeros_like(low), np.zeros_like(low)
    if len(low):
        before[1:], after[:-1] = low[:-1], low[1:]
        before[starts] = 0
        after[ends - 1] = 0
    h = (before * np.uint32(0x9E3779B1)) ^ (low * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)), low


def word_scores(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(words, languages) log-probabilities, each word's best being 0, which words have letters, and the languages.

    Scripts that the model has no language of stand for one language each; Latin words are 'und' then.
    """
    script = word_scripts(buf, starts, ends)
    langs = list(model["langs"])
    for s in np.unique(script):
        if s > 1 and SCRIPTS[s] not in model["scripts"] and ALONE[SCRIPTS[s]] not in langs:
            langs.append(ALONE[SCRIPTS[s]])
    if "Latin" not in model["scripts"]:
        langs.append("und")
    out = np.zeros((len(starts), len(langs)), np.float32)
    if len(starts):
        gram, low = trigrams(buf, starts, ends)
        gram[SPACE[low]] = BUCKETS
        for k, column in enumerate(model["columns"]):
            out[:, k] = np.add.reduceat(column[gram], starts)
    fits = np.zeros((len(SCRIPTS), len(langs)), bool)
    fits[0] = True
    for k, lang in enumerate(langs):
        own = model["script_of"].get(lang)
        fits[[i for i, s in enumerate(SCRIPTS) if s and (s == own or ALONE.get(s) == lang or (lang == "und" and s == "Latin"))], k] = True
    fits[~fits.any(1)] = True
    ok = fits[script]
    out[:, len(model["langs"]) :] = 0
    top = np.where(ok, out, -np.inf).max(1, initial=-np.inf) if len(starts) else np.zeros(0)
    out = np.where(ok, np.maximum(out - top[:, None], NEVER), NEVER).astype(np.float32)
    out[script == 0] = 0
    return out, script > 0, langs


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word. On ties the path stays, and the language listed first wins."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    start, n = bounds[:-1][order], n[order]
    longest, k = (int(n[0]) if len(n) else 0), scores.shape[1]
    alive = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
    out = np.zeros(len(scores), np.int32)
    jump = np.zeros((len(scores), k), bool)
    source = np.zeros(len(scores), np.int32)
    best = np.zeros((len(n), k), np.float32)
    for t in range(longest):
        a = alive[t]
        at = start[:a] + t
        v = best[:a]
        if t:
            top = v.argmax(1)
            change = (v[np.arange(a), top] - np.float32(switch))[:, None]
            moved = change > v
            jump[at], source[at] = moved, top
            v = np.where(moved, change, v)
            v -= v.max(1)[:, None]
        best[:a] = v + scores[at]
    state = best.argmax(1) if len(n) else np.zeros(0, np.int64)
    for t in range(longest - 1, -1, -1):
        a = alive[t]
        at = start[:a] + t
        s = state[:a]
        out[at] = s
        if t:
            state[:a] = np.where(jump[at, s], source[at], s)
    return out


def label(data: np.ndarray, off: np.ndarray, model: dict, switch: float = SWITCH, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, list]]:
    """Row numbers and their (lang, share, n_words, spans); texts of like length go together."""
    n = np.diff(off)
    order = np.argsort(n, kind="stable")
    to = np.concatenate([[0], np.cumsum(n[order])])
    for i, j in chunks(to, limit):
        rows = order[i:j]
        at = np.arange(to[j] - to[i]) + np.repeat(off[rows] - (to[i:j] - to[i]), n[rows])
        buf = data[at]
        starts, ends, bounds = words(buf, to[i : j + 1] - to[i])
        scores, letters, langs = word_scores(buf, starts, ends, model)
        best = viterbi(scores, bounds, switch)
        out = []
        edge = np.ones(len(best) + 1, bool)
        edge[1:-1] = best[1:] != best[:-1]
        edge[bounds] = True
        cuts = np.flatnonzero(edge)
        first = np.searchsorted(cuts, bounds)
        run = np.concatenate([[0], np.cumsum(letters)])
        for r in range(len(rows)):
            a, b = bounds[r], bounds[r + 1]
            known = int(run[b] - run[a])
            if not known:
                out.append(("und", 0.0, int(b - a), []))
                continue
            c = cuts[first[r] : first[r + 1] + 1]
            kinds = best[c[:-1]]
            weight = np.bincount(kinds, run[c[1:]] - run[c[:-1]], len(langs))
            top = int(weight.argmax())
            spans = [{"lang": langs[k], "start": int(x - a), "end": int(y - a)} for k, x, y in zip(kinds, c[:-1], c[1:])]
            out.append((langs[top], float(weight[top] / known), int(b - a), spans))
        yield rows, out


def fit_texts(texts: list[str], langs: list[str]) -> dict:
    """Trigram log-probabilities by language, add-0.1 smoothed, each against the mean over languages; the last bucket, of white space, says nothing."""
    names = sorted(set(langs))
    table = np.full((BUCKETS, len(names)), 0.1)
    of = {}
    for k, name in enumerate(names):
        data, off = utf8(pa.array([t for t, x in zip(texts, langs) if x == name], pa.large_string()))
        buf = data[off[0] : off[-1]]
        starts, ends, _ = words(buf, off - off[0])
        gram, low = trigrams(buf, starts, ends)
        inside = low > 32
        table[:, k] += np.bincount(gram[inside], minlength=BUCKETS)
        script = np.bincount(word_scripts(buf, starts, ends), minlength=len(SCRIPTS))
        of[name] = SCRIPTS[int(script[1:].argmax()) + 1]
    table = np.log(table / table.sum(0))
    if len(names):
        table -= table.mean(1)[:, None]
    columns = [np.append(table[:, k], 0).astype(np.float32) for k in range(len(names))]
    return {"langs": names, "columns": columns, "script_of": of, "scripts": set(of.values())}


def quotas(sizes: dict[str, int], most: int) -> dict[str, int]:
    """How many documents to take of each language: all of rare ones, and what these leave of `most` shared evenly, but LEAST_DOCS at least."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(LEAST_DOCS, left // (len(sizes) - k)))
        left -= out[lang]
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> dict:
    """A model of all languages that documents name, from about `most` of these documents; nulls don't count. No documents give a model of scripts alone."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.where("t is not null and l is not null and l <> ''")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    found = by_stratum(rows, "l", [F.col("i"), F.col("t")], sizes, quotas(sizes, most)).toPandas().sort_values(["i", "t"], kind="stable")
    return fit_texts(found["t"].tolist(), found["l"].tolist())


_SPANS = "array<struct<lang:string,start:int,end:int>>"


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang, share, n_words, spans), one row for each row of docs, in one pass without a shuffle.

    lang is the language of most words with letters, share its share of them; spans are runs of words
    [start, end) of one language that cover the text. A text that is null, empty or without letters is
    'und' with share 0 and no spans. On ties the language first in the alphabet wins. Repeated rows give
    repeated rows, null ids stay null, no rows give no rows, other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for rows, out in label(data, off, held.value, switch):
                lang, share, n, spans = zip(*out)
                cols = [batch.column(0).take(pa.array(rows)), pa.array(lang), pa.array(share), pa.array(n, pa.int32()), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "share", "n_words", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, share double, n_words int, spans {_SPANS}")


def keep_identified(docs: DataFrame, model: dict, text_col: str = "text", languages: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose main language is one of `languages` (those of the model) and has the share `least`.

    Null texts, empty texts and texts without letters go. Where two languages have as many words, the first in the alphabet
    is the main one. Repeated rows are kept or go alike; no rows give no rows; columns may have any names, none is added.
    """
    held = docs.sparkSession.sparkContext.broadcast((model, set(languages or model["langs"])))
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(at))
            ok = np.zeros(batch.num_rows, bool)
            for rows, out in label(data, off, held.value[0]):
                ok[rows] = [x[0] in held.value[1] and x[1] >= least for x in out]
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
