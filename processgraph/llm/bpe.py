"""Byte-level BPE by DuckDB inside each partition.

The texts of a partition are cut into words by the vocabulary's pattern; distinct words are encoded once
each. Rows (word, position, token) start from the words' bytes. A recursive query joins neighbouring rows
with the merge table, contracts, and goes on with the rows of the words that still had a pair until none
has. Decoding joins the tokens with their bytes and aggregates them in order.

The result is that of contracting each word's leftmost pair of least rank, one after the other. Each round
contracts that pair, the further pairs of that rank as far as none makes a pair of less rank, and all pairs
that would be contracted later whatever happens around them: a
pair is sure of it if no token of a less rank can come to be across its left or right border, neither now
nor after the contraction. Two tables by pairs of neighbours say so; they are made from the vocabulary. Of
a run of equal tokens, every second pair is contracted at once. So a word of any length takes few rounds.
Words are cut first between bytes that no token has side by side, since no contraction can join these.
Rows keep the order of their positions from round to round, so that neighbours need no sorting; the query
raises an error if they ever didn't. DuckDB keeps to MEMORY and spills what is beyond to the folder that Spark gives its workers for spills.

The vocabulary is a file of base64 tokens and ranks; two tokens merge if their bytes together are a token,
and its number is the pair's rank. It is read by the driver and broadcast, a few MB whatever the corpus.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from processgraph.llm.textnp import chunks

#: BATCH: bytes of words a query starts from; a word of more is a batch by itself. ROWS: rows that the rounds of one query may add up to.
VOCABULARY, CHUNK, BATCH, ROWS, CACHE, MEMORY = "/opt/tokenizers/byte_bpe_50k.tiktoken", 8 << 20, 1 << 19, 6_000_000, 16 << 20, "700MB"
_ENCODE = """
WITH RECURSIVE step(i, w, pos, tok) AS (
  SELECT 0, w, pos, tok FROM start
  UNION ALL (
  WITH neighbour AS (
    SELECT i, w, pos, tok, lead(tok) OVER () AS b, lead(pos) OVER () AS after, lead(w) OVER () AS w1 FROM step
  ), pair AS (
    SELECT t.*, m.merged AS y FROM neighbour t LEFT JOIN merges m ON m.pair = CASE WHEN t.w1 = t.w THEN t.tok::BIGINT * 2097152 + t.b END
  ), around AS (
    SELECT i, w, pos, tok, b, after, y,
      lag(w) OVER o = w AS inside, lag(tok) OVER o AS p, lag(y) OVER o AS y0, lead(y) OVER o AS y1,
      lead(w1) OVER o = w AS goes, lead(b) OVER o AS n, row_number() OVER o AS nth,
      CASE WHEN after < pos OR lead(pos) OVER o <> after THEN error('rows out of order') END AS wrong
    FROM pair WINDOW o AS ()
  ), run AS (
    SELECT pos, nth - max(CASE WHEN NOT coalesce(inside AND p = tok, false) THEN nth END) OVER (ORDER BY pos) AS place
    FROM around WHERE tok = b AND y IS NOT NULL
  ), placed AS (
    SELECT a.*, r.place, a.nth - r.place AS run, coalesce(y < y0 OR NOT inside, true) OR r.place > 0 AND r.place % 2 = 0 AS apart
    FROM around a LEFT JOIN run r ON r.pos = a.pos WHERE y IS NOT NULL AND wrong IS NULL
  ), low AS (
    SELECT * FROM placed WHERE apart AND coalesce(y <= y0 OR NOT inside, true) AND coalesce(y <= y1 OR NOT goes, true)
  ), sure AS (
    SELECT l.pos, l.after, l.y, l.place, l.run FROM low l
    LEFT JOIN lefts a ON a.pair = CASE WHEN l.inside THEN l.p::BIGINT * 2097152 + l.tok END
    LEFT JOIN lefts c ON c.pair = CASE WHEN l.inside THEN l.p::BIGINT * 2097152 + l.y END
    LEFT JOIN rights d ON d.pair = CASE WHEN l.goes THEN l.b::BIGINT * 2097152 + l.n END
    LEFT JOIN rights e ON e.pair = CASE WHEN l.goes THEN l.y::BIGINT * 2097152 + l.n END
    WHERE (a.least IS NULL OR a.least > l.y OR a.least = l.y AND l.place > 0)
      AND (c.least IS NULL OR c.least > l.y) AND (d.least IS NULL OR d.least >= l.y) AND (e.least IS NULL OR e.least > l.y)
  ), least AS (
    SELECT w, min(y) AS y FROM pair WHERE y IS NOT NULL GROUP BY w
  ), next AS (
    SELECT o.w, o.pos, o.after, o.y, coalesce(a.merged < o.y, false) OR coalesce(b.merged < o.y, false) OR coalesce(c.merged < o.y, false) AS stops
    FROM placed o JOIN least g ON g.w = o.w AND g.y = o.y
    LEFT JOIN merges a ON a.pair = CASE WHEN o.inside THEN o.p::BIGINT * 2097152 + o.y END
    LEFT JOIN merges b ON b.pair = CASE WHEN o.goes THEN o.y::BIGINT * 2097152 + o.n END
    LEFT JOIN merges c ON c.pair = o.y::BIGINT * 2097152 + o.y
    WHERE o.apart
  ), chosen AS (
    SELECT pos, after, y FROM sure WHERE place IS NULL OR place = 0 OR run IN (SELECT run FROM sure WHERE place = 0)
    UNION SELECT n.pos, n.after, n.y FROM next n LEFT JOIN (SELECT w, min(pos) AS stop FROM next WHERE stops GROUP BY w) z ON z.w = n.w WHERE z.stop IS NULL OR n.pos <= z.stop
  )
  SELECT t.i + 1, t.w, t.pos, coalesce(c.y, t.tok)
  FROM step t LEFT JOIN chosen c ON c.pos = t.pos
  WHERE t.i < $rounds AND t.w IN (SELECT w FROM least) AND t.pos NOT IN (SELECT after FROM chosen)
  )
)
SELECT s.w, s.pos, s.tok, s.i FROM step s JOIN (SELECT w, max(i) AS i FROM step GROUP BY w) z ON z.w = s.w AND z.i = s.i ORDER BY s.pos
"""
_DECODE = "SELECT r, string_agg(hex, '' ORDER BY pos) AS hex FROM toks JOIN vocabulary USING (tok) GROUP BY r ORDER BY r"


def _category(first: str, below: int) -> str:
    """A character class of all code points of a general category."""
    runs, start = [], None
    for c in range(below + 1):
        own = c < below and unicodedata.category(chr(c))[0] == first
        if own and start is None:
            start = c
        elif not own and start is not None:
            runs.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(runs)


_patterns: dict[int, re.Pattern] = {}


def pattern(below: int = sys.maxunicode + 1) -> re.Pattern:
    """The words of the vocabulary: letters, numbers, other signs - each with a space before -, contractions, and white space.

    For texts without code points from `below` up, smaller classes do, which match several times faster.
    """
    if below not in _patterns:
        letter, number = _category("L", below), _category("N", below)
        space = "\\t-\\r \\x85\\xa0" + ("\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000" if below > 256 else "")
        _patterns[below] = re.compile(f" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
    return _patterns[below]


def cut_words(text: str | None) -> list[str]:
    if not text:
        return []
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return pattern().findall(text)
    return pattern(256).findall(text)


def load(path: str = VOCABULARY) -> dict:
    """The tokens, all pairs of tokens that merge, and what can come to be across a border, as arrays.

    lefts has for a pair (s, b) the least rank of a token T + b whose T is a token that ends with s; rights for (a, s) that
    of a token a + T whose T begins with s.
    """
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    merges: dict[int, int] = {}
    lefts: dict[int, int] = {}
    rights: dict[int, int] = {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        for k in range(1, len(token)):
            head, tail = token[:k], token[k:]
            a, b = ranks.get(head), ranks.get(tail)
            if a is not None and b is not None:
                merges[(a << 21) + b] = rank
                for j in range(k):
                    if (s := ranks.get(head[j:])) is not None:
                        lefts.setdefault((s << 21) + b, rank)
                for j in range(1, len(tail) + 1):
                    if (s := ranks.get(tail[:j])) is not None:
                        rights.setdefault((a << 21) + s, rank)
    arrays = {k: (np.fromiter(d.keys(), np.int64, len(d)), np.fromiter(d.values(), np.int32, len(d))) for k, d in (("merges", merges), ("lefts", lefts), ("rights", rights))}
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    beside = np.zeros((256, 256), bool)
    for token in ranks:
        beside[list(token[:-1]), list(token[1:])] = True
    return {"tokens": ranks, "single": single, "beside": beside, **arrays}


class Coder:
    """A DuckDB connection with the vocabulary, and the words that were encoded."""

    def __init__(self, vocabulary: dict, memory: str = MEMORY):
        self.v = vocabulary
        spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": f"{spill}/duckdb-{os.getpid()}" if spill else ""})
        self.db.execute("SET disabled_optimizers = 'join_order,build_side_probe_side'")
        for name, value in (("merges", "merged"), ("lefts", "least"), ("rights", "least")):
            given = pa.table({"pair": vocabulary[name][0], value: vocabulary[name][1]})  # noqa: F841
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        tokens = pa.table({"tok": pa.array(list(vocabulary["tokens"].values()), pa.int32()), "hex": [t.hex() for t in vocabulary["tokens"]]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM tokens")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.ids, self.sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the words, one after the other, and how many each has.

        A query stops after as many rounds as keep its rows within ROWS, but one at least; words that could go on then start
        another from where they are.
        """
        n = np.array([len(x) for x in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.zeros(len(flat), bool)
        first[np.cumsum(n)[:-1]] = True
        first[1:] |= ~self.v["beside"][flat[:-1], flat[1:]]
        w, tok, pos = np.cumsum(first, dtype=np.int32), self.v["single"][flat], np.arange(len(flat), dtype=np.int64)
        done = [(pos[:0], tok[:0])]
        while len(w):
            rounds = max(1, ROWS // len(w))
            start = pa.table({"w": w, "pos": pos, "tok": tok})  # noqa: F841
            got = self.db.execute(_ENCODE, {"rounds": rounds}).fetchnumpy()
            open_ = np.asarray(got["i"]) >= rounds
            w, pos, tok = (np.asarray(got[k]) for k in ("w", "pos", "tok"))
            done.append((pos[~open_], tok[~open_]))
            w, pos, tok = w[open_], pos[open_], tok[open_]
        pos, tok = (np.concatenate(x) for x in zip(*done))
        rank = np.argsort(pos)
        return tok[rank], np.diff(np.searchsorted(pos[rank], np.concatenate([[0], np.cumsum(n)])))

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet."""
        raw = [x.encode("utf-8", "surrogatepass") for x in words]
        off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        for i, j in chunks(off, BATCH):
            ids, sizes = self.contract(raw[i:j])
            self.ids.append(ids)
            self.sizes.append(sizes)
        for x in words:
            self.index[x] = len(self.index)
        self.held += int(off[-1])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens one after the other, and the n + 1 bounds of the texts."""
        cut_up = [cut_words(t) for t in texts]
        code, words = pd.factorize(np.fromiter(chain.from_iterable(cut_up), object, sum(map(len, cut_up))))
        if self.held > CACHE:
            self.forget()
        self.learn([w for w in words if w not in self.index])
        self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
        ids, size = self.ids[0], self.sizes[0]
        begin = np.concatenate([[0], np.cumsum(size)])
        word = np.fromiter((self.index[w] for w in words), np.int64, len(words))[code]
        n = size[word]
        to = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.arange(to[-1]) + np.repeat(begin[word] - to[:-1], n)]
        return flat, to[np.concatenate([[0], np.cumsum([len(ws) for ws in cut_up])])]

    def decode(self, flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each run of tokens, aggregated in the order of their positions."""
        n = np.diff(bounds)
        out = [b""] * len(n)
        at = np.arange(bounds[-1] - bounds[0]) - np.repeat(bounds[:-1] - bounds[0], n)
        toks = pa.table({"r": np.repeat(np.arange(len(n), dtype=np.int32), n), "pos": at.astype(np.int32), "tok": flat[bounds[0] : bounds[-1]]})  # noqa: F841
        for r, text in self.db.execute(_DECODE).fetchall():
            out[r] = bytes.fromhex(text)
        return out


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i = total = 0
    for j, t in enumerate(texts):
        total += len(t or "")
        if total >= CHUNK:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, check: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, exact), one row for each row of docs, in one pass without a shuffle.

    exact says whether decoding the ids gives the text again, and is null without `check`. A null text has null ids and null exact, an
    empty one none and true; texts of any length are read whole. Repeated rows give repeated rows, null
    ids stay null, no rows give no rows, other columns are not read. Of pairs of one rank the leftmost
    is contracted first.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in _parts(texts):
                own = texts[i:j]
                flat, bounds = coder.encode(own)
                back = coder.decode(flat, bounds) if check else [None] * len(own)
                null = np.array([t is None for t in own])
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(null))
                same = pa.array([None if t is None or b is None else t.encode("utf-8", "surrogatepass") == b for t, b in zip(own, back)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids, pa.array(np.diff(bounds)), same], ["doc_id", "ids", "n_tokens", "exact"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, exact boolean")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text), one row for each row: null ids give null text, no ids empty text. Ids that the vocabulary lacks are left out; bytes that aren't UTF-8 are replaced."""
    held = rows.sparkSession.sparkContext.broadcast(load(vocabulary))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            bounds = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            flat = np.array([t for x in lists for t in x or () ], np.int32)
            texts = [None if x is None else b.decode("utf-8", "replace") for x, b in zip(lists, coder.decode(flat, bounds))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"doc_id {kind}, text string")
