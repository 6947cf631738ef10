"""The tokens of `bpe`, of whole Arrow batches at once, for operators that need many of them rather than their SQL.

Texts are cut into the words of the vocabulary's pattern by classes of code points. Equal words are found by
hashes, and their bytes compared, so that an equal hash of other bytes is never taken for the same word. Distinct words are
contracted together, as rows of a matrix: in each round every row contracts its leftmost pair of least rank, and a row
leaves when it has none. Words of more than LONG bytes are contracted by `bpe.Coder`.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pandas as pd

from processgraph.llm import bpe
from processgraph.llm.textnp import U64, chunks, word_hashes

#: Bytes of text that are hashed and encoded at a time, of words that are kept, and of a word that is a row of a matrix; widths of the matrices.
HASHED, CODED, CACHE, LONG, WIDTHS = 1 << 20, 1 << 20, 8 << 20, 128, (4, 8, 12, 16, 24, 32, 64, 128)
MEMORY = "300MB"
OTHER, LETTER, NUMBER, BLANK = range(4)
_NONE = np.int32(2**31 - 1)


def classes() -> np.ndarray:
    """The class of each code point in the vocabulary's pattern."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return out


def table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table: keys and values by place, -1 where there is none."""
    size = 1 << max(10, int(4 * len(keys)).bit_length())
    held, value = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
    at, live = _place(keys, size), np.arange(len(keys))
    while len(live):
        free = live[held[at[live]] == -1]
        _, first = np.unique(at[free], return_index=True)
        held[at[free[first]]], value[at[free[first]]] = keys[free[first]], values[free[first]]
        live = live[held[at[live]] != keys[live]]
        at[live] = (at[live] + 1) & (size - 1)
    return held, value


def _place(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys.astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(65 - size.bit_length())).astype(np.int64)


class Encoder:
    """The vocabulary as bpe.load() has it, with classes(); and the words that were encoded."""

    def __init__(self, vocabulary: dict, kinds: np.ndarray):
        self.v, self.kinds = vocabulary, kinds
        self.held, self.value = table(*vocabulary["merges"])
        self.coder: bpe.Coder | None = None
        self.forget()

    def forget(self) -> None:
        self.hash, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)
        self.raw, self.raw_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def starts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the words of texts begin; each ends where the next one begins."""
        if not len(buf):
            return np.zeros(0, np.int64)
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        if buf.max() < 128:
            code, first = buf, None
        else:
            code, first = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), np.flatnonzero(buf & 0xC0 != 0x80)
            edge = np.append(edge[first], True)
        kind, n = self.kinds[code], len(code)
        run = edge[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        begins = run.copy()
        last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~edge[1:-1])  # of white space before a word
        begins[last] = True
        begins[last[code[last] == 32] + 1] = False
        quote = np.flatnonzero(code[:-1] == 39)
        quote = quote[begins[quote] & run[quote] & (kind[quote + 1] == LETTER) & ~edge[quote + 1]]
        a = code[quote + 1]
        b = np.where(edge[quote + 2], 0, code[np.minimum(quote + 2, n - 1)])
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        begins[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        begins[after[after < n]] = True
        return np.flatnonzero(begins) if first is None else first[begins]

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair is contracted to, which is also its rank; _NONE for other pairs and where a token is -1."""
        key = (left.astype(np.int64) << 21) + right
        key[(left < 0) | (right < 0)] = -2
        size = len(self.held)
        at = _place(key, size)
        seen = self.held[at]
        out = np.where(seen == key, self.value[at], _NONE)
        live = np.flatnonzero((seen != key) & (seen != -1) & (key >= 0))
        at = at[live]
        while len(live):
            at = (at + 1) & (size - 1)
            seen = self.held[at]
            hit = seen == key[live]
            out[live[hit]] = self.value[at[hit]]
            go = ~hit & (seen != -1)
            live, at = live[go], at[go]
        return out

    def _rows(self, tok: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of a matrix of single bytes, -1 behind the end of a word: (rows, their tokens, -1 behind the end) of the rows that end together."""
        out, live = [], np.arange(len(tok))
        rank = self._merged(tok[:, :-1].ravel(), tok[:, 1:].ravel()).reshape(len(tok), -1)
        while len(live) and rank.shape[1]:
            j = rank.argmin(1)
            best = rank[np.arange(len(live)), j]
            open_ = best != _NONE
            if not open_.all():
                out.append((live[~open_], tok[~open_]))
                live, tok, rank, j, best = live[open_], tok[open_], rank[open_], j[open_], best[open_]
            rows, (m, n) = np.arange(len(live)), tok.shape
            tok[rows, j] = best
            keep = np.ones((m, n), bool)
            keep[rows, j + 1] = False
            tok = tok[keep].reshape(m, n - 1)
            keep = np.ones((m, n - 1), bool)
            keep[rows, j] = False
            rank = rank[keep].reshape(m, n - 2)
            a, b = np.flatnonzero(j > 0), np.flatnonzero(j < n - 2)
            r, k = np.concatenate([a, b]), np.concatenate([j[a] - 1, j[b]])
            rank[r, k] = self._merged(tok[r, k], tok[r, k + 1])
        if len(live):
            out.append((live, tok))
        return out

    def contract(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of words, whose bytes are flat[at[k]:at[k + 1]], and the bounds of each word's."""
        n, done = np.diff(at), []
        for low, wide in zip((0, *WIDTHS), WIDTHS):
            own = np.flatnonzero((n > low) & (n <= min(wide, LONG)))
            for k in range(0, len(own), 1 << 15):
                w = own[k : k + (1 << 15)]
                place = at[w][:, None] + np.arange(wide)
                tok = np.where(np.arange(wide) < n[w][:, None], self.v["single"][flat[np.minimum(place, len(flat) - 1)]], np.int32(-1))
                done += [(w[r], t) for r, t in self._rows(tok)]
        size = np.zeros(len(n), np.int64)
        for w, t in done:
            size[w] = (t >= 0).sum(1)
        long = np.flatnonzero(n > LONG)
        held = []
        if len(long):
            self.coder = self.coder or bpe.Coder(self.v, MEMORY)
            for i, j in chunks(np.concatenate([[0], np.cumsum(n[long])]), bpe.BATCH):
                ids, size[long[i:j]] = self.coder.contract([flat[at[w] : at[w + 1]].tobytes() for w in long[i:j]])
                held.append(ids)
        to = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(to[-1], np.int32)
        for w, t in done:
            real = t >= 0
            out[(to[w][:, None] + np.arange(t.shape[1]))[real]] = t[real]
        if len(long):
            out[_spread(to[long], size[long])] = np.concatenate(held)
        return out, to

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of texts one after the other, and the n + 1 bounds of the texts."""
        begins, hashes = [], []
        for i, j in chunks(off, HASHED):
            own = buf[off[i] : off[j]]
            s = self.starts(own, off[i : j + 1] - off[i])
            begins.append(s + off[i])
            hashes.append(word_hashes(own, s, np.append(s[1:], len(own)), fold=False) if len(s) else np.zeros(0, U64))
        begin, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, hashes))
        n = np.diff(np.append(begin, off[-1]))
        code, own = pd.factorize(h)
        first = np.zeros(len(own), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        if (n != n[first][code]).any() or (buf[off[0] : off[-1]] != buf[_spread(begin[first][code], n)]).any():  # other bytes, same hash
            code, _ = pd.factorize(np.array([buf[a : a + k].tobytes() for a, k in zip(begin, n)], object))
            first = np.zeros(code.max() + 1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            ids, to = self._contract_at(buf, begin[first], n[first])
            slot = np.arange(len(first))
        else:
            slot = self._slots(buf, own, begin[first], n[first])
            ids, to = self.ids, self.ids_at
        word = slot[code]
        size = np.diff(to)[word]
        flat = ids[_spread(to[word], size)]
        return flat, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(begin, off)]

    def _contract_at(self, buf: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.contract(buf[_spread(begin, n)], np.concatenate([[0], np.cumsum(n)]))

    def _slots(self, buf: np.ndarray, h: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Where distinct words are among the ones that were encoded; those that weren't, are now."""
        if self.raw_at[-1] > CACHE:
            self.forget()
        at = np.searchsorted(self.hash, h)
        known = np.flatnonzero(at < len(self.hash))
        known = known[self.hash[at[known]] == h[known]]
        slot = np.full(len(h), -1, np.int64)
        slot[known] = self.slot[at[known]]
        size = np.diff(self.raw_at)[slot[known]] if len(known) else np.zeros(0, np.int64)
        if (size != n[known]).any() or (self.raw[_spread(self.raw_at[slot[known]], size)] != buf[_spread(begin[known], n[known])]).any():
            self.forget()
            return self._slots(buf, h, begin, n)
        new = np.flatnonzero(slot < 0)
        if len(new):
            new = new[np.argsort(h[new])]
            ids, to = self._contract_at(buf, begin[new], n[new])
            slot[new] = len(self.raw_at) - 1 + np.arange(len(new))
            self.hash, self.slot = np.insert(self.hash, at[new], h[new]), np.insert(self.slot, at[new], slot[new])
            self.raw, self.raw_at = np.concatenate([self.raw, buf[_spread(begin[new], n[new])]]), np.concatenate([self.raw_at, self.raw_at[-1] + np.cumsum(n[new])])
            self.ids, self.ids_at = np.concatenate([self.ids, ids]), np.concatenate([self.ids_at, self.ids_at[-1] + to[1:]])
        return slot


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] places, and so on."""
    to = np.cumsum(n)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(begin - to + n, n)
