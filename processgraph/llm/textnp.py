"""Text columns as numpy arrays: words, hashes and shingles of whole Arrow batches at once.

Every helper works on bytes of UTF-8. Words are runs of bytes other than ASCII white space; ASCII
letters are compared without case. Null texts count as empty. Nothing is cut off: a text longer than
a chunk is a chunk by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), off.astype(np.int64)


def chunks(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; every row falls into exactly one."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, all bits spread."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, _BACK):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of buf, and the n + 1 bounds of each row's words."""
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, without its case if fold, by differences of one running polynomial."""
    there, back = _power(len(buf) + 1)
    run = np.zeros(len(buf) + 1, U64)
    term = (LOWER[buf] if fold else buf).astype(U64)
    term += U64(1)
    term *= there[: len(buf)]
    np.cumsum(term, out=run[1:])
    return mix((run[ends] - run[starts]) * back[starts])


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words within each row, and their bounds. A row of 1 to k words has one."""
    n = np.diff(bounds)
    m = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    to = np.concatenate([[0], np.cumsum(m)])
    at = np.arange(to[-1]) - np.repeat(to[:-1] - bounds[:-1], m)
    end = np.repeat(bounds[1:], m)
    out = np.zeros(len(at), U64)
    for j in range(k):
        w = at + j
        ok = w < end
        out = out * U64(0xD6E8FEB86659FD93) + np.where(ok, hashes[np.minimum(w, max(len(hashes) - 1, 0))], U64(j + 1))
    return mix(out), to


def text_shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of rows and their bounds."""
    starts, ends, bounds = words(buf, off)
    return shingles(word_hashes(buf, starts, ends), bounds, k)
