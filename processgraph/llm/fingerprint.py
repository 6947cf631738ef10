"""Document fingerprints by one-permutation MinHash with optimal densification and b-bit packing.

Each shingle is hashed once; the hash names a bin and a value, and a bin keeps its least value. An
empty bin takes the value of a full one that it finds by its own sequence of hashed bin numbers, the
same sequence in every document, so that two documents borrow alike. The low BITS bits of each bin
are packed side by side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from processgraph.llm.textnp import U64, chunks, mix, text_shingles, utf8

BINS, BITS, SHINGLE = 256, 4, 3
_EMPTY = np.uint32(0xFFFFFFFF)


def bins(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, BINS) least values; _EMPTY where no shingle fell. The top bits name the bin."""
    n = len(bounds) - 1
    out = np.full(n * BINS, _EMPTY, np.uint32)
    row = np.repeat(np.arange(n), np.diff(bounds))
    np.minimum.at(out, row * BINS + (x >> U64(56)).astype(np.int64), (x >> U64(8)).astype(np.uint32) & np.uint32(0x7FFFFFFF))
    return out.reshape(n, BINS)


def densify(sketch: np.ndarray) -> np.ndarray:
    """Fills empty bins of rows that have a full one. Attempt a of bin i looks at bin h(i, a)."""
    out, full = sketch.copy(), sketch != _EMPTY
    row, col = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        to = (mix(col.astype(U64) * U64(0x10001) + U64(attempt << 32)) % U64(BINS)).astype(np.int64)
        ok = full[row, to]
        out[row[ok], col[ok]] = sketch[row[ok], to[ok]]
        row, col = row[~ok], col[~ok]
    return out


def pack(sketch: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(rows, BINS * bits / 8) bytes of the low bits, bin 0 first, low bit first."""
    low = mix(sketch.astype(U64)) & U64((1 << bits) - 1)
    each = (low[:, :, None] >> np.arange(bits, dtype=U64)) & U64(1)
    return np.packbits(each.astype(np.uint8).reshape(len(sketch), -1), axis=1, bitorder="little")


def similarity(a: bytes | None, b: bytes | None, bits: int = BITS) -> float | None:
    """Jaccard similarity estimated from two fingerprints; None if either is missing.

    Bins that differ still agree in their low bits with the probability 2^-bits, so the share of equal
    bins e stands for (e - 2^-bits) / (1 - 2^-bits), 0 at least.
    """
    if a is None or b is None:
        return None
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8), bitorder="little").reshape(-1, bits) for v in (a, b))
    chance = 2.0**-bits
    return max(0.0, (float((x == y).all(1).mean()) - chance) / (1 - chance))


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column(1))
        for i, j in chunks(off, 1 << 20):
            x, to = text_shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], SHINGLE)
            n = np.diff(to)
            packed = pack(densify(bins(x, to)))
            prints = pa.array([r.tobytes() if k else None for r, k in zip(packed, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), prints, pa.array(n)], ["doc_id", "fingerprint", "n_shingles"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, n_shingles), one row for each row of docs.

    fingerprint is binary, BINS * BITS / 8 bytes, and null where the text is null or has no word; a text
    of one or two words is one shingle. n_shingles counts repeated shingles. Repeated rows give repeated
    rows, null ids stay null, an empty table gives no rows, and other columns are not read. A bin's value
    is a minimum, so the order of words with equal hashes can't matter.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run, f"doc_id {kind}, fingerprint binary, n_shingles long")
