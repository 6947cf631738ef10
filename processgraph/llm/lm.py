"""Language-model scores from a log-frequency Bloom filter.

The n-grams are of bytes, up to ORDER, counted over the whole corpus. A count c is stored as its level
1 + floor(log_BASE c): the filter holds the pairs (n-gram, 1) to (n-gram, level), HASHES bits each, and
a level is read by probing 1, 2, ... until a probe misses. A miss is certain, so the level is never too
low; that it is too high by j levels gets less likely with each j. The filter is cut into segments by a
hash of the n-gram; each segment is filled by one task, and the whole is broadcast to the workers.

Its size follows the number of distinct n-grams, BITS for each stored pair. Byte n-grams of a fixed
order saturate: their number grows far slower than the corpus. It is checked against LIMIT_MB before it
is broadcast.

Over the bytes stand n-grams of words, up to WORDS, whose number does grow with the corpus; all of them are
counted and stored. Tasks send hashes of 52 bits in blocks, and each bucket of hashes is one part of a second filter.
When the corpus itself is scored (`score_corpus`), no worker holds more of that filter than a bucket: the task of a bucket
builds its part, reads in it the levels of each block that came, and sends them back, a byte for each n-gram, to the texts
that the block was made of. So the corpus may be of any size. For other texts `fit_words` broadcasts the filter, up to LIMIT_MB.

A byte's probability after its context h is (c(hw) + MASS * P(w | shorter h)) / (c(h) + MASS), from 1/256
up; a count read as smaller for the context than for what continues it is raised to it. A word's probability starts from that of its bytes
and goes on in the same way over the words before it; white space has the probability of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from processgraph.lineage import cut
from processgraph.llm.textnp import U64, chunks, mix, utf8, word_hashes
from processgraph.llm.textnp import words as find_words

ORDER, BASE, HASHES, BITS, SEGMENT, MASS, LIMIT_MB = 5, 1.5, 6, 14, 1 << 20, 4.0, 1024
WORDS, BUCKET_BITS, KEY_BITS = 3, 12, 40
#: Of the filter of words: hashes, bits for each stored pair, and bytes that are broadcast at a time.
WORD_HASHES, WORD_BITS, SHARE = 4, 10, 16 << 20
#: Bytes of text that a worker scores at a time, and byte n-grams whose probabilities it keeps.
SCORED, KEPT = 1 << 20, 1_000_000
#: Bytes of text whose n-grams of words are asked for at a time.
ASKED = 6 << 20


def codes(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as an integer whose lowest byte is that byte. Before a text there are zeros."""
    buf = data[off[0] : off[-1]]
    out = buf.astype(U64)
    place = np.arange(len(buf)) - np.repeat(off[:-1] - off[0], np.diff(off))
    for k in range(1, order):
        earlier = np.zeros(len(buf), U64)
        earlier[k:] = buf[:-k] if len(buf) > k else 0
        earlier[place < k] = 0
        out |= earlier << U64(8 * k)
    return out


def level(count: np.ndarray, base: float = BASE) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(base) + 1e-9).astype(np.int64)


def size_of(levels: np.ndarray, base: float = BASE) -> np.ndarray:
    """The count that a level stands for: the middle of its range, 0 for level 0."""
    return np.where(levels > 0, np.floor((base ** (levels - 1.0) + np.maximum(base**levels - 1, 1)) / 2), 0.0)


def _probes(key: np.ndarray, lev: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """A start and an odd step within a segment; probe i is at start + i * step."""
    h = mix(key + U64(0x632BE59BD9B4E019) * np.asarray(lev).astype(U64))
    return h, (h >> U64(32)) | U64(1)


def segment_of(key: np.ndarray, segments: int) -> np.ndarray:
    return (mix(key ^ U64(0xA0761D6478BD642F)) % U64(segments)).astype(np.int64)


def tag(code: np.ndarray, n: int) -> np.ndarray:
    """The key of an n-gram: its bytes with its order above them."""
    return (code & U64((1 << (8 * n)) - 1)) | U64(n << 56)  # order 0 is the key 0: how many bytes there are


def word_keys(buf: np.ndarray, off: np.ndarray, order: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and bounds of the words, and (order, words) the keys of the n-grams of words that end at each; 0 where a text has no n words yet."""
    starts, ends, bounds = find_words(buf, off)
    h = word_hashes(buf, starts, ends, fold=False)
    place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = np.zeros((order, len(h)), U64)
    for n in range(order):
        out[n, n:] = mix((out[n - 1, n - 1 : -1] if n > 1 else out[0, :-1]) * U64(0xD6E8FEB86659FD93) + h[n:]) if n else mix(h ^ U64(0xA0761D6478BD642F))
        out[n] = np.where(place < n, U64(0), out[n] >> U64(64 - BUCKET_BITS - KEY_BITS) | U64(1 if n == 0 else 0))
    return starts, ends, bounds, out


class Filter:
    """The filter's segments, one after the other."""

    def __init__(self, bits: np.ndarray, segments: int, base: float = BASE):
        self.bits, self.segments, self.base = bits, segments, base

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Each n-gram's level, by probes from level 1 until one misses."""
        out, live = np.zeros(len(key), np.int64), np.arange(len(key))
        at = segment_of(key, self.segments) * SEGMENT
        while len(live):
            h, step = _probes(key[live], out[live] + 1)
            for i in range(HASHES):
                p = at[live] + ((h + U64(i) * step) % U64(SEGMENT)).astype(np.int64)
                hit = (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                live, h, step = live[hit], h[hit], step[hit]
            out[live] += 1
        return out

    def counts(self, key: np.ndarray) -> np.ndarray:
        return size_of(self.levels(key), self.base)


def segment_bits(key: np.ndarray, levels: np.ndarray) -> np.ndarray:
    bits = np.zeros(SEGMENT, np.uint8)
    for j in range(1, int(levels.max(initial=0)) + 1):
        h, step = _probes(key[levels >= j], j)
        for i in range(HASHES):
            bits[((h + U64(i) * step) % U64(SEGMENT)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def _block(key: np.ndarray, lev: np.ndarray | int, size: np.ndarray | int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of 64 bits, of `size`, that holds a pair (n-gram, level), and its bits there: a probe reads one place of the memory."""
    h = mix(key + U64(0x632BE59BD9B4E019) * np.asarray(lev).astype(U64))
    block = ((h >> U64(32)) * np.asarray(size).astype(U64) >> U64(32)).astype(np.int64)
    return block, [U64(1) << (h >> U64(6 * i) & U64(63)) for i in range(WORD_HASHES)]


class WordFilter:
    """A filter of word n-grams: bucket b's bits are bytes at[b] to at[b + 1]. total is the number of words.

    The bits were broadcast in shares, each a list of (place, bytes); neither the driver nor a worker holds more than one share
    beside the whole, and the driver never holds the whole.
    """

    def __init__(self, shares: list, at: np.ndarray, total: int, order: int = WORDS, base: float = BASE):
        self.shares, self.at, self.total, self.order, self.base = shares, at, total, order, base
        self._bits: np.ndarray | None = None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.zeros(self.at[-1], np.uint8)
            for share in self.shares:
                for place, x in share.value:
                    self._bits[place : place + len(x)] = np.frombuffer(x, np.uint8)
                share.__dict__.pop("_value", None)
        return self._bits

    def counts_of(self, key: np.ndarray) -> np.ndarray:
        """counts() of keys that repeat, each looked up once."""
        own, inverse = np.unique(key, return_inverse=True)
        return self.counts(own)[inverse]

    def counts(self, key: np.ndarray) -> np.ndarray:
        bucket = (key >> U64(KEY_BITS)).astype(np.int64)
        size = (self.at[bucket + 1] - self.at[bucket]) >> 3
        return size_of(block_levels(self.bits.view(U64), key, self.at[bucket] >> 3, size), self.base)


def block_levels(blocks: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The level of each key, by probes in the `size` blocks from `start` on until one misses."""
    out, live, lev = np.zeros(len(key), np.int64), np.flatnonzero(size > 0), 0
    key, start, size = key[live], start[live], size[live]
    while len(live):
        lev += 1
        block, places = _block(key, lev, size)
        mask = places[0]
        for x in places[1:]:
            mask = mask | x
        hit = blocks[start + block] & mask == mask
        live, key, start, size = live[hit], key[hit], start[hit], size[hit]
        out[live] = lev
    return out


def _count_words(order: int):
    """Each chunk's n-grams in blocks: for each bucket the low KEY_BITS of the keys, and their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in chunks(off, 1 << 22):
                buf = data[off[i] : off[j]]
                _, _, bounds, keys = word_keys(buf, off[i : j + 1] - off[i], order)
                key, n = np.unique(keys[keys > 0], return_counts=True)
                if not len(key):
                    continue
                bucket = (key >> U64(KEY_BITS)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                last = np.append(first[1:], len(key))
                low = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8])
                n = n.astype(np.uint32)
                rows = [(low[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(first, last)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary()), pa.array([int(bounds[-1])] + [0] * (len(rows) - 1), pa.int64())], ["bucket", "keys", "counts", "words"])

    return run


def merged(bucket: int, keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a bucket's blocks and their counts over all of them."""
    low = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BITS // 8)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, : KEY_BITS // 8] = low
    key, n = wide.view(U64).ravel() | U64(bucket << KEY_BITS), np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)
    rank = np.argsort(key)
    key, n = key[rank], n[rank]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def bucket_bits(key: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The blocks of a bucket as bytes: every pair (n-gram, 1) to (n-gram, level) sets its bits in one of them."""
    blocks = np.zeros(-(-int(levels.sum()) * WORD_BITS // 64), U64)
    last = np.cumsum(levels)
    lev = np.arange(1, int(levels.sum()) + 1) - np.repeat(last - levels, levels)
    block, places = _block(np.repeat(key, levels), lev, len(blocks))
    for x in places:
        np.bitwise_or.at(blocks, block, x)
    return blocks.view(np.uint8)


def fit_words(docs: DataFrame, text_col: str = "text", order: int = WORDS, base: float = BASE) -> WordFilter:
    """The filter of the n-grams of 1 to `order` words of all texts."""

    def build(table: pa.Table) -> pa.Table:
        key, n = merged(table.column("bucket")[0].as_py(), table.column("keys").to_pylist(), table.column("counts").to_pylist())
        total = sum(table.column("words").to_pylist())
        return pa.table({"bucket": table.column("bucket")[:1], "words": pa.array([total]), "bits": pa.array([bucket_bits(key, level(n, base)).tobytes()], pa.binary())})

    blocks = docs.select(F.col(text_col).cast("string")).mapInArrow(_count_words(order), "bucket long, keys binary, counts binary, words long")
    built = cut(blocks.groupBy("bucket").applyInArrow(build, "bucket long, words long, bits binary"))
    sizes = built.select("bucket", "words", F.length("bits").alias("n")).collect()
    at = np.zeros((1 << BUCKET_BITS) + 1, np.int64)
    for r in sizes:
        at[r["bucket"] + 1] = r["n"]
    at = np.cumsum(at)
    if at[-1] / 1e6 > LIMIT_MB:
        raise ValueError(f"the filter of words would take {at[-1] / 1e6:.0f} MB on every worker; the limit is {LIMIT_MB}")
    sc, held, shares = docs.sparkSession.sparkContext, [], []

    def share() -> None:
        if held:
            shares.append(sc.broadcast([(int(at[b]), x) for b, x in held]))
            held.clear()

    for r in built.select("bucket", "bits").toLocalIterator():
        held.append((r["bucket"], bytes(r["bits"])))
        if sum(len(x) for _, x in held) >= SHARE:
            share()
    share()
    return WordFilter(shares, at, sum(r["words"] for r in sizes), order, base)


def found(keys: np.ndarray, place: np.ndarray, model: WordFilter) -> np.ndarray:
    """(order, words) the counts of the n-grams of words that end at each word; 0 where a text has no n words yet."""
    out = np.zeros(keys.shape)
    for n in range(model.order):
        real = place >= n
        out[n, real] = model.counts_of(keys[n][real]) if n < 2 else model.counts(keys[n][real])
    return out


def word_log_probability(spelled: np.ndarray, counts: np.ndarray, place: np.ndarray, total: int) -> np.ndarray:
    """ln P of each word after the words before it, from ln P of its bytes and the counts of its n-grams. place is its place in its text."""
    p, before = spelled, np.full(len(spelled), float(total))
    for n, own in enumerate(counts):
        real = place >= n
        with np.errstate(divide="ignore"):
            p = np.where(real, np.logaddexp(np.log(own), np.log(MASS) + p) - np.log(np.maximum(before, own) + MASS), p)
        before = np.concatenate([[0.0], own[:-1]])
    return p


def log_probability(code: np.ndarray, count_of, order: int = ORDER) -> np.ndarray:
    """ln P of the last byte of each n-gram after the bytes before it. count_of gives the counts of keys."""

    def each(keys: np.ndarray) -> np.ndarray:
        own, inverse = np.unique(keys, return_inverse=True)
        return count_of(own)[inverse]

    p = np.full(len(code), 1 / 256)
    for n in range(1, order + 1):
        real = np.ones(len(code), bool) if n == 1 else (code >> U64(8 * (n - 1))) & U64(255) > 0
        own = each(tag(code, n))
        before = each(tag(code >> U64(8), n - 1) if n > 1 else np.zeros(len(code), U64))
        p = np.where(real, (own + MASS * p) / (np.maximum(before, own) + MASS), p)
    return np.log(p)


def _count(order: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = (np.concatenate(x) for x in zip(*held))
            rank = np.argsort(key, kind="stable")
            key, n = key[rank], n[rank]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return key[first], np.add.reduceat(n, first)

        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in chunks(off, 1 << 22):
                if off[j] > off[i]:
                    held.append(np.unique(codes(data, off[i : j + 1], order), return_counts=True))
                if sum(len(k) for k, _ in held) > 4_000_000:
                    held[:] = [merged()]
        if held:
            key, n = merged()
            for s in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[s : s + 100_000].view(np.int64)), pa.array(n[s : s + 100_000])], ["code", "n"])

    return run


def _lower(order: int):
    """Each longest n-gram gives its count to the n-grams of every order that end with its last byte."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()
            keys, counts = [tag(np.zeros(1, U64), 0)], [np.array([n.sum()])]
            for k in range(1, order + 1):
                real = (code >> U64(8 * (k - 1))) & U64(255) > 0
                key = tag(code[real], k)
                rank = np.argsort(key)
                key, own = key[rank], n[real][rank]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
                keys.append(key[first])
                counts.append(np.add.reduceat(own, first) if len(first) else own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts))], ["key", "n"])

    return run


def counts(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(key, n): how often each n-gram of 0 to `order` bytes occurs in all texts; key as in tag()."""
    longest = docs.select(F.col(text_col).cast("string")).mapInArrow(_count(order), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return longest.mapInArrow(_lower(order), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", order: int = ORDER, base: float = BASE) -> Filter:
    """The filter of the counts of all texts. Without texts it is empty, and every byte has the probability 1/256."""
    found = cut(counts(docs, text_col, order))
    stored = found.agg(F.sum((F.floor(F.log("n") / float(np.log(base)) + 1e-9) + 1).cast("long"))).first()[0] or 0
    segments = max(1, -(-stored * BITS // SEGMENT))
    if segments * SEGMENT / 8e6 > LIMIT_MB:
        raise ValueError(f"the filter would take {segments * SEGMENT / 8e6:.0f} MB on every worker; the limit is {LIMIT_MB}")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        bits = segment_bits(rows["key"].to_numpy().view(U64), level(rows["n"].to_numpy(), base))
        return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "bits": [bits.tobytes()]})

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = segment_of(batch.column(0).to_numpy().view(U64), segments)
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], ["segment", "key", "n"])

    built = found.mapInArrow(place, "segment long, key long, n long").groupBy("segment").applyInPandas(build, "segment long, bits binary")
    bits = np.zeros(segments * SEGMENT // 8, np.uint8)
    for row in built.toLocalIterator():
        bits[row["segment"] * SEGMENT // 8 : (row["segment"] + 1) * SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(bits, segments, base)


def score(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, words: WordFilter | None = None) -> DataFrame:
    """(doc_id, n_bytes, log_prob, perplexity), one row for each row of docs, in one pass without a shuffle.

    log_prob is the sum of ln P over the text's bytes, or with `words` over its words and white space, perplexity exp of the mean of -ln P. A null or empty
    text has 0 bytes, log_prob 0 and no perplexity; texts of any length are read whole. Repeated rows give
    repeated rows, null ids stay null, no rows give no rows, other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.bits, model.segments, model.base))
    sparse = words and (words.shares, words.at, words.total, words.order, words.base)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, longer = Scorer(Filter(*held.value), order), WordFilter(*sparse) if sparse else None
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in chunks(off, SCORED):
                counts = None
                if longer:
                    _, _, bounds, keys = word_keys(data[off[i] : off[j]], off[i : j + 1] - off[i], longer.order)
                    counts = found(keys, _place(bounds), longer)
                yield scorer.rows(batch.column(0).slice(i, j - i), data, off[i : j + 1], counts, longer.total if longer else 0)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, _schema(kind))


def _schema(kind: str) -> str:
    return f"doc_id {kind}, n_bytes long, log_prob double, perplexity double"


def _place(bounds: np.ndarray) -> np.ndarray:
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))


class Scorer:
    """Scores texts by a filter of bytes; the probabilities of up to KEPT n-grams are kept."""

    def __init__(self, own: Filter, order: int):
        self.own, self.order = own, order
        self.known, self.value = np.zeros(0, U64), np.zeros(0)

    def rows(self, ids: pa.Array, data: np.ndarray, off: np.ndarray, counts: np.ndarray | None, words: int) -> pa.RecordBatch:
        """The rows of some texts. counts: of their n-grams of words, as found() has them; words: how many the corpus has."""
        code, inverse = np.unique(codes(data, off, self.order), return_inverse=True)
        new = np.setdiff1d(code, self.known, assume_unique=True)
        if len(self.known) + len(new) > KEPT:
            self.known, self.value, new = np.zeros(0, U64), np.zeros(0), code
        if len(new):
            known, value = np.concatenate([self.known, new]), np.concatenate([self.value, log_probability(new, self.own.counts, self.order)])
            rank = np.argsort(known)
            self.known, self.value = known[rank], value[rank]
        run_sum = np.concatenate([[0], np.cumsum(self.value[np.searchsorted(self.known, code)][inverse])]) if len(code) else np.zeros(1)
        at = off - off[0]
        if counts is not None:
            starts, ends, bounds = find_words(data[off[0] : off[-1]], at)
            spelled = run_sum[ends] - run_sum[starts]
            gain = np.zeros(len(run_sum))
            gain[ends] = word_log_probability(spelled, counts, _place(bounds), words) - spelled
            run_sum += np.cumsum(gain)
        total, n = run_sum[at[1:]] - run_sum[at[:-1]], np.diff(at)
        perplexity = pa.array(np.exp(-total / np.maximum(n, 1)), mask=n == 0)
        return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(total), perplexity], ["doc_id", "n_bytes", "log_prob", "perplexity"])


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ASKED bytes of text: a hash of the texts, the rows, the bytes and the offsets of their texts."""
    for batch in batches:
        data, off = utf8(batch.column(1))
        for i, j in chunks(off, ASKED):
            own = off[i : j + 1]
            name = hashlib.blake2b((own - own[0]).tobytes(), digest_size=8)
            name.update(data[own[0] : own[-1]])
            yield int.from_bytes(name.digest(), "big", signed=True), batch.slice(i, j - i), data, own


def _part_keys(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """word_keys of texts, and the ranges of the texts of which SCORED bytes at a time are."""
    ranges = list(chunks(off, SCORED))
    return np.concatenate([word_keys(data[off[i] : off[j]], off[i : j + 1] - off[i], order)[3] for i, j in ranges], axis=1), ranges


_BLOCK = "chunk long, bucket long, words long, low binary, high binary, n binary, more binary"


def _ask(order: int):
    """A block for each bucket that a chunk of texts has n-grams in, and one of bucket 0 that also says how many words there are.

    Of the sorted keys low has 32 bits each, and high how many keys have each value of the 8 bits between these and the bucket. n has the counts
    as bytes, or 255 where more has them as integers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, data, off in _parts(batches):
            keys, _ = _part_keys(data, off, order)
            total = keys.shape[1]
            key, n = np.unique(keys[keys > 0], return_counts=True)
            del keys
            step = 1 << (KEY_BITS - 32)
            high = np.bincount((key >> U64(32)).astype(np.int64), minlength=step << BUCKET_BITS)
            at = np.concatenate([[0], np.cumsum(high.reshape(-1, step).sum(1))])
            high = high.astype(np.uint8 if high.max() < 256 else np.uint32)
            low, small, many = key.astype(np.uint32), np.minimum(n, 255).astype(np.uint8), np.flatnonzero(n >= 255)
            more = np.searchsorted(many, at)
            sent = np.flatnonzero((np.diff(at) > 0) | (np.arange(len(at) - 1) == 0))
            for part in np.array_split(sent, 8):
                cells = [(low[at[b] : at[b + 1]].tobytes(), high[b * step : (b + 1) * step].tobytes(), small[at[b] : at[b + 1]].tobytes(), n[many[more[b] : more[b + 1]]].tobytes()) for b in part]
                arrays = [pa.array([x[k] for x in cells], pa.binary()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part), pa.array(np.where(part == 0, total, 0)), *arrays], ["chunk", "bucket", "words", "low", "high", "n", "more"])

    return run


def _reply(base: float):
    """The blocks of a bucket become its part of the filter, and what that has for each key of each block is sent back."""

    def run(table: pa.Table) -> pa.Table:
        bucket, step = table.column("bucket")[0].as_py(), 1 << (KEY_BITS - 32)
        low, small, more = ([x for x in table.column(c).to_pylist()] for c in ("low", "n", "more"))
        at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in low])])
        high = np.concatenate([np.frombuffer(x, np.uint8 if len(x) == step else np.uint32).astype(np.int64) for x in table.column("high").to_pylist()])
        key = np.repeat(np.tile(np.arange(step, dtype=U64), len(low)), high) << U64(32) | np.frombuffer(b"".join(low), np.uint32) | U64(bucket << KEY_BITS)
        n = np.frombuffer(b"".join(small), np.uint8).astype(np.int64)
        n[n == 255] = np.frombuffer(b"".join(more), np.int64)
        own, inverse = np.unique(key, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, inverse, n)
        blocks = bucket_bits(own, level(total, base)).view(U64)
        levels = block_levels(blocks, own, np.zeros(len(own), np.int64), np.full(len(own), len(blocks))).astype(np.uint8)[inverse]
        words = sum(table.column("words").to_pylist())
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "words": pa.array(np.full(len(low), words)), "levels": pa.array([levels[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())})

    return run


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of texts again, with their ids, compressed."""
    for chunk, rows, _, _ in _parts(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "texts"])


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, words: int = WORDS, base: float = BASE, stored: bool = False) -> DataFrame:
    """The rows of score(docs, fit(docs), words=fit_words(docs)), for a corpus of any size.

    docs are read three times; `stored` says that they come in the same order each time, as a table does that is read from files.
    Otherwise they are stored first. If texts came in other chunks than before, the query raises an error.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs if stored else cut(docs)
    model = fit(docs, "text", order, base)
    held = docs.sparkSession.sparkContext.broadcast((model.bits, model.segments, model.base))

    def run(replies: pa.Table, texts: pa.Table) -> pa.Table:
        if not len(replies) or not len(texts):
            raise ValueError("the texts came in another order than before")
        bucket, first = np.unique(replies.column("bucket").to_numpy(), return_index=True)  # chunks of the same texts have the same replies
        levels, total = replies.column("levels").to_pylist(), replies.column("words").to_numpy()[first[0]]
        size = size_of(np.arange(256), base)[np.frombuffer(b"".join(levels[k] for k in first), np.uint8)]
        scorer, out = Scorer(Filter(*held.value), order), []
        for blob in texts.column("texts"):
            for rows in pa.ipc.open_stream(blob.as_buffer()):
                data, off = utf8(rows.column(1))
                keys, ranges = _part_keys(data, off, words)
                real = keys > 0
                own, inverse = np.unique(keys[real], return_inverse=True)
                if len(own) != len(size):
                    raise ValueError("the replies are not those to these texts")
                counts = np.zeros(keys.shape)
                counts[real] = size[inverse]
                del keys, own, inverse
                at = 0
                for i, j in ranges:
                    n = len(find_words(data[off[i] : off[j]], off[i : j + 1] - off[i])[0])
                    out.append(scorer.rows(rows.column(0).slice(i, j - i), data, off[i : j + 1], counts[:, at : at + n], total))
                    at += n
        return pa.Table.from_batches(out)

    blocks = docs.mapInArrow(_ask(words), _BLOCK)
    replies = blocks.groupBy("bucket").applyInArrow(_reply(base), "chunk long, bucket long, words long, levels binary")
    texts = docs.mapInArrow(_packed, "chunk long, texts binary")
    return replies.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInArrow(run, _schema(docs.schema["doc_id"].dataType.simpleString()))
