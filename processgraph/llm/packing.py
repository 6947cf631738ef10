"""Packing documents into windows by minimum bin slack.

Documents are encoded by the byte-level BPE of this package (`tokens`). One of n tokens fills n // CAPACITY whole
windows by itself; what remains is an item. Within a shard, windows are filled one after the other: dynamic programming over
the multiset of remaining lengths, with the reachable sums as the bits of one integer, finds the sum
closest to the capacity, and going back through the stored integers gives how many items of each
length make it. As long as the items last, the same choice fills further windows.

Shards hold about SHARD_DOCS documents each, whatever the size of the table, so the work of a shard
doesn't grow, and only lengths are shuffled to the shards. The tokens, which are kept in the checkpoint
folder with as many bytes each as the vocabulary needs, then join the pieces that were made of their document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from processgraph.lineage import cut
from processgraph.llm import bpe, tokens
from processgraph.llm.textnp import chunks, utf8

CAPACITY, SHARD_DOCS = 2048, 20_000


def fill(lengths: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """Of (length, number of items), the numbers to take so that the sum is as close below the capacity as can be.

    Lengths are tried from the longest to the shortest and the search ends once the capacity is reached
    exactly; among equal sums, the one that uses the longest lengths stands.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, stored = 1, []
    for length, n in lengths:
        stored.append(reach)
        part, left = 1, min(n, capacity // length) if length else 0
        while left:
            take = min(part, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            part <<= 1
        if reach >> capacity:
            break
    total, out = reach.bit_length() - 1, {}
    for k in range(len(stored) - 1, -1, -1):
        length, n = lengths[k]
        count = 0
        while not stored[k] >> total & 1:
            total -= length
            count += 1
        if count:
            out[length] = count
    return out


def pack_lengths(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(numbers by length, how many windows are filled so) until no item remains."""
    left = {k: n for k, n in counts.items() if n}
    order = sorted(left, reverse=True)
    while left:
        order = [k for k in order if k in left]
        choice = fill([(k, left[k]) for k in order], capacity)
        times = min(left[k] // n for k, n in choice.items())
        yield choice, times
        for k, n in choice.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n", "row"], kind="stable")
        ids, n = rows["row"].to_numpy(), rows["n"].to_numpy()
        window = 0
        out: list[tuple[int, int, int, int, int]] = []
        items: dict[int, list[int]] = defaultdict(list)
        for k in range(len(ids)):
            for piece in range(n[k] // capacity):
                out.append((window, 0, ids[k], piece * capacity, capacity))
                window += 1
            if n[k] % capacity:
                items[int(n[k] % capacity)].append(k)
        for rest in items.values():
            rest.reverse()
        for choice, times in pack_lengths({x: len(v) for x, v in items.items()}, capacity):
            for _ in range(times):
                at = 0
                for length in sorted(choice, reverse=True):
                    for _ in range(choice[length]):
                        k = items[length].pop()
                        out.append((window, at, ids[k], n[k] - length, length))
                        at += length
                window += 1
        made = pd.DataFrame(out, columns=["window", "position", "row", "start", "n_tokens"], dtype="int64")
        made.insert(0, "shard", int(rows["shard"].iloc[0]))
        return made

    return run


def _coded(held, kind: type):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(*held.value)
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in chunks(off, tokens.CODED):
                flat, bounds = encoder.encode(data, off[i : j + 1])
                at = (bounds * np.dtype(kind).itemsize).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(flat.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids, pa.array(np.diff(bounds))], ["doc_id", "ids", "n"])

    return run


def _listed(kind: type):
    """The last column, tokens as bytes, becomes lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
            flat = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind) if len(raw) else np.zeros(0, kind)
            ids = pa.ListArray.from_arrays(pa.array((at - at[0]) // np.dtype(kind).itemsize, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], batch.schema.names)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(shard, window, position, doc_id, start, n_tokens, ids): tokens [start, start + n_tokens) of a document, which are ids, at a position of a window.

    Windows are numbered within their shard. Every token of every document is in exactly one piece; only
    a document longer than the capacity has several. Texts that are null or empty have no piece, and rows
    without an id, or with one that isn't an integer, are left out, since nothing could name them. Rows that
    repeat an id are packed each for itself. Of items of one length, the least id goes first. No rows give
    no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text <> ''")
    loaded = bpe.load(vocabulary)
    kind = np.uint16 if max(loaded["tokens"].values()) < 1 << 16 else np.uint32
    held = docs.sparkSession.sparkContext.broadcast((loaded, tokens.classes()))
    coded = cut(rows.mapInArrow(_coded(held, kind), "doc_id long, ids binary, n long"))
    coded = coded.withColumn("row", F.monotonically_increasing_id())  # the same each time, since the rows are stored
    shards = max(1, -(-coded.count() // shard_docs))
    sized = coded.select("doc_id", "n", "row").withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int"))
    made = sized.repartition(shards, "shard").groupBy("shard").applyInPandas(_pack(capacity), "shard int, window long, position long, row long, start long, n_tokens long")
    whole = made.join(coded.select("row", "doc_id", "ids"), "row")
    wide = np.dtype(kind).itemsize
    pieces = whole.select("shard", "window", "position", "doc_id", "start", "n_tokens", F.substring("ids", (F.col("start") * wide + 1).cast("int"), (F.col("n_tokens") * wide).cast("int")).alias("ids"))
    return pieces.mapInArrow(_listed(kind), "shard int, window long, position long, doc_id long, start long, n_tokens long, ids array<int>")
