"""Near duplicates by a chosen-path set similarity join over minwise signatures.

Documents are sets of word shingles. A signature of minwise tokens embeds each set, so that two sets
agree in each token with the probability of their Jaccard similarity. Each of several independent
trees branches a node's documents by the tokens at a few coordinates that the node itself selects:
two per node, so that a pair at the threshold 0.5 is expected to stay together in one child. Nodes of
one document end, nodes of up to LEAF documents are compared exhaustively, larger ones branch on, to
DEPTH levels. A child that keeps the share DENSE of its parent holds sets that hardly differ: branching
doesn't divide it, so it is compared exhaustively at once, as is what is still large at the last level.

Comparison joins two documents whose signatures agree in at least the threshold's share of tokens.
Inside a node only links between different components are needed, so pairs that are already joined
aren't compared again: a group of thousands of copies costs one pass, not its square.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from processgraph.lineage import cut
from processgraph.llm.components import components
from processgraph.llm.textnp import U64, chunks, mix, text_shingles, utf8

TOKENS, SHINGLE, THRESHOLD, TREES, WIDTH, LEAF, DEPTH, DENSE = 128, 3, 0.5, 6, 2, 100, 6, 0.7
_XOR = mix(np.arange(1, TOKENS + 1, dtype=U64)).astype(np.uint32)
_MUL = mix(np.arange(10_001, TOKENS + 10_001, dtype=U64)).astype(np.uint32) | np.uint32(1)


def minwise(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures (rows, TOKENS) of the rows that have shingles."""
    low = (x >> U64(32)).astype(np.uint32)
    at = bounds[:-1]
    out = np.empty((len(at), TOKENS), np.uint32)
    for t in range(TOKENS):
        v = low ^ _XOR[t]
        v *= _MUL[t]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[:, t] = np.minimum.reduceat(v, at)
    return out


def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, sig); documents without words have no signature and no row."""
    for batch in batches:
        ids = batch.column(0)
        data, off = utf8(batch.column(1))
        for i, j in chunks(off, 1 << 20):
            x, to = text_shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], SHINGLE)
            has = np.flatnonzero(np.diff(to))
            if len(has):
                sig = minwise(x, np.append(to[has], to[-1]))
                packed = pa.array([r.tobytes() for r in sig], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(has + i)), packed], ["id", "sig"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, TOKENS)


def branch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, id, sig, n) to (node, id, n) of the children, n being the size of the parent: the node selects WIDTH coordinates, the tokens there name the child."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy().astype(np.int64).view(U64)
        sig, row = _matrix(batch.column(2)), np.arange(batch.num_rows)
        first = mix(node ^ U64(0x51ED270B)) % U64(TOKENS)
        step = U64(1) + mix(node ^ U64(0x2545F491)) % U64(TOKENS - 1)
        for k in range(WIDTH):
            c = (first + step * U64(k)) % U64(TOKENS)
            token = sig[row, c.astype(np.int64)].astype(U64)
            child = mix(mix(node + c) ^ token).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(child), batch.column(1), batch.column(3)], ["node", "id", "pn"])


def _agree(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return (a == b).sum(-1) >= threshold * TOKENS - 1e-9


def exhaust(sig: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links that connect the same rows as all pairs that agree would.

    A few rows are compared with every row first. Then each row outside the largest component is
    compared with every row: pairs inside that component can't connect anything new.
    """
    n, links = len(sig), []
    label = np.arange(n)

    def against(p: int) -> None:
        hit = np.flatnonzero(_agree(sig, sig[p], threshold))
        hit = hit[label[hit] != label[p]]
        links.extend((p, int(h)) for h in hit)
        for old in np.unique(label[hit]):
            label[label == old] = label[p]

    for p in np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int)):
        against(int(p))
    names, size = np.unique(label, return_counts=True)
    largest = names[size.argmax()]
    rest = np.flatnonzero(label != largest)
    for p in rest:
        against(int(p))
    return links


def _groups(leaf: np.ndarray, ids: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[list, list]:
    """Links of whole nodes that lie one after the other: of each node no more than it has documents."""
    cut_at = np.flatnonzero(np.diff(leaf)) + 1
    start, size = np.concatenate([[0], cut_at]), np.diff(np.concatenate([[0], cut_at, [len(leaf)]]))
    a, b = [], []
    for n in np.unique(size):
        own = start[size == n]
        if 2 <= n <= 32:
            i, j = np.triu_indices(n, 1)
            for s in range(0, len(own), max(1, 20_000 // len(i))):
                at = own[s : s + max(1, 20_000 // len(i))]
                like = np.zeros((len(at), n, n), bool)
                like[:, i, j] = _agree(sig[(at[:, None] + i).ravel()], sig[(at[:, None] + j).ravel()], threshold).reshape(len(at), -1)
                like |= like.transpose(0, 2, 1) | np.eye(n, dtype=bool)
                label, before = np.broadcast_to(np.arange(n), (len(at), n)), None
                while before is None or (label != before).any():
                    before, label = label, np.where(like, label[:, None, :], n).min(2)
                g, x = np.nonzero(label != np.arange(n))
                a.append(ids[at[g] + x])
                b.append(ids[at[g] + label[g, x]])
        elif n > 32:
            for s in own:
                if links := exhaust(sig[s : s + n], threshold):
                    x, y = np.array(links).T
                    a.append(ids[s + x])
                    b.append(ids[s + y])
    return a, b


def compare(threshold: float):
    """(leaf, id, sig), sorted by leaf, to links (a, b). A node that runs over batches is kept until it ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                leaf, ids, sig = (np.concatenate(x) for x in zip(*held))
                a, b = _groups(leaf, ids, sig, threshold)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, ids, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            if held and held[-1][0][-1] != leaf[0]:
                yield from flush()
                held.clear()
            edge = int(np.searchsorted(leaf, leaf[-1], "left"))
            if edge:
                held.append((leaf[:edge], ids[:edge], sig[:edge]))
                yield from flush()
                held.clear()
            held.append((leaf[edge:], ids[edge:], sig[edge:]))
        yield from flush()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(doc_id, group_id): documents linked by chains of near copies share the least doc_id of them.

    Every document with an id has one row; one that is like no other has its own id as group_id. Texts
    that are null or without words are like no other. Rows that repeat an id are one document, which is
    like whatever any of its texts is like. Rows without an id are left out. Copies of equal shingle
    sets meet in one step; ties can't arise, since group_id is a minimum. No rows give no rows. Other
    columns, whatever their names, are not read. An id that isn't an integer counts as none.
    """
    rows = docs.select(F.col(id_col).try_cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    same = Window.partitionBy(F.xxhash64("sig"), F.xxhash64(F.lit(7), "sig")).orderBy("id")
    signed = rows.mapInArrow(sign, "id long, sig binary")
    signed = cut(signed.select("id", "sig", F.first("id").over(same).alias("first"), F.row_number().over(same).alias("nth")))
    copies = signed.where("nth > 1").select(F.col("id").alias("a"), F.col("first").alias("b"))
    one = signed.where("nth = 1").select("id", "sig")
    roots = F.explode(F.array(*(F.lit(int(mix(np.array([t + 1], U64)).view(np.int64)[0])) for t in range(trees))))
    kind = "node long, id long, pn long"
    front = one.select(roots.alias("node"), "id", "sig", F.lit(None).cast("long")).mapInArrow(branch, kind)
    lists = []
    for level in range(DEPTH):
        front = cut(front.withColumn("n", F.count("*").over(Window.partitionBy("node"))).where("n > 1"))
        if not level:
            one = cut(one.join(front.select("id").distinct(), "id", "left_semi"))
        last = level == DEPTH - 1
        done = (F.col("n") <= leaf) | F.coalesce(F.col("n") >= DENSE * F.col("pn"), F.lit(last)) | F.lit(last)
        small = front.where(done)
        lists.append(small.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids")))
        big = front.where(~done)
        if last or big.isEmpty():
            break
        front = big.join(one, "id").select("node", "id", "sig", "n").mapInArrow(branch, kind)
    nodes = lists[0]
    for x in lists[1:]:
        nodes = nodes.unionAll(x)
    nodes = nodes.groupBy("ids").agg(F.min("node").alias("leaf"))
    members = nodes.select("leaf", F.explode("ids").alias("id")).join(one, "id").select("leaf", "id", "sig")
    found = members.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(compare(threshold), "a long, b long")
    joined = components(copies.unionAll(found)).withColumnRenamed("node", "id")
    out = rows.select("id").distinct().join(joined, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("root", "id").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, less all but the least id of each group.

    Of rows that repeat an id, the first in the order of the text stays, null last. Rows without an id stay, and documents
    without words, since they are like no other. No rows give no rows; columns may have any names.
    """
    gone = near_duplicates(docs, id_col, text_col).where("doc_id > group_id").select(F.col("doc_id").alias("gone"))
    rows = docs.select(F.struct("*").alias("r"), F.col(id_col).try_cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    named = rows.where("i is not null")
    kept = named.join(gone, named["i"] == gone["gone"], "left_anti")
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("i").orderBy(F.col("t").asc_nulls_last()))).where("nth = 1")
    return kept.select("r.*").unionAll(rows.where("i is null").select("r.*"))
