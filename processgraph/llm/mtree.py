"""Exact nearest neighbours by best-first search in M-trees.

Vectors are divided among cells by their nearest pivot, and a cell among parts of about PART vectors by a
hash, so that no tree grows with the table or with a crowd of like vectors. Each part holds an M-tree. A
node is a page of entries, each with a routing vector, a covering radius and the distance to the routing
vector of the page above (a leaf's entries have radius 0). A search takes pages from a queue in the order of
the least distance that anything in them can have, and leaves out entries without computing their distance
where the stored distances already say, by the triangle inequality, that they are too far. Queries that are
near one another go through the tree together, each with its own bounds: where most of a page is needed the
distances are one product of matrices, else only those that are needed are computed. What may be among the
nearest is then measured exactly.

A query is searched in one part of its own cell first; the distance of its k-th neighbour there then says
which cells can hold a nearer one, and their other parts are searched, in blocks of BLOCK queries. Pivots are
a sample of at most PIVOTS vectors, a bound on what workers get; every vector is indexed and the result is exact.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from processgraph.lineage import cut

K, CELL, PART, PIVOTS, BLOCK, PAGE, EPS = 10, 8192, 16384, 1024, 4096, 128, 1e-6


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt((d * d).sum(-1))


class Tree:
    """pages: each (inner?, rows or child pages, routing vectors, radii, distances to the routing vector above)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE):
        self.ids, self.page = ids, page
        self.pages: list[tuple] = []
        self.root = self._build(x, np.arange(len(ids)), None) if len(ids) else -1

    def _build(self, x: np.ndarray, rows: np.ndarray, above: np.ndarray | None) -> int:
        if len(rows) <= self.page:
            own = x[rows]
            to = distances(own, above) if above is not None else np.zeros(len(rows))
            self.pages.append((False, rows, own, np.zeros(len(rows)), to))
            return len(self.pages) - 1
        n = min(self.page, max(2, -(-len(rows) // self.page)))
        far = distances(x[rows], x[rows[0]])
        seeds = [int(far.argmax())]
        near = distances(x[rows], x[rows[seeds[0]]])
        side = np.zeros(len(rows), np.int64)
        for k in range(1, n):
            seed = int(near.argmax())
            if near[seed] == 0:
                break
            seeds.append(seed)
            d = distances(x[rows], x[rows[seed]])
            closer = d < near
            side[closer], near = k, np.where(closer, d, near)
        if len(seeds) == 1:
            side = np.arange(len(rows)) % n
            seeds = list(range(n))
        routing = x[rows[seeds]]
        children, radii = [], []
        for k in range(len(seeds)):
            own = rows[side == k]
            radii.append(float(distances(x[own], routing[k]).max(initial=0)))
            children.append(self._build(x, own, routing[k]))
        to = distances(routing, above) if above is not None else np.zeros(len(seeds))
        self.pages.append((True, np.array(children), routing, np.array(radii), to))
        return len(self.pages) - 1

    def leaves(self) -> Iterator[np.ndarray]:
        """The rows of each leaf."""
        for page in self.pages:
            if not page[0] and len(page[1]):
                yield page[1]

    def nearest_leaf(self, q: np.ndarray) -> np.ndarray:
        """The leaf page that each query comes to by the nearest routing vectors; it is where to look first, not what to look at only."""
        at = np.full(len(q), self.root)
        while len(inner := np.unique([p for p in np.unique(at) if self.pages[p][0]])):
            for p in inner:
                own = np.flatnonzero(at == p)
                x = self.pages[p][2]
                at[own] = self.pages[p][1][((x * x).sum(1) - 2 * q[own] @ x.T).argmin(1)]
        return at

    def search(self, q: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each query the distances and ids of its k nearest that aren't `own` and not farther than its bound, and how many distances were computed.

        Where there are fewer, the distance is infinite.
        """
        best, who = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        limit, square, computed, pushed = bound.astype(float) + EPS, (q * q).sum(1), 0, 0
        queue: list[tuple] = [(0.0, 0, self.root, None)] if self.root >= 0 else []
        while queue:
            least, _, page, above = heapq.heappop(queue)
            if least > limit.max():
                break
            inner, what, vectors, radii, to = self.pages[page]
            rows, cols = np.arange(len(q)), np.arange(len(to))
            if above is not None:
                need = np.abs(above[:, None] - to) - radii <= limit[:, None]
                rows, cols = np.flatnonzero(need.any(1)), np.flatnonzero(need.any(0))
                if not len(cols):
                    continue
            x = vectors[cols]
            need = np.ones((len(rows), len(cols)), bool) if above is None else need[np.ix_(rows, cols)]
            if need.mean() > 0.25:
                d = np.sqrt(np.maximum(square[rows, None] + (x * x).sum(1) - 2 * q[rows] @ x.T, 0))
                computed += d.size
            else:
                d = np.full(need.shape, np.inf)
                r, c = np.nonzero(need)
                d[r, c] = distances(x[c], q[rows[r]])
                computed += len(r)
            ok = need & (d - radii[cols] <= limit[rows, None] + EPS)
            if inner:
                for j in np.flatnonzero(ok.any(0)):
                    down = np.full(len(q), np.inf)
                    down[rows[ok[:, j]]] = d[ok[:, j], j]
                    pushed += 1
                    heapq.heappush(queue, (max(0.0, float(d[ok[:, j], j].min() - radii[cols[j]] - EPS)), pushed, int(what[cols[j]]), down))
            elif ok.any():
                hit = ok.any(1)
                ok, rows, name = ok[hit], rows[hit], self.ids[what[cols]]
                exact = np.full(ok.shape, np.inf)
                r, c = np.nonzero(ok)
                exact[r, c] = distances(x[c], q[rows[r]])
                exact[name[None, :] == own[rows, None]] = np.inf
                exact[exact > bound[rows, None] + EPS] = np.inf
                ds, names = np.concatenate([best[rows], exact], 1), np.concatenate([who[rows], np.broadcast_to(name, exact.shape)], 1)
                rank = np.lexsort((names, ds))[:, :k]
                best[rows], who[rows] = np.take_along_axis(ds, rank, 1), np.take_along_axis(names, rank, 1)
                limit = np.minimum(limit, best[:, -1] + EPS)
        return best, who, computed


def _vectors(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), float)


def _together(tree: Tree, x: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of x in slices of PAGE, those of one leaf one after the other."""
    order = np.argsort(tree.nearest_leaf(x), kind="stable")
    for s in range(0, len(order), PAGE):
        yield order[s : s + PAGE]


def neighbours(table: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 1, cell: int = CELL, part: int = PART) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest of all other vectors, by Euclidean distance and then by id.

    Queries are the rows whose id is divisible by `every`. With fewer than k others, all are given. A row whose id
    isn't an integer or null, whose vector is null, has a null or NaN inside, or another length than most vectors have,
    is neither query nor neighbour. Rows that repeat an id count once, with the least vector; equal vectors of different
    ids are neighbours at distance 0. No rows give no rows; other columns are not read.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).try_cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x))")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, rank long, neighbor_id long, distance double")
    rows, n = rows.where(F.size("v") == sizes["d"]), sizes["count"]
    count = min(PIVOTS, max(1, -(-n // cell)))
    pivots = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(count).collect()], float)
    held = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                own = np.concatenate([((held.value**2).sum(1) - 2 * x[s : s + 512] @ held.value.T).argmin(1) for s in range(0, len(x), 512)])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns], ["cell", "id", "v"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x, c = _vectors(rows["v"]), int(rows["cell"].iloc[0])
        tree = Tree(rows["id"].to_numpy(), x)
        return pd.DataFrame({"cell": [c], "part": [int(rows["part"].iloc[0])], "radius": [float(distances(x, held.value[c]).max())], "tree": [pickle.dumps(tree)]})

    placed = cut(rows.mapInArrow(assign, "cell long, id long, v array<double>"))
    parts = np.ones(count, np.int64)
    for r in placed.groupBy("cell").count().collect():
        parts[r["cell"]] = -(-r["count"] // part)
    divided = F.element_at(F.lit([int(x) for x in parts]).cast("array<long>"), F.col("cell").cast("int") + 1)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), divided))
    trees = cut(placed.groupBy("cell", "part").applyInPandas(build, "cell long, part long, radius double, tree binary"))
    reach = np.full(count, -np.inf)
    for r in trees.groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        reach[r["cell"]] = r["radius"]
    radii = spark.sparkContext.broadcast(reach)
    trees = trees.select("cell", "part", "tree")
    asked = placed.where(F.col("id") % every == 0)

    def blocks(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries, and the trees of their cells' parts, both by cell, part and block."""
        n_blocks = [0] * count
        for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect():
            n_blocks[r["cell"]] = -(-r["n"] // BLOCK)
        own = F.element_at(F.lit(n_blocks).cast("array<long>"), F.col("cell").cast("int") + 1)
        return queries.withColumn("block", F.pmod(F.xxhash64("id"), own)), trees.where(own > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), own - 1)))

    def near(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(own):
            tree, c, p = pickle.loads(own["tree"].iloc[0]), int(own["cell"].iloc[0]), int(own["part"].iloc[0])
            x, names = _vectors(rows["v"]), rows["id"].to_numpy()
            for at in _together(tree, x):
                best, who, _ = tree.search(x[at], names[at], k, np.full(len(at), np.inf))
                for r, d, i in zip(at, best, who):
                    cells = np.flatnonzero(distances(held.value, x[r]) - radii.value <= d[-1] + EPS)
                    out.append((names[r], x[r], d[-1], cells, c, p, d[np.isfinite(d)], i[np.isfinite(d)]))
        return pd.DataFrame(out, columns=["id", "v", "bound", "cells", "own", "done", "ds", "ids"])

    def more(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(own):
            tree = pickle.loads(own["tree"].iloc[0])
            x, names, bound = _vectors(rows["v"]), rows["id"].to_numpy(), rows["bound"].to_numpy()
            for at in _together(tree, x):
                best, who, _ = tree.search(x[at], names[at], k, bound[at])
                out += [(names[r], d[np.isfinite(d)], i[np.isfinite(d)]) for r, d, i in zip(at, best, who) if np.isfinite(d[0])]
        return pd.DataFrame(out, columns=["id", "ds", "ids"])

    key = ["cell", "part", "block"]
    asked, own = blocks(asked)
    first = asked.groupBy(*key).cogroup(own.groupBy(*key)).applyInPandas(near, "id long, v array<double>, bound double, cells array<long>, own long, done long, ds array<double>, ids array<long>")
    first = cut(first)
    again, own = blocks(first.select("id", "v", "bound", "own", "done", F.explode("cells").alias("cell")))
    again = again.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), divided - 1))).where("cell <> own or part <> done")
    second = again.groupBy(*key).cogroup(own.groupBy(*key)).applyInPandas(more, "id long, ds array<double>, ids array<long>")
    pairs = first.select("id", "ds", "ids").unionAll(second).select("id", F.explode(F.arrays_zip("ds", "ids")).alias("p"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("p.ds", "p.ids")).cast("long")
    ranked = pairs.select(F.col("id").alias("vec_id"), rank.alias("rank"), F.col("p.ids").alias("neighbor_id"), F.round("p.ds", 6).alias("distance"))
    return ranked.where(F.col("rank") <= k)
