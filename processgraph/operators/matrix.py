"""Matrices as rows (r, c, v), and their symbols (r, c, s); absent cells are 0."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symbols(m: DataFrame) -> DataFrame:
    return m.where("v <> 0").select("r", "c", F.concat(F.col("r").cast("string"), F.lit("*"), F.col("c").cast("string")).alias("s"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("r").alias("j"), F.col("c").alias("c2"), F.col("v").alias("w"))
    return a.join(right, a["c"] == right["j"]).groupBy("r", F.col("c2").alias("c")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def symbolic_multiply(a: DataFrame, b: DataFrame, sa: DataFrame, sb: DataFrame) -> DataFrame:
    """(r, c, v, s): the product and, in the order of the inner index, both factors' symbols where both aren't 0."""
    left = a.join(sa, ["r", "c"]).select("r", F.col("c").alias("j"), "v", "s")
    right = b.join(sb, ["r", "c"]).select(F.col("r").alias("j"), "c", F.col("v").alias("w"), F.col("s").alias("t"))
    cells = left.join(right, "j").where("v <> 0 and w <> 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", F.concat("s", "t").alias("x")))), lambda x: x["x"]), "")
    return cells.groupBy("r", "c").agg(F.sum(F.col("v") * F.col("w")).alias("v"), text.alias("s"))


def occupancy(m: DataFrame) -> DataFrame:
    return m.groupBy("r").agg(F.sum("v").cast("bigint").alias("n"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


def symmetrize(m: DataFrame) -> DataFrame:
    """A diagonal counts twice."""
    return m.select("r", "c", "v").unionByName(transpose(m)).groupBy("r", "c").agg(F.sum("v").alias("v"))


def constant(spark, n: int, value: float) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("r"), F.lit(value).alias("x"))


def apply(m: DataFrame, x: DataFrame) -> DataFrame:
    """(r, x) of m times the vector x(r, x)."""
    v = x.select(F.col("r").alias("c"), "x")
    return m.join(v, "c").groupBy("r").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def eigenvector(m: DataFrame, most: int = 10, tol: float = 0.01) -> DataFrame:
    """(r, x): power iteration over rows from ones, largest value 1."""
    from processgraph.lineage import cut

    m = cut(m)
    rows = cut(m.select(F.explode(F.array("r", "c")).alias("r")).distinct())
    x = rows.withColumn("x", F.lit(1.0))
    for _ in range(most):
        y = cut(x.withColumnRenamed("x", "old").join(apply(m, x), "r", "left").select("r", "old", F.coalesce("x", F.lit(0.0)).alias("x")))
        top = y.agg(F.max("x")).first()[0]
        if not top:
            return y.select("r", "x")
        x = cut(y.select("r", "old", (F.col("x") / top).alias("x")))
        if x.agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0] < tol:
            break
        x = x.drop("old")
    return x.select("r", "x")


def climb(start: int, near: dict[int, list[int]], height: dict[int, float]) -> list[int]:
    """The way up from a node; of the higher neighbours not met before, the last one is taken."""
    path, met, at = [start], {start}, start
    while True:
        winner = None
        for k in near.get(at, []):
            if k not in met:
                met.add(k)
                if height[k] > height[at]:
                    winner = k
        if winner is None:
            return path
        at = winner
        path.append(at)


def gradient_tops(m: DataFrame, x: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """(r, top, path): where each node's climb ends. Every worker holds the matrix, whose size is checked."""
    cells = m.where("v <> 0").select("r", "c").orderBy("r", "c").limit(limit + 1).collect()
    if len(cells) > limit:
        raise ValueError(f"more than {limit} cells")
    near: dict[int, list[int]] = {}
    for r, c in cells:
        near.setdefault(r, []).append(c)
    held = m.sparkSession.sparkContext.broadcast((near, {row["r"]: row["x"] for row in x.collect()}))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            paths = [climb(int(r), *held.value) for r in frame["r"]]
            yield pd.DataFrame({"r": frame["r"], "top": np.array([p[-1] for p in paths], dtype="int64"), "path": paths})

    return x.select("r").mapInPandas(run, "r int, top bigint, path array<int>")
