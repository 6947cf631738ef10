"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from processgraph.lineage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of edges, root being the least node that it is linked with.

    Null ends, loops and repeated edges change nothing; no edges give no rows. Stars shorten every
    path by half or more, so rounds grow with the logarithm of the longest path, and no row holds a
    list of neighbours. Each round's edges go to the checkpoint folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, seen = cut(e), None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        w = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = w.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u > v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    root = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return root.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
