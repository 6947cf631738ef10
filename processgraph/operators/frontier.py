"""Simple paths by a frontier that moves one hop at a time.

links need src, dst, stindex, ord, arr, wgt and ctx; ids may be of any type. A path carries the nodes
it has passed, its links, and for each hop (channel, place in the channel): ordered by this key, paths
come as a depth-first walk would give them, a path before its extensions. So, if only the first `limit`
paths are wanted, no hop needs more than the first `limit` of its frontier.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from processgraph.lineage import cut

FORWARD, BACKWARD, ALL = (5, 6, 7), (1, 2, 3), (1, 2, 3, 4, 5, 6, 7)


@dataclass
class Limits:
    """What a walk may use: channels, arrows, signed types, contexts (inside the link's, or the link has none), least weight."""

    channels: tuple[int, ...] = FORWARD
    arrows: list[int] = field(default_factory=list)
    sttypes: list[int] = field(default_factory=list)
    contexts: DataFrame | None = None
    context: list[str] = field(default_factory=list)
    min_weight: float | None = None

    def of(self, links: DataFrame) -> DataFrame:
        out = links.where(F.col("stindex").isin(*self.channels))
        if self.arrows:
            out = out.where(F.col("arr").isin(*self.arrows))
        if self.sttypes:
            out = out.where(F.col("stindex").isin(*[4 + s for s in self.sttypes]))
        if self.min_weight is not None:
            out = out.where(F.col("wgt").cast("double") >= self.min_weight)
        if self.context and self.contexts is not None:
            names = F.broadcast(self.contexts.select(F.col("ptr").alias("__ctx"), "context"))
            inside: Column = F.lit(False)
            for x in self.context:
                inside |= F.contains("context", F.lit(x))
            out = out.join(names, F.col("ctx") == F.col("__ctx"), "left").where(F.col("context").isNull() | inside).drop("__ctx", "context")
        return out


def walk(links: DataFrame, starts: DataFrame, depth: int, limits: Limits | None = None, limit: int | None = None, expandable: DataFrame | None = None, stop_at: DataFrame | None = None, cycles_to_root: bool = False) -> DataFrame:
    """All simple paths of 1 to depth links from starts(root): (root, pos, path, links, key, tip, hops, total_weight).

    starts may carry pos, the order of the roots. expandable(node) restricts from which nodes a path goes
    on; paths that reach stop_at(node) don't go on. With cycles_to_root a path may return to its root, and
    ends there. No starts, no links or depth 0 give no paths.
    """
    limits = limits or Limits()
    usable = limits.of(links).select(F.col("src").alias("__src"), F.struct(F.col("stindex"), F.col("ord")).alias("step"), F.struct("arr", "wgt", "ctx", "dst").alias("link"))
    if "pos" not in starts.columns:
        starts = starts.withColumn("pos", F.lit(0).cast("bigint"))
    front = starts.select("root", "pos", F.array("root").alias("path"), F.expr("cast(null as array<int>)").alias("links"), F.col("root").alias("tip"), F.lit(0.0).alias("total_weight"))
    first, found = True, []
    for hop in range(1, depth + 1):
        if expandable is not None:
            front = front.join(expandable.select(F.col("node").alias("tip")), "tip", "left_semi")
        if stop_at is not None and hop > 1:
            front = front.join(stop_at.select(F.col("node").alias("tip")), "tip", "left_anti")
        if cycles_to_root and hop > 1:
            front = front.where(F.col("tip") != F.col("root"))
        fresh = ~F.array_contains("path", F.col("link.dst"))
        if cycles_to_root:
            fresh = ~F.array_contains(F.slice("path", 2, 1 << 20), F.col("link.dst"))
        out = front.join(usable, (F.col("tip") == F.col("__src")) & fresh)
        out = out.select(
            "root", "pos", F.concat("path", F.array("link.dst")).alias("path"),
            (F.array("link") if first else F.concat("links", F.array("link"))).alias("links"),
            (F.array("step") if first else F.concat("key", F.array("step"))).alias("key"),
            F.col("link.dst").alias("tip"), (F.col("total_weight") + F.col("link.wgt").cast("double")).alias("total_weight"),
        )
        first = False
        if limit is not None:
            out = out.orderBy("pos", "key").limit(limit)
        if depth > 2 or limit is not None:
            out = cut(out)
            if out.isEmpty():
                break
        found.append(out.withColumn("hops", F.lit(hop)))
        front = out
    if not found:
        return walk(links, starts.limit(0), 1, limits)
    all_paths = found[0]
    for x in found[1:]:
        all_paths = all_paths.unionByName(x)
    return all_paths if limit is None else all_paths.orderBy("pos", "key").limit(limit)
