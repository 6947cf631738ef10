"""Adjacency, centralities, cycles, supernodes, types of nodes, and inferred links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from processgraph.lineage import cut

SMALL = 200_000


def adjacency(links: DataFrame, arrows: list[int] = (), nodes: DataFrame | None = None, chapter: str = "", keep_unnamed: bool = True, tasks: int | None = None) -> DataFrame:
    """(src, dst, weight): sums over the links of each pair, of some arrows, from nodes of a chapter. tasks: how many divide the pairs, if that is more than the session says."""
    own = links.where(F.col("arr").isin(*arrows)) if arrows else links
    if chapter and nodes is not None:
        ok = F.contains("chapter", F.lit(chapter)) | ((F.col("chapter") == "") if keep_unnamed else F.lit(False))
        own = own.join(nodes.where(ok).select(F.col("nid").alias("src")), "src", "left_semi")
    return _dealt(own, tasks).groupBy("src", "dst").agg(F.sum(F.col("wgt").cast("double")).alias("weight"))


def _dealt(pairs: DataFrame, tasks: int | None) -> DataFrame:
    return pairs.repartition(tasks, "src", "dst") if tasks else pairs


def members(adj: DataFrame) -> DataFrame:
    return adj.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def sources(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("src").alias("node")).distinct().join(adj.select(F.col("dst").alias("node")), "node", "left_anti")


def sinks(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("dst").alias("node")).distinct().join(adj.select(F.col("src").alias("node")), "node", "left_anti")


def symmetrize(adj: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each pair counts in both directions; a loop at a node counts twice."""
    back = adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return _dealt(adj.select("src", "dst", "weight").unionByName(back), tasks).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def eigenvector(adj: DataFrame, max_iter: int = 100, tol: float = 1e-6, limit: int = SMALL) -> DataFrame:
    """(node, evc): power iteration from ones, largest value 1. A vector of zeros starts again at 1 / n.

    Nodes without incoming pairs, or with only one from the same node and of the same weight, have the same value
    in every step, so they are one in the iteration. Up to `limit` pairs that this leaves are iterated at the driver.
    """
    adj = cut(adj)
    n = F.coalesce("n", F.lit(0))
    into = adj.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min(F.struct("src", "weight")).alias("x"))
    like = F.struct(F.least(n, F.lit(2)).alias("n"), F.when(n == 1, F.col("x.src")).when(n > 1, F.col("node")).alias("a"), F.when(n == 1, F.col("x.weight")).otherwise(0.0).alias("w"))
    nodes = cut(members(adj).join(into, "node", "left").select("node", like.alias("like")))
    number = nodes.count()
    if not number:
        return nodes.select("node", F.lit(0.0).alias("evc"))
    several = adj.join(nodes.where("like.n = 2").select(F.col("node").alias("dst"), "like"), "dst").select("src", "weight", "like")
    single = nodes.where("like.n = 1").select("like").distinct().select(F.col("like.a").alias("src"), F.col("like.w").alias("weight"), "like")
    step = several.unionByName(single).join(nodes.select(F.col("node").alias("src"), F.col("like").alias("of")).hint("merge"), "src").groupBy("of", "like").agg(F.sum("weight").alias("weight"))
    step = cut(step)
    held = step.limit(limit + 1).collect()
    start = nodes.select("like").distinct()
    v = _power_held(start, held, number, max_iter, tol) if len(held) <= limit else _power(step, start, number, max_iter, tol)
    return nodes.join(v, "like").select("node", "evc")


def _power_held(start: DataFrame, pairs: list, number: int, max_iter: int, tol: float) -> DataFrame:
    names = [r["like"] for r in start.collect()]  # one more than the pairs at most
    index = {x: k for k, x in enumerate(names)}
    a, b = (np.array([index[p[c]] for p in pairs], np.int64) for c in ("of", "like"))
    weight, v = np.array([p["weight"] for p in pairs], float), np.ones(len(names))
    for _ in range(max_iter):
        moved, old = np.bincount(b, weight * v[a], len(names)), v
        v = moved / moved.max() if moved.max() > 0 else np.full(len(names), 1.0 / number)
        if np.abs(v - old).max() < tol:
            break
    return F.broadcast(start.sparkSession.createDataFrame([(x, float(y)) for x, y in zip(names, v)], start.withColumn("evc", F.lit(0.0)).schema))


def _power(step: DataFrame, start: DataFrame, number: int, max_iter: int, tol: float) -> DataFrame:
    """By joins that never go through the driver."""
    v = start.withColumn("evc", F.lit(1.0))
    for k in range(max_iter):
        moved = step.hint("merge").join(v.select(F.col("like").alias("of"), "evc"), "of").groupBy("like").agg(F.sum(F.col("weight") * F.col("evc")).alias("next"))
        new = cut(v.hint("merge").join(moved, "like", "left").select("like", F.col("evc").alias("old"), F.coalesce("next", F.lit(0.0)).alias("next")))
        top = new.agg(F.max("next")).first()[0]
        scaled = F.col("next") / F.lit(top) if top > 0 else F.lit(1.0 / number)
        v = new.select("like", "old", scaled.alias("evc"))
        if v.agg(F.max(F.abs(F.col("evc") - F.col("old")))).first()[0] < tol:
            break
        v = cut(v.drop("old")) if k % 5 == 4 else v.drop("old")
    return v.select("like", "evc")


def eigenvector_steps(adj: DataFrame, steps: int) -> DataFrame:
    """A fixed number of iterations as one plan; rows of nodes without incoming weight are 0."""
    nodes = members(adj)
    v = nodes.withColumn("evc", F.lit(1.0))
    for _ in range(steps):
        moved = adj.join(v.select(F.col("node").alias("src"), "evc"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("evc")).alias("next"))
        top = F.broadcast(moved.agg(F.max("next").alias("top")))
        v = nodes.join(moved, "node", "left").crossJoin(top).select("node", F.coalesce(F.col("next") / F.col("top"), F.lit(0.0)).alias("evc"))
    return v


def summary(adj: DataFrame, top: int = 5) -> dict:
    """Numbers of nodes, distinct directed pairs, sources and sinks, and the nodes of largest centrality."""
    best = eigenvector(adj).orderBy(F.desc("evc"), "node").limit(top).collect()
    return {"nodes": members(adj).count(), "links": adj.count(), "sources": sources(adj).count(), "sinks": sinks(adj).count(), "top": [(r["node"], r["evc"]) for r in best]}


def betweenness(adj: DataFrame, limit: int = SMALL) -> DataFrame:
    """(node, betweenness) of shortest paths without weights, directed, not normalised.

    A node that one link leads to and none leaves is nobody's way on, so it is only counted where it hangs. Of what is
    left, up to `limit` pairs are held by every task, which divide the sources; more are walked by joins, a level at
    a time for all sources, and what that keeps on disk are the pairs of nodes that reach each other.
    """
    adj = cut(adj.select("src", "dst"))
    pairs = adj.where("src <> dst")
    sides = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(None).cast(adj.schema["src"].dataType).alias("by")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), F.col("src").alias("by"))))
    leaf = pairs.select(sides.alias("x")).select("x.*").groupBy("node").agg(F.max("out").alias("out"), F.count("by").alias("n"), F.min("by").alias("by")).where("out = 0 and n = 1")
    leaf = cut(leaf.select("node", "by"))
    core = cut(pairs.join(leaf.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    hung = leaf.groupBy(F.col("by").alias("node")).agg(F.count("*").cast("double").alias("hung")).join(members(core), "node", "left_semi")
    held = core.limit(limit + 1).collect()
    found = _through_held(core, held, hung) if len(held) <= limit else _through_levels(core, cut(hung))
    return members(adj).join(found, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _through_held(core: DataFrame, pairs: list, hung: DataFrame) -> DataFrame:
    names = sorted({x for p in pairs for x in p})
    index = {x: k for k, x in enumerate(names)}
    out: list[list[int]] = [[] for _ in names]
    for s, d in sorted(pairs):
        out[index[s]].append(index[d])
    more = [0.0] * len(names)
    for r in hung.collect():
        more[index[r["node"]]] = r["hung"]
    held = core.sparkSession.sparkContext.broadcast((out, more))

    def brandes(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, hang = held.value
        n = len(links)
        score = np.zeros(n)
        for frame in frames:
            for s in frame["id"]:
                dist, sigma, before, order = [-1] * n, [0.0] * n, [[] for _ in range(n)], [s]
                dist[s], sigma[s] = 0, 1.0
                for v in order:
                    for w in links[v]:
                        if dist[w] < 0:
                            dist[w] = dist[v] + 1
                            order.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] += sigma[v]
                            before[w].append(v)
                delta = hang[:]
                for w in reversed(order):
                    for v in before[w]:
                        delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                    if w != s:
                        score[w] += delta[w]
        yield pd.DataFrame({"k": np.arange(n), "b": score})

    parts = core.sparkSession.range(len(names)).mapInPandas(brandes, "k bigint, b double").groupBy("k").agg(F.sum("b").alias("betweenness"))
    labels = core.sparkSession.createDataFrame([(k, x) for k, x in enumerate(names)], f"k bigint, node {core.schema['src'].dataType.simpleString()}")
    return labels.join(parts, "k").select("node", "betweenness")


def _through_levels(core: DataFrame, hung: DataFrame) -> DataFrame:
    link = core.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    levels = [cut(core.select(F.col("src").alias("s")).distinct().select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma")))]
    seen = levels[0].select("s", "v")
    while True:
        step = levels[-1].join(link, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("sigma").alias("sigma"))
        nxt = cut(step.join(seen, ["s", "v"], "left_anti"))
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select("s", "v"))
    own = lambda level: level.join(hung.withColumnRenamed("node", "v"), "v", "left").withColumn("delta", F.coalesce("hung", F.lit(0.0))).drop("hung")
    found, later = None, None
    for level in reversed(levels[1:]):
        now = own(level)
        if later is not None:
            to = later.select("s", F.col("v").alias("w"), F.col("sigma").alias("ways"), F.col("delta").alias("far"))
            add = level.join(link, "v").join(to, ["s", "w"]).groupBy("s", "v").agg(F.sum(F.col("sigma") / F.col("ways") * (1 + F.col("far"))).alias("add"))
            now = now.join(add, ["s", "v"], "left").withColumn("delta", F.col("delta") + F.coalesce("add", F.lit(0.0))).drop("add")
        later = cut(now)
        part = later.groupBy(F.col("v").alias("node")).agg(F.sum("delta").alias("betweenness"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return core.select(F.col("src").alias("node"), F.lit(0.0).alias("betweenness")).limit(0)
    return found.groupBy("node").agg(F.sum("betweenness").alias("betweenness"))


def tally(paths: DataFrame) -> DataFrame:
    """How often each node is reached by the links of paths."""
    return paths.select(F.explode("links.dst").alias("node")).groupBy("node").agg(F.count("*").alias("n"))


def cycles(adj: DataFrame, max_length: int = 6) -> DataFrame:
    """All simple cycles of up to max_length pairs, each once, its least node first. Loops at a node are cycles of one."""
    step = cut(adj.select(F.col("src").alias("tip"), "dst"))
    front = step.where("tip <= dst").select(F.array("tip").alias("cycle"), "dst")
    found = front.where(F.element_at("cycle", 1) == F.col("dst")).select("cycle")
    front = front.where(F.element_at("cycle", 1) < F.col("dst"))
    for _ in range(max_length - 1):
        path = front.select(F.concat("cycle", F.array("dst")).alias("cycle"), F.col("dst").alias("tip"))
        nxt = cut(path.join(step, "tip").where(F.col("dst") >= F.element_at("cycle", 1)))
        found = found.unionByName(nxt.where(F.col("dst") == F.element_at("cycle", 1)).select("cycle"))
        front = nxt.where(~F.array_contains("cycle", F.col("dst"))).select("cycle", "dst")
        if front.isEmpty():
            break
    return found


def canonical(cycle):
    """A cycle turned so that its least node comes first."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, 1, at - 1))


def co_depth_groups(paths: DataFrame, max_depth: int) -> DataFrame:
    """(node, grp): nodes that share a depth in some paths are one group, and groups that share a node are one."""
    at = cut(paths.select(F.posexplode(F.slice("links.dst", 1, max_depth)).alias("depth", "node")).distinct())
    label = cut(at.select("node").distinct().withColumn("grp", F.col("node")))
    while True:
        deep = at.join(label, "node").groupBy("depth").agg(F.min("grp").alias("g"))
        new = cut(at.join(deep, "depth").groupBy("node").agg(F.min("g").alias("grp")))
        if new.join(label.withColumnRenamed("grp", "old"), "node").where("grp <> old").isEmpty():
            return new
        label = new


def transverse_supernodes(paths: DataFrame) -> DataFrame:
    """Nodes in more than one path, grouped by the set of paths they lie on. paths have path_id."""
    on = paths.select("path_id", F.explode("links.dst").alias("node")).distinct().groupBy("node").agg(F.array_sort(F.collect_list("path_id")).alias("paths"))
    return on.where(F.size("paths") > 1).groupBy("paths").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


# Types of nodes


def infer_types(links: DataFrame, quiet_arrows: list[int] = ()) -> DataFrame:
    """(node, e, t, c): event, thing or concept; the last channel that isn't empty decides.

    Channels of order make an event (unless all their arrows are quiet ones), containment a thing, an
    expressed property a thing and a concept, an expressing one a thing.
    """
    loud = ~F.col("arr").isin(*quiet_arrows) if quiet_arrows else F.lit(True)
    own = F.struct("stindex", ((F.abs(F.col("stindex") - 4) != 1) | loud).alias("loud"))
    last = links.groupBy(F.col("src").alias("node")).agg(F.max(own).alias("l")).select("node", F.when(F.col("l.loud"), F.col("l.stindex")).otherwise(4).alias("st"))
    return last.select("node", F.col("st").isin(3, 5).alias("e"), F.col("st").isin(1, 2, 6, 7).alias("t"), (F.col("st") == 7).alias("c"))


def type_warnings(types: DataFrame, links: DataFrame) -> DataFrame:
    """(node, warnings) of nodes whose type and channels disagree."""
    has = lambda *st: F.max(F.col("stindex").isin(*st))
    own = links.groupBy(F.col("src").alias("node")).agg(has(3, 5).alias("order"), has(2, 6).alias("contain"), has(1, 7).alias("express"), F.lit(True).alias("linked"))
    j = types.join(own, "node", "left")
    order, contain, express = (F.coalesce(x, F.lit(False)) for x in ("order", "contain", "express"))
    w = F.array_compact(F.array(
        F.when(F.col("t") & ~F.col("e") & order & ~contain & ~express, "a thing that has links of order only"),
        F.when(F.col("e") & ~order, "an event without links of order"),
        F.when(F.col("c") & contain & ~express, "a concept that contains or is contained"),
        F.when((F.col("e") | F.col("t") | F.col("c")) & F.col("linked").isNull(), "a type but no links"),
    ))
    return j.select("node", w.alias("warnings")).where(F.size("warnings") > 0)


def singletons(links: DataFrame, sttypes: list[int]) -> DataFrame:
    """(node, role): sources have links forward of the types and none backward, sinks the other way round."""
    f, b = [4 + abs(s) for s in sttypes], [4 - abs(s) for s in sttypes]
    own = links.groupBy(F.col("src").alias("node")).agg(F.max(F.col("stindex").isin(*f)).alias("f"), F.max(F.col("stindex").isin(*b)).alias("b"))
    return own.where("f <> b").select("node", F.when(F.col("f"), "source").otherwise("sink").alias("role"))


# Inferred links


def closures(links: DataFrame, rules: DataFrame) -> DataFrame:
    """One pass of rules(first, second, result, stindex): links a to c where a first leads to b and a second from b to c.

    Weights multiply, the first link's context stays, no link leads from a node to itself.
    """
    one = links.select(F.col("src").alias("a"), F.col("arr").alias("first"), F.col("wgt").alias("w1"), "ctx", F.col("dst").alias("b"), "ord")
    two = links.select(F.col("src").alias("b"), F.col("arr").alias("second"), F.col("wgt").alias("w2"), F.col("dst").alias("c"))
    hit = one.join(F.broadcast(rules), "first").join(two, ["b", "second"]).where("a <> c")
    return hit.select(F.col("a").alias("src"), "stindex", "ord", F.col("result").alias("arr"), (F.col("w1") * F.col("w2")).cast("float").alias("wgt"), "ctx", F.col("c").alias("dst")).groupBy("src", "stindex", "arr", "wgt", "ctx", "dst").agg(F.min("ord").alias("ord"))


def closeness(links: DataFrame, blocks: int = 8) -> DataFrame:
    """Neighbours by one similarity arrow of one node are near each other: weight 1, no context.

    All pairs of a node's neighbours, in `blocks` tasks a node. Only pairs of which both ends have several such nodes
    may be found more than once; only these are compared.
    """
    near = cut(links.where("stindex = 4").select("src", "arr", "dst").distinct())
    several = near.groupBy("arr", "dst").agg((F.count("*") > 1).alias("several")).where("several")
    near = cut(near.join(several, ["arr", "dst"], "left").select("src", "arr", "dst", F.col("several").isNotNull().alias("several")))
    one = near.withColumn("block", F.pmod(F.hash("dst"), F.lit(blocks)))
    two = near.select("src", "arr", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("dst").alias("d2"), F.col("several").alias("s2"))
    pairs = one.hint("merge").join(two, ["src", "arr", "block"]).where("dst <> d2")
    names = ["arr", "dst", "d2"]
    out = pairs.where("not (several and s2)").select(*names)
    if not several.isEmpty():
        out = out.unionByName(pairs.where("several and s2").select(*names).distinct())
    return out.select(F.col("dst").alias("src"), F.lit(4).cast("tinyint").alias("stindex"), "arr", F.lit(1.0).cast("float").alias("wgt"), F.lit(0).alias("ctx"), F.col("d2").alias("dst"))


def caps_variants(nodes: DataFrame) -> DataFrame:
    """(a, b): texts of classes 1 to 4 that differ in case only, both ways round."""
    own = nodes.where("class <= 4").select("nid", "text", "class", F.lower("text").alias("low"))
    l, r = own.alias("l"), own.alias("r")  # noqa: E741
    hit = l.join(r, (F.col("l.low") == F.col("r.low")) & (F.col("l.class") == F.col("r.class")) & (F.length("l.text") == F.length("r.text")) & (F.col("l.text") != F.col("r.text")))
    return hit.select(F.col("l.nid").alias("a"), F.col("r.nid").alias("b"))


# Orbits, appointments and hierarchies


def orbit(paths: DataFrame, nodes: DataFrame, radius: int = 3, exclude: str = "", limit: int = 100) -> DataFrame:
    """(stindex, text, radius, dst): what lies around the root of a cone, by channel; of equal texts the first met stays."""
    at = paths.select("pos", "key", F.posexplode(F.arrays_zip(F.slice("links", 1, radius).alias("link"), F.slice("key", 1, radius).alias("step"))).alias("i", "x"))
    at = at.select("pos", "key", (F.col("i") + 1).alias("radius"), F.col("x.link.dst").alias("dst"), F.col("x.link.arr").alias("arr"), F.col("x.step.stindex").alias("stindex"))
    named = at.join(nodes.select(F.col("nid").alias("dst"), "text"), "dst").where(F.col("text") != exclude)
    first = Window.partitionBy("stindex", "text").orderBy("pos", "key", "radius")
    one = named.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    place = F.row_number().over(Window.partitionBy("stindex").orderBy("pos", "key", "radius"))
    return one.withColumn("place", place).where(F.col("place") <= limit).select("stindex", "text", "radius", "dst", "arr", "place")


def appointed_by_arrow(links: DataFrame, arrow: int, inverse: dict[int, int], size: int = 100) -> DataFrame:
    """(node, arr, n, members): for each node what the inverse of an arrow leads to, at most `size` in link order."""
    own = links.where(F.col("arr") == inverse.get(arrow, arrow))
    nth = F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst"))
    kept = own.withColumn("nth", nth).where(F.col("nth") <= size)
    return kept.groupBy(F.col("src").alias("node"), "arr").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "dst"))), lambda x: x["dst"]).alias("members"))


def appointed_by_sttype(links: DataFrame, sttype: int, size: int = 100) -> DataFrame:
    own = links.where(F.col("stindex") == 4 + sttype)
    nth = F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst"))
    kept = own.withColumn("nth", nth).where(F.col("nth") <= size)
    return kept.groupBy(F.col("src").alias("node"), "arr").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "dst"))), lambda x: x["dst"]).alias("members"))


def hierarchy_roots(links: DataFrame) -> DataFrame:
    own = links.groupBy(F.col("src").alias("node")).agg(F.max(F.col("stindex") == 6).alias("down"), F.max(F.col("stindex") == 2).alias("up"))
    return own.where("down and not up").select("node")


def children(links: DataFrame, node) -> DataFrame:
    return links.where((F.col("src") == F.lit(node)) & (F.col("stindex") == 6)).orderBy("ord").select("dst", "ord")


def parent(links: DataFrame) -> DataFrame:
    """(node, parent): the first container of each node."""
    return links.where("stindex = 2").groupBy(F.col("src").alias("node")).agg(F.min_by("dst", "ord").alias("parent"))
