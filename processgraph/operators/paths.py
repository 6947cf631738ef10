"""Cones, path solving, weighted search and walks along one arrow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from processgraph.lineage import cut
from processgraph.operators.frontier import ALL, BACKWARD, FORWARD, Limits, walk

CONE_LIMIT = 100


def _roots(links: DataFrame, *nodes) -> DataFrame:
    kind = links.schema["src"].dataType.simpleString()
    return links.sparkSession.createDataFrame([(n, k) for k, n in enumerate(nodes)], f"root {kind}, pos bigint")


def _set(links: DataFrame, *nodes) -> DataFrame:
    return _roots(links, *nodes).select(F.col("root").alias("node"))


def forward_cone(links: DataFrame, start, depth: int = 5, limit: int | None = CONE_LIMIT, sttype: int = 0) -> DataFrame:
    """Paths forward from a node, by all types or one, the first `limit` of a depth-first walk."""
    return walk(links, _roots(links, start), depth, Limits(channels=(4 + sttype,) if sttype else FORWARD), limit)


def backward_cone(links: DataFrame, start, depth: int = 5, limit: int | None = CONE_LIMIT) -> DataFrame:
    return walk(links, _roots(links, start), depth, Limits(channels=BACKWARD), limit)


def cone(links: DataFrame, orientation: str, start, depth: int = 5, limit: int = CONE_LIMIT) -> DataFrame:
    """Forward, backward, or both: then forward paths first and backward ones up to what is left of the limit."""
    if orientation in ("fwd", "forward"):
        return forward_cone(links, start, depth, limit)
    if orientation in ("bwd", "backward"):
        return backward_cone(links, start, depth, limit)
    both = forward_cone(links, start, depth, limit).withColumn("pos", F.lit(0)).unionByName(backward_cone(links, start, depth, limit).withColumn("pos", F.lit(1)))
    return both.orderBy("pos", "key").limit(limit)


def supernodes(paths: DataFrame) -> DataFrame:
    """Nodes that more than one link of all returned paths leads to; a prefix of a path counts as a path."""
    return paths.select(F.explode("links.dst").alias("node")).groupBy("node").agg(F.count("*").alias("n")).where("n > 1")


def constrained_cone(links: DataFrame, starts: list, depth: int, nodes: DataFrame | None = None, chapter: str = "", contexts: DataFrame | None = None, context: list[str] = (), arrows: list[int] = (), sttypes: list[int] = (), limit: int = CONE_LIMIT, forward: bool = True) -> DataFrame:
    """Cones from several starts in their order. Paths go on only from nodes whose chapter is empty or has the term inside."""
    inside = None
    if chapter and nodes is not None:
        inside = nodes.where((F.col("chapter") == "") | F.contains("chapter", F.lit(chapter))).select(F.col("nid").alias("node"))
    limits = Limits(FORWARD if forward else BACKWARD, list(arrows), list(sttypes), contexts, list(context))
    return walk(links, _roots(links, *starts), depth, limits, limit, inside)


def one_hop(links: DataFrame, starts: list, contexts: DataFrame | None = None, context: list[str] = (), arrows: list[int] = (), sttypes: list[int] = (), limit: int = CONE_LIMIT) -> DataFrame:
    """The first links forward from starts under the same limits."""
    return walk(links, _roots(links, *starts), 1, Limits(FORWARD, list(arrows), list(sttypes), contexts, list(context)), limit)


def extend_cone(links: DataFrame, paths: DataFrame, arrows: list[int] = (), sttypes: list[int] = (), max_depth: int = 10) -> DataFrame:
    """Every path and all its extensions by one link of any channel, cycles included, up to max_depth links."""
    step = Limits(ALL, list(arrows), list(sttypes)).of(links).select(F.col("src").alias("tip"), F.struct("arr", "wgt", "ctx", "dst").alias("link"))
    more = paths.where(F.size("links") < max_depth).select("tip", "links").join(step, "tip").select(F.concat("links", F.array("link")).alias("links"))
    return paths.select("links").unionByName(more)


def find_paths(links: DataFrame, begin, end, max_depth: int = 10) -> DataFrame:
    """(path, is_loop): all simple forward paths that end at `end` and don't pass it; from a node to itself they are loops."""
    loop = begin == end
    found = walk(links, _roots(links, begin), max_depth, stop_at=None if loop else _set(links, end), cycles_to_root=loop)
    return found.where(F.col("tip") == F.lit(end)).orderBy("key").select("path", F.lit(loop).alias("is_loop"), "links", "key")


def path_loops(paths: DataFrame) -> DataFrame:
    """(path_id, loop): for each node that comes again, the stretch from its first place to each later one. paths have path_id and path."""
    at = paths.select("path_id", "path", F.posexplode("path").alias("i", "node"))
    first = at.groupBy("path_id", "node").agg(F.min("i").alias("first"))
    again = at.join(first, ["path_id", "node"]).where("i > first")
    return again.select("path_id", F.slice("path", F.col("first") + 1, F.col("i") - F.col("first") + 1).alias("loop"), "i")


def is_dag(links: Column) -> Column:
    """No node is reached twice."""
    return F.size(F.array_distinct(links["dst"])) == F.size(links)


def wave_front(paths: DataFrame) -> DataFrame:
    """The last node of each path."""
    return paths.select(F.element_at("path", -1).alias("tip"))


def adjoint_path(links: Column, inverse: dict[int, int]) -> Column:
    """A path in reverse with inverse arrows; each link keeps its own destination."""
    back = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv]) if inverse else F.create_map().cast("map<int,int>")
    return F.reverse(F.transform(links, lambda x: x.withField("arr", F.coalesce(back[x["arr"]], F.lit(0)))))


def adjoint_sttypes(types: list[int]) -> list[int]:
    return [-t for t in reversed(types)]


def complement_join(left: Column, right: Column) -> Column:
    """left followed by right without its first link."""
    return F.concat(left, F.when(F.size(right) > 1, F.slice(right, 2, F.size(right))).otherwise(F.slice(right, 1, 0)))


def truncate_by_arrow(links: Column, arrow: int) -> Column:
    """The longest start of a path that uses one arrow only."""
    other = F.array_position(F.transform(links, lambda x: x["arr"] != arrow), True)
    return F.when(other == 0, links).otherwise(F.slice(links, 1, F.greatest(other - 1, F.lit(0)).cast("int")))


def nodes_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left place, right places) of equal nodes in two tables (pos, node)."""
    pairs = left.select(F.col("pos").alias("l"), "node").join(right.select(F.col("pos").alias("r"), "node"), "node")
    return pairs.groupBy("l").agg(F.array_sort(F.collect_list("r")).alias("rs"))


def splice(left: DataFrame, right: DataFrame, inverse: dict[int, int], compat: bool = False) -> DataFrame:
    """Paths of two wave fronts that meet, with is_loop.

    By default the spliced nodes run from the left root to the right root, each once where two
    splices agree. compat leaves the right root out and keeps repeats, as links without their end.
    """
    l = left.select(F.col("tip"), F.col("path").alias("lpath"), F.col("links").alias("llinks"))  # noqa: E741
    r = right.select(F.col("tip"), F.col("path").alias("rpath"), F.col("links").alias("rlinks"))
    met = l.join(r, "tip")
    if compat:
        out = met.select(complement_join(F.col("llinks"), adjoint_path(F.col("rlinks"), inverse)).alias("links"))
        return out.select("links", (~is_dag(F.col("links"))).alias("is_loop"))
    nodes = F.concat("lpath", F.slice(F.reverse("rpath"), 2, F.size("rpath")))
    out = met.select(nodes.alias("path")).distinct()
    return out.select("path", (F.size(F.array_distinct("path")) != F.size("path")).alias("is_loop"))


def paths_and_symmetries(links: DataFrame, starts: list, ends: list, inverse: dict[int, int], arrows: list[int] = (), sttypes: list[int] = (), min_depth: int = 1, max_depth: int = 10, compat: bool = False, limit: int = CONE_LIMIT) -> DataFrame:
    """Paths from any start to any end by deepening cones from both sides until a depth has paths without loops.

    Both cones are walked once, to the depth reached; a depth only joins what lies within it.
    """
    loops = None
    for d in range(min_depth, max_depth + 1):
        left = cut(walk(links, _roots(links, *starts), d, Limits(FORWARD, list(arrows), list(sttypes)), limit))
        back = [inverse[a] for a in arrows if a in inverse]
        right = cut(walk(links, _roots(links, *ends), d, Limits(BACKWARD, back, adjoint_sttypes(list(sttypes))), limit))
        met = cut(splice(left, right, inverse, compat))
        found = met.where("not is_loop")
        loops = met.where("is_loop") if loops is None else loops.unionByName(met.where("is_loop"))
        if not found.isEmpty():
            return found.unionByName(loops)
    return loops


def weighted_search(links: DataFrame, start, max_depth: int = 5, min_weight: float = 0.0) -> DataFrame:
    """All simple paths over links of any channel and at least the weight, with their sums, by length and then key."""
    return walk(links, _roots(links, start), max_depth, Limits(ALL, min_weight=min_weight)).orderBy("hops", "key")


def rank_by_weight(paths: DataFrame, ascending: bool = False) -> DataFrame:
    return paths.orderBy(F.col("total_weight").asc() if ascending else F.col("total_weight").desc(), "hops", "key")


def shortest(links: DataFrame, start, end=None, max_rounds: int = 1000) -> DataFrame:
    """(node, distance, total_weight, path): least sums of 1 / weight over links of any channel with a weight above 0.

    Rounds of relaxation until nothing gets nearer; only nodes that got nearer in a round go on. Of equal
    distances the path with fewer links and then the lesser nodes stays. With `end`, nodes farther than it
    aren't followed.
    """
    step = links.where("wgt > 0").groupBy("src", "dst").agg(F.max(F.col("wgt").cast("double")).alias("w")).select(F.col("src").alias("node"), F.col("dst").alias("to"), "w")
    step = cut(step)
    best = _roots(links, start).select(F.col("root").alias("node"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("total_weight"), F.array("root").alias("path"))
    front = best
    order = F.struct("distance", F.size("path").alias("n"), "path", "total_weight")
    for _ in range(max_rounds):
        reached = front.join(step, "node").where(~F.array_contains("path", F.col("to")))
        reached = reached.select(F.col("to").alias("node"), (F.col("distance") + 1 / F.col("w")).alias("distance"), (F.col("total_weight") + F.col("w")).alias("total_weight"), F.concat("path", F.array("to")).alias("path"))
        both = best.withColumn("new", F.lit(False)).unionByName(reached.withColumn("new", F.lit(True)))
        pick = both.groupBy("node").agg(F.min_by(F.struct("distance", "total_weight", "path", "new"), order).alias("b"))
        pick = cut(pick.select("node", "b.distance", "b.total_weight", "b.path", "b.new"))
        front, best = pick.where("new").drop("new"), pick.drop("new")
        if end is not None:
            bound = best.where(F.col("node") == F.lit(end)).select("distance").first()
            if bound:
                front = front.where(F.col("distance") < bound["distance"])
        if front.isEmpty():
            break
    return best if end is None else best.where(F.col("node") == F.lit(end))


def axial_path(links: DataFrame, start, arrow: int, limit: int = 100) -> DataFrame:
    """(step, node): from a node always the first link of one arrow whose end wasn't visited, at most limit steps."""
    own = cut(links.where(F.col("arr") == arrow).select("src", F.struct("stindex", "ord").alias("key"), "dst"))
    at, seen, out = start, {start}, []
    for step in range(1, limit + 1):
        options = own.where((F.col("src") == F.lit(at)) & ~F.col("dst").isin(*seen)).orderBy("key").limit(1).collect()
        if not options:
            break
        at = options[0]["dst"]
        seen.add(at)
        out.append((step, at))
    return links.sparkSession.createDataFrame(out, f"step int, node {links.schema['dst'].dataType.simpleString()}")


STRAND = 256


def _strands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (src, dst) of a batch as lists of nodes that follow each other, each link in one list, of up to STRAND nodes."""
    for batch in batches:
        nxt, entered, out = {}, set(), []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a in nxt or b in entered:
                out.append([a, b])
            else:
                nxt[a] = b
                entered.add(b)
        for a in [*(a for a in nxt if a not in entered), *nxt]:  # what the first ones leave are rings
            while a in nxt:
                own = [a]
                while a in nxt and len(own) < STRAND:
                    a = nxt.pop(a)
                    own.append(a)
                out.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(batch.column(0).type))], ["nodes"])


def _follow(strands: DataFrame, limit: int) -> DataFrame:
    """Adds to strands(nodes, head, tail) what comes after the tail, up to `limit` nodes, as `more`: each round doubles how far a strand knows its way."""
    if strands.select("tail").join(strands.select(F.col("head").alias("tail")), "tail", "left_semi").isEmpty():
        return strands.withColumn("more", F.slice("nodes", 1, 0))
    known = cut(strands.select("head", F.slice("nodes", 2, limit).alias("way"), F.col("tail").alias("end")))
    while True:
        nxt = known.select(F.col("head").alias("end"), F.col("way").alias("on"), F.col("end").alias("last"))
        goes = F.col("on").isNotNull() & (F.size("way") < limit)
        far = F.when(goes, F.slice(F.concat("way", "on"), 1, limit)).otherwise(F.col("way"))
        known = cut(known.join(nxt, "end", "left").select("head", far.alias("way"), F.when(goes, F.col("last")).otherwise(F.col("end")).alias("end"), goes.alias("went")))
        if known.where("went").isEmpty():
            break
        known = known.drop("went")
    return strands.join(known.select(F.col("head").alias("tail"), F.col("way").alias("more")), "tail", "left").withColumn("more", F.coalesce("more", F.slice("nodes", 1, 0)))


def axial_paths(links: DataFrame, arrow: int, limit: int = 100) -> DataFrame:
    """(root, step, node) from every node that has a link of the arrow.

    Where no node has two links of the arrow, out or in, what a walk meets again can only be its root. Then links
    that lie together are strung together where they lie, strands are put end to end, and every walk is a slice.
    """
    kind = links.schema["src"].dataType.simpleString()
    one = links.where(F.col("arr") == arrow)
    strands = one.where("src <> dst").select("src", "dst").mapInArrow(_strands, f"nodes array<{kind}>")
    strands = cut(strands.select("nodes", F.element_at("nodes", 1).alias("head"), F.element_at("nodes", -1).alias("tail")))
    side = lambda first, n: F.transform(F.slice("nodes", first, F.size("nodes") - 1), lambda x: F.xxhash64(F.lit(n), x))
    ends = strands.select(F.explode(F.concat(side(1, 0), side(2, 1))).alias("h"))  # equal hashes of unequal nodes only cost time
    if not ends.groupBy("h").count().where("count > 1").isEmpty():
        return _axial_steps(one, limit)
    after = F.concat("nodes", "more")
    walks = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(F.get("nodes", i - 1).alias("root"), F.slice(after, i + 1, limit).alias("path")))
    out = _follow(strands, limit).select(F.inline(walks))
    back = F.array_position("path", F.col("root")).cast("int")
    out = out.select("root", F.when(back > 0, F.slice("path", 1, F.greatest(back - 1, F.lit(0)))).otherwise(F.col("path")).alias("path"))
    return out.select("root", F.posexplode("path").alias("i", "node")).select("root", (F.col("i") + 1).alias("step"), "node")


def _axial_steps(links: DataFrame, limit: int) -> DataFrame:
    """The walks of axial_paths() where nodes have several links: all move together, one join a step; one that stops is put aside."""
    nth = F.row_number().over(Window.partitionBy("root").orderBy("key"))
    own = cut(links.select(F.col("src").alias("tip"), F.struct("stindex", "ord").alias("key"), "dst"))
    front = own.select(F.col("tip").alias("root")).distinct().select("root", F.col("root").alias("tip"), F.array("root").alias("path"))
    stopped = []
    for _ in range(limit):
        nxt = front.join(own, "tip").where(~F.array_contains("path", F.col("dst"))).withColumn("nth", nth).where("nth = 1")
        nxt = cut(nxt.select("root", F.col("dst").alias("tip"), F.concat("path", F.array("dst")).alias("path")))
        stopped.append(cut(front.join(nxt.select("root"), "root", "left_anti").select("root", "path")))
        front = nxt
        if nxt.isEmpty():
            break
    out = front.select("root", "path")
    for x in stopped:
        out = out.unionByName(x)
    return out.select("root", F.posexplode(F.slice("path", 2, 1 << 20)).alias("i", "node")).select("root", (F.col("i") + 1).alias("step"), "node")
