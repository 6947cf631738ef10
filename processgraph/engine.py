"""Search commands answered by the operators: text in, one DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from processgraph.functions import search_language as L
from processgraph.graph import Graph, nid
from processgraph.operators import analytics, paths, search


def _ids(g: Graph, p: L.Search, limit: int) -> list[int]:
    found = None
    for name in p.names or [L.NAMES_ALL]:
        own = search.nccs(g.nodes, g.links, name, p.chapter, p.seq_only, limit).select("nid")
        found = own if found is None else found.unionByName(own)
    return [r["nid"] for r in found.distinct().limit(limit).collect()]


def web_paths(g: Graph, found: DataFrame) -> DataFrame:
    """(pos, key, step, text, chapter, arrow, stindex, context) of the links of paths."""
    at = found.select("pos", "key", F.posexplode("links").alias("i", "x")).select("pos", "key", (F.col("i") + 1).alias("step"), "x.*")
    named = at.join(g.nodes.select(F.col("nid").alias("dst"), "text", "chapter"), "dst").join(F.broadcast(g.arrows().select(F.col("ptr").alias("arr"), F.col("short").alias("arrow"), "stindex")), "arr")
    return named.join(F.broadcast(g.contexts().select(F.col("ptr").alias("ctx"), "context")), "ctx", "left").select("pos", "key", "step", "dst", "text", "chapter", "arrow", "stindex", F.coalesce("context", F.lit("")).alias("context"))


def answer(g: Graph, p: L.Search) -> DataFrame:
    """One DataFrame by the rule that fits the parameters; no rule is an error."""
    rule, limit = L.route(p), min(p.limit, L.limits(p)[1])
    spark = g.spark
    if rule == "stats":
        return g.stats()
    if rule == "chapters":
        return g.chapters().where(F.contains(F.lower("chapter"), F.lit("" if p.chapter == L.NAMES_ALL else p.chapter.lower())))
    if rule == "paths":
        ends = spark.createDataFrame([(*p.from_node, *p.to_node)], "a int, b bigint, c int, d bigint").select(nid(F.col("a"), F.col("b")), nid(F.col("c"), F.col("d"))).first()
        return paths.find_paths(g.links, ends[0], ends[1], p.depth or 10)
    if rule == "arrows":
        return g.nodes.join(g.links.where(F.col("arr").isin(*p.arrows)).select(F.col("src").alias("nid")), "nid", "left_semi").orderBy("class", "cptr").limit(p.limit)
    ids = _ids(g, p, limit)
    if rule in ("cone", "stories"):
        forward = p.orientation != "backward"
        found = paths.constrained_cone(g.links, ids, p.depth or 5, g.nodes, "", g.contexts(), p.context, p.arrows if rule == "stories" else [], [], p.limit, forward)
        return web_paths(g, found)
    if rule == "orbit":
        found = paths.constrained_cone(g.links, ids, 3, limit=p.limit)
        return analytics.orbit(found, g.nodes)
    raise ValueError("nothing fits this search")


def query(g: Graph, text: str) -> DataFrame:
    """Answers a command in the short form."""
    return answer(g, L.decode_field(text, g.registry))


def command(g: Graph, text: str) -> DataFrame:
    """Answers a command in the long form: ends of paths may be names."""
    p = L.decode_command(text, g.registry)
    if p.from_names and p.to_names:
        a, b = search.solve_names(g.nodes, p.from_names, p.chapter), search.solve_names(g.nodes, p.to_names, p.chapter)
        starts, ends = ([r["nid"] for r in x.select("nid").collect()] for x in (a, b))
        return paths.paths_and_symmetries(g.links, starts, ends, g.registry.inverse, p.arrows, max_depth=p.depth or 10)
    return answer(g, p)


# Dictionaries as JSON columns


def node_json(g: Graph) -> DataFrame:
    """(nid, json) of nodes with their links by channel."""
    n = g.nested()
    return n.select("nid", F.to_json(F.struct(F.struct("class", "cptr").alias("nptr"), "text", "chapter", F.col("incidence"))).alias("json"))


def focal(g: Graph, node: int) -> dict:
    """What a node contains, what contains it."""
    up = analytics.parent(g.links).where(F.col("node") == node).first()
    return {"root": node, "children": [r["dst"] for r in analytics.children(g.links, node).collect()], "parent": up["parent"] if up else None}


class Focus:
    """A place in the containment hierarchy that moves down to children and back."""

    def __init__(self, g: Graph, root: int):
        self.g, self.trail = g, []
        self.view = focal(g, root)

    def down(self, child: int) -> Focus:
        if child not in self.view["children"]:
            raise ValueError(f"{child} is not contained in {self.view['root']}")
        self.trail.append(self.view["root"])
        self.view = focal(self.g, child)
        return self

    def up(self) -> Focus:
        if not self.trail:
            raise ValueError("already at the top")
        self.view = focal(self.g, self.trail.pop())
        return self


def tree(links: DataFrame, root, depth: int = 3) -> DataFrame:
    """(level, node, key) of what a node contains, in the order of a printed tree."""
    from processgraph.operators.frontier import Limits, walk

    roots = links.sparkSession.createDataFrame([(root,)], f"root {links.schema['src'].dataType.simpleString()}")
    return walk(links, roots, depth, Limits(channels=(6,))).select(F.col("hops").alias("level"), F.col("tip").alias("node"), "key")


def tree_lines(links: DataFrame, root, names: DataFrame | None = None, depth: int = 3) -> list[str]:
    """The tree as indented text."""
    t = tree(links, root, depth)
    if names is not None:
        t = t.join(names.select(F.col("nid").alias("node"), F.col("text").alias("label")), "node", "left")
    else:
        t = t.withColumn("label", F.col("node").cast("string"))
    return ["  " * r["level"] + (r["label"] or "???") for r in t.orderBy("key").collect()]


def wrap(text: str, width: int = 80, indent: int = 0) -> str:
    import textwrap

    return "\n".join(textwrap.fill(line, width, initial_indent=" " * indent, subsequent_indent=" " * indent) for line in text.splitlines())


def path_text(g: Graph, found: DataFrame) -> DataFrame:
    """(pos, key, line): each path as text -(arrow)-> text."""
    w = web_paths(g, found)
    steps = F.array_sort(F.collect_list(F.struct("step", F.concat(F.lit("-("), "arrow", F.lit(")-> "), "text").alias("s"))))
    return w.groupBy("pos", "key").agg(F.array_join(F.transform(steps, lambda x: x["s"]), " ").alias("line"))


def stories(g: Graph, starts: list[int], arrow: int, limit: int = 100) -> DataFrame:
    """(root, step, node, text, chapter, x, z): from each start the walk along one arrow, laid out along z."""
    from processgraph.operators import layout

    walks = paths.axial_paths(g.links, arrow, limit).where(F.col("root").isin(*starts))
    places = None
    for n, root in enumerate(starts, 1):
        own = layout.story_coordinates(walks.where(F.col("root") == root).select("step", "node"), n, len(starts), limit).withColumn("root", F.lit(root))
        places = own if places is None else places.unionByName(own)
    out = walks.join(places.select("root", "node", "x", "z"), ["root", "node"])
    return out.join(g.nodes.select(F.col("nid").alias("node"), "text", "chapter"), "node").select("root", "step", "node", "text", "chapter", "x", "z")


def page_json(g: Graph, lines: DataFrame) -> DataFrame:
    """(chapter, line, json) of page lines with the texts of their paths."""
    at = lines.select("chapter", "line", "ctx", F.posexplode("path").alias("i", "x")).select("chapter", "line", "ctx", "i", "x.arr", "x.dst")
    named = at.join(g.nodes.select(F.col("nid").alias("dst"), "text"), "dst").join(F.broadcast(g.arrows().select(F.col("ptr").alias("arr"), F.col("short").alias("arrow"))), "arr", "left")
    notes = F.transform(F.array_sort(F.collect_list(F.struct("i", "arrow", "text"))), lambda x: F.struct(x["arrow"].alias("arrow"), x["text"].alias("text")))
    return named.groupBy("chapter", "line", "ctx").agg(notes.alias("notes")).select("chapter", "line", F.to_json(F.struct("chapter", "line", "ctx", "notes")).alias("json"))


def event_json(g: Graph, node: int, depth: int = 3, limit: int = 100) -> DataFrame:
    """One row (nid, json): a node with its orbit by channel and the satellites' places."""
    from processgraph.operators import layout

    around = analytics.orbit(paths.forward_cone(g.links, node, depth, limit), g.nodes, depth, limit=limit)
    placed = layout.orbit_coordinates(around)
    sats = placed.agg(F.array_sort(F.collect_list(F.struct("stindex", "place", "radius", "text", "x", "y"))).alias("orbits"))
    return g.nodes.where(F.col("nid") == node).crossJoin(sats).select("nid", F.to_json(F.struct(F.struct("class", "cptr").alias("nptr"), "text", "chapter", "orbits")).alias("json"))


def browse(g: Graph, chapter: str, page: int = 1, width: int = 80) -> str:
    """A page of a chapter's notes as text, 100 lines a page."""
    from processgraph.operators.context import page as lines

    rows = page_json(g, lines(g.pagemap, chapter, number=page, size=100)).orderBy("chapter", "line").collect()
    import json

    return "\n".join(wrap(" ".join(f"({n['arrow']}) {n['text']}" if n.get("arrow") else n["text"] for n in json.loads(r["json"])["notes"]), width) for r in rows)


def set_provenance(g: Graph, rows: DataFrame) -> Graph:
    """Notes where nodes are from: rows have text, source, line, time and author; nulls are left out. Needs a note arrow."""
    if g.registry.by_name("note") is None:
        raise ValueError("no such arrow: note")
    values = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"prov:{k}:"), F.col(k).cast("string"))) for k in ("source", "line", "time", "author")]))
    own = rows.select(F.col("text").alias("src"), F.posexplode(values).alias("i", "dst"))
    edges = own.select("src", F.lit("note").alias("arrow"), "dst", F.array().cast("array<string>").alias("context"), F.lit(1.0).cast("float").alias("wgt"), F.col("i").cast("bigint").alias("ord"))
    none = g.spark.createDataFrame([], "text string, chapter string, seq boolean, ord bigint")
    return g.extend(none, edges)
