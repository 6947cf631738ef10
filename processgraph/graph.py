"""A graph as tables, built from vertices and edges by set operations."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from processgraph.functions.scalars import compile_context, n_channel
from processgraph.lineage import cut
from processgraph.registry import Registry

VERTEX = "text string, chapter string, seq boolean, ord bigint"
EDGE = "src string, arrow string, dst string, context array<string>, wgt float, ord bigint"
LINK = "src bigint, stindex tinyint, ord bigint, arr int, wgt float, ctx int, dst bigint"
PAGEMAP = "chapter string, alias string, ctx int, line int, path array<struct<arr:int,wgt:float,ctx:int,dst:bigint>>"
CLASS_SHIFT = 40


def nid(cls, cptr):
    """The join key of the pointer (class, cptr)."""
    return F.shiftleft(cls.cast("bigint"), CLASS_SHIFT) + cptr


def number(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Numbers from 1 within each group in the given order, without bringing a group to one task.

    Rows are range partitioned by group and order; a row's number is its place in its partition plus
    the sizes of the group's parts before. Only these sizes come to the driver.
    """
    parts = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__row", F.monotonically_increasing_id()))
    at = F.shiftright("__row", 33)
    sizes = parts.groupBy(at.alias("part"), F.col(group).alias("group")).agg(F.count("*").alias("n"), F.min("__row").alias("first"))
    before, known = [], {}
    for r in sizes.orderBy("part", "group").collect():
        before.append((r["part"], r["group"], known.get(r["group"], 0) - r["first"]))
        known[r["group"]] = known.get(r["group"], 0) + r["n"]
    if not before:
        return parts.drop("__row").withColumn(name, F.lit(None).cast("bigint"))
    shift = df.sparkSession.createDataFrame(before, f"__part bigint, __group {df.schema[group].dataType.simpleString()}, __shift bigint")
    joined = parts.join(F.broadcast(shift), (at == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn(name, F.col("__row") + F.col("__shift") + 1).drop("__row", "__part", "__group", "__shift")


@dataclass(frozen=True)
class Graph:
    """nodes(nid, class, cptr, text, len, chapter, seq, ord), links in both directions, and the dimension tables."""

    spark: SparkSession
    registry: Registry
    nodes: DataFrame
    links: DataFrame
    chapters_seen: DataFrame
    pagemap: DataFrame

    @classmethod
    def build(cls, vertices: DataFrame, edges: DataFrame, registry: Registry, pagemap: DataFrame | None = None) -> Graph:
        """One node for each text: the first chapter that isn't empty counts, an earlier place wins; ends of edges are nodes too.

        An edge of an unknown arrow is an error. Each edge gives a link and, if its arrow has an inverse,
        the inverse link with the same weight and context; equal links are one. Contexts are registered in
        the order of their first edges.
        """
        spark = vertices.sparkSession
        ends = edges.select(F.explode(F.array("src", "dst")).alias("text"), F.lit("").alias("chapter"), F.lit(False).alias("seq"), (F.col("ord") + F.lit(1 << 40)).alias("ord"))
        seen = vertices.select("text", "chapter", "seq", "ord").unionByName(ends).where("text is not null and text <> ''")
        named = F.when(F.col("chapter") != "", F.struct("ord", "chapter"))
        nodes = seen.groupBy("text").agg(F.min("ord").alias("ord"), F.coalesce(F.min(named)["chapter"], F.lit("")).alias("chapter"), F.bool_or("seq").alias("seq"))
        nodes = nodes.select(n_channel(F.col("text")).alias("class"), "text", F.length("text").alias("len"), "chapter", "seq", "ord")
        nodes = number(nodes, "class", ["ord", "text"], "cptr")
        nodes = cut(nodes.select(nid(F.col("class"), F.col("cptr")).alias("nid"), "class", "cptr", "text", "len", "chapter", "seq", "ord"))

        edges = edges.withColumn("context", compile_context(F.coalesce("context", F.array().cast("array<string>"))))
        for row in edges.where("context <> ''").groupBy("context").agg(F.min("ord").alias("ord")).orderBy("ord", "context").collect():
            registry.context(row["context"].split(","))
        arrows = registry.arrow_table(spark)
        unknown = edges.join(F.broadcast(arrows), (F.col("arrow") == F.col("short")) | (F.col("arrow") == F.col("long")), "left_anti").select("arrow").first()
        if unknown:
            raise ValueError(f"no such arrow: {unknown['arrow']}")
        ids = nodes.select("nid", "text")
        contexts = F.broadcast(registry.context_table(spark).select(F.col("ptr").alias("ctx"), "context"))
        short = arrows.select(F.col("short").alias("arrow"), "ptr", "stindex", "inv_ptr", F.lit(0).alias("by"))
        long = arrows.select(F.col("long").alias("arrow"), "ptr", "stindex", "inv_ptr", F.lit(1).alias("by"))
        names = short.unionByName(long).groupBy("arrow").agg(F.min_by(F.struct("ptr", "stindex", "inv_ptr"), "by").alias("a"))
        linked = edges.join(F.broadcast(names), "arrow").join(contexts, "context", "left").join(ids.select(F.col("nid").alias("s"), F.col("text").alias("src")), "src").join(ids.select(F.col("nid").alias("d"), F.col("text").alias("dst")), "dst")
        back = F.broadcast(arrows.select(F.col("ptr").alias("inv"), F.col("stindex").alias("inv_st")))
        linked = linked.join(back, F.col("a.inv_ptr") == F.col("inv"), "left").withColumn("ctx", F.coalesce("ctx", F.lit(0)))
        one = F.struct(F.col("s").alias("src"), F.col("a.stindex").alias("stindex"), (F.col("ord") * 2).alias("ord"), F.col("a.ptr").alias("arr"), F.col("wgt"), F.col("ctx"), F.col("d").alias("dst"))
        two = F.when(F.col("inv").isNotNull(), F.struct(F.col("d").alias("src"), F.col("inv_st").alias("stindex"), (F.col("ord") * 2 + 1).alias("ord"), F.col("inv").alias("arr"), F.col("wgt"), F.col("ctx"), F.col("s").alias("dst")))
        links = linked.select(F.explode(F.array_compact(F.array(one, two))).alias("x")).select("x.*")
        links = links.groupBy("src", "stindex", "arr", "wgt", "ctx", "dst").agg(F.min("ord").alias("ord")).select("src", "stindex", "ord", "arr", "wgt", "ctx", "dst")
        seen_chapters = vertices.where("chapter <> ''").select("chapter").distinct()
        return cls(spark, registry, nodes, cut(links), seen_chapters, pagemap if pagemap is not None else spark.createDataFrame([], PAGEMAP))

    def extend(self, vertices: DataFrame, edges: DataFrame) -> Graph:
        """The graph with more vertices and edges. Known texts keep their pointers, and an empty chapter is filled; new ones are numbered on."""
        spark, top = self.spark, {r["class"]: r["top"] for r in self.top_pointers().collect()}
        last = self.nodes.agg(F.max("ord")).first()[0] or 0
        later = vertices.withColumn("ord", F.col("ord") + last + 1)
        base = self.links.agg(F.max("ord")).first()[0] or 0
        more = Graph.build(later, edges.withColumn("ord", F.col("ord") + F.lit(base // 2 + 1)), self.registry)
        old = self.nodes.select("text", F.col("nid").alias("known"))
        fresh = more.nodes.join(old, "text", "left_anti").drop("nid", "cptr")
        shift = F.create_map(*[F.lit(x) for kv in top.items() for x in kv]) if top else F.create_map().cast("map<int,bigint>")
        fresh = number(fresh, "class", ["ord", "text"], "cptr").withColumn("cptr", F.col("cptr") + F.coalesce(shift[F.col("class")], F.lit(0)))
        fresh = cut(fresh.withColumn("nid", nid(F.col("class"), F.col("cptr"))))
        filled = self.nodes.join(more.nodes.select("text", F.col("chapter").alias("given"), F.col("seq").alias("more_seq")), "text", "left")
        filled = filled.withColumn("chapter", F.when(F.col("chapter") == "", F.coalesce("given", F.lit(""))).otherwise(F.col("chapter"))).withColumn("seq", F.col("seq") | F.coalesce("more_seq", F.lit(False)))
        columns = self.nodes.columns
        nodes = cut(filled.select(*columns).unionByName(fresh.select(*columns)))
        ids = more.nodes.select(F.col("nid").alias("was"), "text").join(nodes.select("text", "nid"), "text").select("was", "nid")
        links = more.links.join(ids.select(F.col("was").alias("src"), F.col("nid").alias("s")), "src").join(ids.select(F.col("was").alias("dst"), F.col("nid").alias("d")), "dst")
        links = links.select(F.col("s").alias("src"), "stindex", "ord", "arr", "wgt", "ctx", F.col("d").alias("dst"))
        grown = replace(self, nodes=nodes, chapters_seen=self.chapters_seen.unionByName(more.chapters_seen).distinct()).with_links(links)
        return replace(grown, links=cut(grown.links))

    def with_links(self, links: DataFrame) -> Graph:
        """The same graph with more links; equal ones are one."""
        both = self.links.unionByName(links).groupBy("src", "stindex", "arr", "wgt", "ctx", "dst").agg(F.min("ord").alias("ord"))
        return replace(self, links=both.select("src", "stindex", "ord", "arr", "wgt", "ctx", "dst"))

    def named_links(self) -> DataFrame:
        """Links with texts, arrow names and contexts."""
        n = self.nodes.select("nid", "text")
        out = self.links.join(n.select(F.col("nid").alias("src"), F.col("text").alias("src_text")), "src").join(n.select(F.col("nid").alias("dst"), F.col("text").alias("dst_text")), "dst")
        out = out.join(F.broadcast(self.arrows().select(F.col("ptr").alias("arr"), "short", "long")), "arr")
        return out.join(F.broadcast(self.contexts().select(F.col("ptr").alias("ctx"), "context")), "ctx", "left").withColumn("context", F.coalesce("context", F.lit("")))

    def arrows(self) -> DataFrame:
        return self.registry.arrow_table(self.spark)

    def contexts(self) -> DataFrame:
        return self.registry.context_table(self.spark)

    def node(self, cls: int, cptr: int) -> DataFrame:
        return self.nodes.where((F.col("class") == cls) & (F.col("cptr") == cptr))

    def by_name(self, name: str) -> DataFrame:
        return self.nodes.where(F.col("text") == name)

    def find(self, condition) -> DataFrame:
        """Nodes by a Column, or by a regular expression of their text."""
        return self.nodes.where(F.col("text").rlike(condition) if isinstance(condition, str) else condition)

    def ordered(self, chapter: str = "") -> DataFrame:
        return (self.nodes.where(F.col("chapter") == chapter) if chapter else self.nodes).orderBy("class", "cptr")

    def chapters(self) -> DataFrame:
        return self.chapters_seen.unionByName(self.nodes.where("chapter <> ''").select("chapter")).distinct().orderBy("chapter")

    def chapter_nodes(self, chapter: str, limit: int = 100) -> DataFrame:
        return self.nodes.where(F.col("chapter").contains(chapter)).orderBy("class", "cptr").limit(limit)

    def stats(self) -> DataFrame:
        return self.nodes.agg(F.count("*").alias("nodes")).crossJoin(self.links.agg(F.count("*").alias("links")))

    def top_pointers(self) -> DataFrame:
        """The largest cptr of each class, from which new pointers go on."""
        return self.nodes.groupBy("class").agg(F.max("cptr").alias("top"))

    def links_of(self, node: int, stindex: int | None = None) -> DataFrame:
        own = self.links.where(F.col("src") == node)
        return (own if stindex is None else own.where(F.col("stindex") == stindex)).orderBy("stindex", "ord")

    def neighbours(self, node: int, sttype: int | None = None) -> DataFrame:
        """Nodes that links lead to, once each; of one type, by its forward channel and as often as there are links."""
        own = self.links.where(F.col("src") == node)
        own = own.where(F.col("stindex") == 4 + sttype).select("dst") if sttype is not None else own.select("dst").distinct()
        return own.join(self.nodes, own["dst"] == self.nodes["nid"]).drop("dst")

    def nested(self) -> DataFrame:
        """Each node with its links by channel."""
        rows = self.links.groupBy("src", "stindex").agg(F.array_sort(F.collect_list(F.struct("ord", "arr", "wgt", "ctx", "dst"))).alias("links"))
        rows = rows.groupBy("src").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stindex", "links")))).alias("incidence"))
        return self.nodes.join(rows, self.nodes["nid"] == rows["src"], "left").drop("src")

    def remove_chapter(self, chapter: str) -> Graph:
        """Without the chapter's nodes and page lines; links that lead to them stay."""
        if not chapter:
            raise ValueError("a chapter must be named")
        gone = self.nodes.where(F.col("chapter") == chapter).select(F.col("nid").alias("src"))
        return replace(self, nodes=self.nodes.where(F.col("chapter") != chapter), links=self.links.join(gone, "src", "left_anti"), pagemap=self.pagemap.where(F.col("chapter") != chapter), chapters_seen=self.chapters_seen.where(F.col("chapter") != chapter))

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Each table as Parquet: links by channel, so that a search of one type reads only its files."""
        self.nodes.write.mode(mode).parquet(f"{path}/nodes")
        self.links.write.mode(mode).partitionBy("stindex").parquet(f"{path}/links")
        for name, table in (("arrows", self.arrows()), ("contexts", self.contexts()), ("pagemap", self.pagemap), ("chapters", self.chapters_seen)):
            table.write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        registry = Registry.from_tables(read("arrows"), read("contexts"))
        links = read("links").withColumn("stindex", F.col("stindex").cast("tinyint")).select("src", "stindex", "ord", "arr", "wgt", "ctx", "dst")
        return cls(spark, registry, read("nodes"), links, read("chapters"), read("pagemap"))

    def __str__(self) -> str:
        n, m = self.stats().first()
        return f"graph of {n} nodes and {m} links"


class GraphBuilder:
    """Vertices and edges one by one or as DataFrames, in order; used as a context manager it builds at the end."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None):
        self.spark, self.registry = spark, registry or Registry.standard()
        self._vertices: list[tuple] = []
        self._edges: list[tuple] = []
        self._frames: list[tuple[str, DataFrame]] = []
        self.graph: Graph | None = None

    def __enter__(self) -> GraphBuilder:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.graph = self.build()

    def vertex(self, text: str, chapter: str = "", seq: bool = False) -> str:
        self._vertices.append((text, chapter, seq, len(self._vertices)))
        return text

    def edge(self, src: str, arrow: str, dst: str, context: list[str] = (), weight: float = 1.0) -> None:
        if self.registry.by_name(arrow) is None:
            raise ValueError(f"no such arrow: {arrow}")
        self._edges.append((src, arrow, dst, list(context), float(weight), len(self._edges)))

    connect = edge

    def hub(self, name: str, chapter: str, members: list[str], arrow: str, context: list[str] = (), weights: list[float] = ()) -> str:
        """A node that every member has a link to; weights by place, 1 where none is given."""
        self.vertex(name, chapter)
        for k, m in enumerate(members):
            self.edge(m, arrow, name, context, weights[k] if k < len(weights) else 1.0)
        return name

    def vertices(self, frame: DataFrame) -> None:
        self._frames.append(("v", frame))

    def edges(self, frame: DataFrame) -> None:
        self._frames.append(("e", frame))

    def build(self) -> Graph:
        v = self.spark.createDataFrame(self._vertices, VERTEX)
        e = self.spark.createDataFrame(self._edges, EDGE)
        for kind, frame in self._frames:
            v, e = (v.unionByName(frame), e) if kind == "v" else (v, e.unionByName(frame))
        return Graph.build(v, e, self.registry)


def hub_join(members: DataFrame, name: str, arrow: str, weights: list[float] = ()) -> DataFrame:
    """Edges from each text of members(ord, text) to a hub; weights by the order of ord."""
    nth = F.row_number().over(Window.orderBy("ord"))
    given = F.array(*map(F.lit, weights or [1.0])).cast("array<float>")
    return members.select(F.col("text").alias("src"), F.lit(arrow).alias("arrow"), F.lit(name).alias("dst"), F.coalesce(F.try_element_at(given, nth), F.lit(1.0)).cast("float").alias("wgt"), "ord")
