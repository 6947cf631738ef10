"""Queries over a graph that Graph.build makes of the driver tables, so that numbering, inverses and contexts are compared as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from processgraph.graph import Graph
from processgraph.operators import scores
from processgraph.plans.catalogue import _WORD, CHANNEL, query
from processgraph.plans.views import read
from processgraph.registry import Registry

_TABLES = [("region", "r", 0), ("nation", "n", 1000), ("customer", "c", 10**6), ("supplier", "s", 10**12)]
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey"}


def _vertices(spark: SparkSession, sf: str, tables=_TABLES) -> DataFrame:
    out = None
    for name, p, base in tables:
        own = read(spark, sf, name).select(F.col(f"{p}_name").alias("text"), F.lit(name).alias("chapter"), F.lit(False).alias("seq"), (F.col(_KEYS[name]) + base).cast("bigint").alias("ord"))
        out = own if out is None else out.unionByName(own)
    return out


def _edges(spark: SparkSession, sf: str, tables=_TABLES) -> DataFrame:
    """Region contains nation contains customer and supplier; a customer's link has its segment as context and a weight of 1 to 3."""
    r, n = read(spark, sf, "region"), read(spark, sf, "nation")
    none, one = F.array().cast("array<string>"), F.lit(1.0).cast("float")
    names, out = {t for t, _, _ in tables}, None

    def add(df: DataFrame, src: str, dst: str, context, wgt, order) -> None:
        nonlocal out
        own = df.select(F.col(src).alias("src"), F.lit("contain").alias("arrow"), F.col(dst).alias("dst"), context.alias("context"), wgt.alias("wgt"), order.cast("bigint").alias("ord"))
        out = own if out is None else out.unionByName(own)

    if "region" in names:
        add(n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")), "r_name", "n_name", none, one, F.col("n_nationkey") + 1000)
    if "customer" in names:
        c = read(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
        add(c, "n_name", "c_name", F.array(F.lower("c_mktsegment")), (F.col("c_custkey") % 3 + 1).cast("float"), F.col("c_custkey") + 10**6)
    if "supplier" in names:
        s = read(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
        add(s, "n_name", "s_name", none, one, F.col("s_suppkey") + 10**12)
    return out


def _registry() -> Registry:
    r = Registry()
    r.pair("contains", "contain", "contains", "belong", "belongs to")
    return r


def _graph(spark: SparkSession, sf: str) -> Graph:
    return Graph.build(_vertices(spark, sf), _edges(spark, sf), _registry())


BUILT = f"""vertex AS (SELECT r_name AS text, 'region' AS chapter, r_regionkey::BIGINT AS ord FROM region UNION ALL SELECT n_name, 'nation', n_nationkey + 1000 FROM nation
  UNION ALL SELECT c_name, 'customer', c_custkey + 1000000 FROM customer UNION ALL SELECT s_name, 'supplier', s_suppkey + 1000000000000 FROM supplier),
node AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY ord, text) AS cptr FROM (SELECT text, {CHANNEL.format(t="text")} AS class, arg_min(chapter, ord) AS chapter, min(ord) AS ord FROM vertex GROUP BY ALL)),
edge AS (SELECT r_name AS src, n_name AS dst, '' AS context, 1.0 AS wgt, n_nationkey::BIGINT AS o FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT n_name, c_name, lower(c_mktsegment), 1.0 + c_custkey % 3, c_custkey + 1000000 FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT n_name, s_name, '', 1.0, s_suppkey + 1000000000000 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
linked AS (SELECT src, 'contain' AS arrow, dst, context, wgt::DOUBLE AS wgt, o FROM edge UNION ALL SELECT dst, 'belong', src, context, wgt, o FROM edge)"""


@query("SELECT unnest(['customer', 'nation', 'region', 'supplier']) AS chapter")
def chapters_list(spark, sf):
    return _graph(spark, sf).chapters()


@query(f"WITH {BUILT} SELECT class::BIGINT AS class, cptr, text, length(text)::BIGINT AS len, chapter FROM node")
def built_nodes(spark, sf):
    return _graph(spark, sf).ordered().select(F.col("class").cast("bigint").alias("class"), "cptr", "text", F.col("len").cast("bigint").alias("len"), "chapter")


@query(f"WITH {BUILT} SELECT cptr, text FROM node WHERE chapter = 'supplier'")
def chapter_in_order(spark, sf):
    return _graph(spark, sf).ordered("supplier").select("cptr", "text")


@query(f"WITH {BUILT} SELECT class::BIGINT AS class, cptr, chapter FROM node WHERE text = (SELECT c_name FROM customer WHERE c_custkey = 7)")
def search_exact(spark, sf):
    name = read(spark, sf, "customer").where("c_custkey = 7").first()["c_name"]
    return _graph(spark, sf).by_name(name).select(F.col("class").cast("bigint").alias("class"), "cptr", "chapter")


@query(f"WITH {BUILT} SELECT cptr, text FROM node WHERE regexp_matches(text, '[A-Z].*[37]$')")
def find_nodes_regex(spark, sf):
    return _graph(spark, sf).find("[A-Z].*[37]$").select("cptr", "text")


@query(f"WITH {BUILT} SELECT cptr, text FROM node WHERE chapter LIKE '%tom%' ORDER BY class, cptr LIMIT 100")
def chapter_nodes(spark, sf):
    return _graph(spark, sf).chapter_nodes("tom").select("cptr", "text")


@query(f"WITH {BUILT} SELECT text, chapter FROM node WHERE class = 1 AND cptr = 12")
def node_lookup(spark, sf):
    return _graph(spark, sf).node(1, 12).select("text", "chapter")


@query(f"WITH {BUILT} SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM linked) AS links")
def graph_stats(spark, sf):
    return _graph(spark, sf).stats()


@query(f"WITH {BUILT} SELECT class::BIGINT AS class, max(cptr) AS top FROM node GROUP BY 1")
def top_pointers(spark, sf):
    return _graph(spark, sf).top_pointers().select(F.col("class").cast("bigint").alias("class"), "top")


@query(f"WITH {BUILT} SELECT src, arrow, dst, context, wgt FROM linked")
def edges_with_inverses(spark, sf):
    out = _graph(spark, sf).named_links()
    return out.select(F.col("src_text").alias("src"), F.col("short").alias("arrow"), F.col("dst_text").alias("dst"), "context", F.col("wgt").cast("double").alias("wgt"))


def _nation(g: Graph, spark: SparkSession, sf: str) -> int:
    name = read(spark, sf, "nation").where("n_nationkey = 3").first()["n_name"]
    return g.by_name(name).first()["nid"]


@query(f"WITH {BUILT} SELECT DISTINCT dst AS text FROM linked WHERE src = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def neighbors(spark, sf):
    g = _graph(spark, sf)
    return g.neighbours(_nation(g, spark, sf)).select("text")


@query(f"WITH {BUILT} SELECT dst AS text FROM linked WHERE arrow = 'contain' AND src = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def neighbors_by_type(spark, sf):
    g = _graph(spark, sf)
    return g.neighbours(_nation(g, spark, sf), 2).select("text")


@query(f"WITH {BUILT} SELECT n.cptr AS to_cptr, wgt, row_number() OVER (ORDER BY CASE arrow WHEN 'belong' THEN 0 ELSE 1 END, o) AS place FROM linked JOIN node n ON n.text = dst WHERE src = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def node_links(spark, sf):
    from pyspark.sql import Window

    g = _graph(spark, sf)
    own = g.links_of(_nation(g, spark, sf)).withColumn("place", F.row_number().over(Window.orderBy("stindex", "ord")).cast("bigint"))
    return own.join(g.nodes, own["dst"] == g.nodes["nid"]).select(F.col("cptr").alias("to_cptr"), F.col("wgt").cast("double").alias("wgt"), "place")


@query(f"WITH {BUILT} SELECT text, (SELECT count(*) FROM linked WHERE src = text AND arrow = 'contain') AS contains, (SELECT count(*) FROM linked WHERE src = text AND arrow = 'belong') AS belongs FROM node")
def nested_links(spark, sf):
    size = lambda k: F.coalesce(F.size(F.try_element_at("incidence", F.lit(k).cast("tinyint"))), F.lit(0)).cast("bigint")
    return _graph(spark, sf).nested().select("text", F.greatest(size(6), F.lit(0)).alias("contains"), F.greatest(size(2), F.lit(0)).alias("belongs"))


@query(f"WITH {BUILT} SELECT (SELECT count(*) FROM node WHERE chapter <> 'supplier') AS nodes, (SELECT count(*) FROM linked JOIN node ON text = src WHERE chapter <> 'supplier') AS links")
def without_chapter(spark, sf):
    return _graph(spark, sf).remove_chapter("supplier").stats()


@query(f"WITH {BUILT} SELECT text, cptr, chapter, (SELECT count(*) FROM linked WHERE src = text) AS links FROM node")
def extended_graph(spark, sf):
    """Regions, nations and customers first, and then the suppliers, which are numbered on."""
    first = Graph.build(_vertices(spark, sf, _TABLES[:3]), _edges(spark, sf, _TABLES[:3]), _registry())
    g = first.extend(_vertices(spark, sf, _TABLES[3:]), _edges(spark, sf, _TABLES[3:]))
    n = g.links.groupBy(F.col("src").alias("nid")).agg(F.count("*").alias("links"))
    return g.nodes.join(n, "nid", "left").select("text", "cptr", "chapter", F.coalesce("links", F.lit(0)).alias("links"))


_BEST = (
    _WORD
    + """, f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, word)::DOUBLE AS n, lag(ord) OVER (PARTITION BY doc_id, word ORDER BY ord, pos) AS last FROM word),
sc AS (SELECT doc_id, ord, round(sum(CASE WHEN n < 2 THEN 0 ELSE n * length(word) / (1 + exp(n / 45 - 1.0::DOUBLE / 30)) END), 6) AS a, round(sum(CASE WHEN last IS NULL THEN length(word) ELSE length(word) * (1 - exp(-(ord - last) / 45.0::DOUBLE)) END), 6) AS b FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC, ord) AS i, row_number() OVER (PARTITION BY doc_id ORDER BY b DESC, ord) AS j, greatest(1, round_even(count(*) OVER (PARTITION BY doc_id) * 0.5, 0)) AS most FROM sc),
best AS (SELECT s.doc_id, s.ord, s.sentence FROM sent s JOIN r ON r.doc_id = s.doc_id AND r.ord = s.ord WHERE i <= most OR j <= most)"""
)


@query(f"WITH {_BEST} SELECT doc_id, ord::BIGINT AS ord, sentence FROM best")
def significant_sentences(spark, sf):
    return scores.significant(read(spark, sf, "documents")).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "sentence")


@query(
    f"""WITH {_BEST}, line AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i, translate(sentence, '()', '[]') AS s FROM best)
SELECT doc_id, '- documents' || chr(10) || string_agg(CASE WHEN i % 45 = 0 THEN chr(10) || ' :: part ' || (i // 45 + 1) || ' ::' || chr(10) ELSE '' END || '@sen' || ord || '   ' || s, chr(10) ORDER BY ord) || chr(10) || '# sentences: ' || count(*) || chr(10) AS notes FROM line GROUP BY doc_id"""
)
def text_to_notes(spark, sf):
    return scores.to_notes(read(spark, sf, "documents"), "documents")
