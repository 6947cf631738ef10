"""The queries of the graph engine and the SQL that DuckDB answers with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from processgraph.functions import scalars as S
from processgraph.operators import analytics as A
from processgraph.operators import context as C
from processgraph.operators import layout, matrix, paths, scores, search, spans, text
from processgraph.operators.frontier import BACKWARD, FORWARD, Limits, walk
from processgraph.plans import views as V
from processgraph.sources.rdf import LABEL as RDF_LABEL
from processgraph.sources.rdf import TYPE as RDF_TYPE
from processgraph.plans.views import CTX, EVT, GEO, GEO_NODES, ORD, SUP, USERS, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(path: str = "path"):
    return F.array_join(path, ">")


# Scans, lookups and scalar functions

CHANNEL = "CASE WHEN length({t}) - length(replace({t}, ' ', '')) < 3 THEN length({t}) - length(replace({t}, ' ', '')) + 1 WHEN length({t}) < 128 THEN 4 WHEN length({t}) < 1024 THEN 5 ELSE 6 END"


@query(f"SELECT {CHANNEL.format(t='text')}::BIGINT AS class, count(*) AS n FROM documents GROUP BY 1")
def node_count_by_class(spark, sf):
    return read(spark, sf, "documents").groupBy(S.n_channel(F.col("text")).cast("bigint").alias("class")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, length(text)::BIGINT AS len, {CHANNEL.format(t='text')}::BIGINT AS class FROM documents")
def n_channel_docs(spark, sf):
    s = S.storage_class(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", s["len"].cast("bigint").alias("len"), s["class"].cast("bigint").alias("class"))


@query("SELECT p_brand AS chapter, count(*) AS n FROM part GROUP BY 1")
def chapter_counts(spark, sf):
    return V.parts(spark, sf).groupBy("chapter").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS nid, p_name AS text FROM part WHERE contains(lower(p_name), 'ed w')")
def text_search(spark, sf):
    return search.search_text(V.parts(spark, sf), "ED W").select("nid", "text")


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'there')")
def text_search_docs(spark, sf):
    return read(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("there"))).select("doc_id", "n_chars")


@query(f"WITH {GEO} SELECT stindex::BIGINT AS stindex, CASE stindex WHEN 6 THEN '+CONTAINS' ELSE '-CONTAINS' END AS label, CASE stindex WHEN 6 THEN 'Ic2' ELSE 'Im2' END AS channel, count(*) AS n FROM geo GROUP BY ALL")
def channels(spark, sf):
    st = F.col("stindex")
    return V.geo(spark, sf).groupBy(st.cast("bigint").alias("stindex"), S.stindex_label(st).alias("label"), S.channel_name(st - 4).alias("channel")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, list_aggregate(list_sort(list_distinct([lang, source, 'any'])), 'string_agg', ',') AS context FROM documents")
def context_strings(spark, sf):
    labels = F.array(F.concat(F.lit(" "), "lang", F.lit("  ")), "source", F.lit("any"), F.lit(""), "lang")
    return read(spark, sf, "documents").select("doc_id", S.compile_context(labels).alias("context"))


@query("SELECT p_partkey AS nid, lower(regexp_replace(regexp_replace(p_name || ' / ' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS path FROM part")
def asset_paths(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("nid"), F.lower(S.sanitize_path(F.concat("p_name", F.lit(" / "), "p_brand"))).alias("path"))


# Structured search


@query("""WITH deg AS (SELECT l_partkey, count(*) AS degree FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1)
SELECT p_partkey AS nid, p_name AS text, coalesce(degree, 0) AS degree FROM part LEFT JOIN deg ON l_partkey = p_partkey WHERE p_name LIKE '%widget%' AND lower(p_brand) LIKE '%brand#1%' ORDER BY p_name, degree DESC, nid LIMIT 50""")
def nccs_search(spark, sf):
    links = V.sup(spark, sf).withColumn("src", F.regexp_extract("src", r"^p:(\d+)$", 1).try_cast("bigint")).where("src is not null")
    nodes = V.parts(spark, sf).where(search.name_condition("%widget%", "brand#1"))
    degree = links.where(F.col("stindex").isin(1, 5, 7)).groupBy(F.col("src").alias("nid")).agg(F.count("*").alias("degree"))
    return nodes.join(degree, "nid", "left").select("nid", "text", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy("text", F.desc("degree"), "nid").limit(50)


@query(f"""WITH {CTX}, {USERS} SELECT nid, text FROM users u WHERE contains(text, '1') AND chapter IN ('odd')
AND NOT EXISTS (SELECT 1 FROM ctx WHERE src = nid AND contains(context, 'signup,Sunday'))
AND EXISTS (SELECT 1 FROM ctx WHERE src = nid AND contains(context, 'error') AND contains(context, 'Monday'))
AND EXISTS (SELECT 1 FROM ctx WHERE src = nid AND wgt >= 50) AND EXISTS (SELECT 1 FROM ctx WHERE src = nid AND abs(stindex - 4) = 3)""")
def unified_search(spark, sf):
    p = search.Unified("1", ["odd"], ["error", "Monday"], ["signup,Sunday"], 50.0, 3, None)
    return search.unified(V.users(spark, sf), V.ctx_links(spark, sf), V.contexts(spark), p).select("nid", "text")


@query(f"WITH {CTX}, {USERS} SELECT nid, text FROM users WHERE contains(text, 'user 2') AND NOT contains(text, '5') AND NOT EXISTS (SELECT 1 FROM ctx WHERE src = nid AND contains(context, '5')) AND EXISTS (SELECT 1 FROM ctx WHERE src = nid AND wgt >= 20)")
def unified_search_text(spark, sf):
    p = search.parse_unified("user 2 NOT 5 st:express w>20")
    p.limit = None
    return search.unified(V.users(spark, sf), V.ctx_links(spark, sf), V.contexts(spark), p, True).select("nid", "text")


@query("SELECT p_partkey AS nid FROM part WHERE contains(p_name, 'red') AND contains(p_name, 'bolt')")
def combinatorial_and(spark, sf):
    return search.combinatorial(V.parts(spark, sf), ["red", "bolt"], "and").select("nid")


@query("SELECT p_partkey AS nid FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'bolt')")
def combinatorial_or(spark, sf):
    return search.combinatorial(V.parts(spark, sf), ["red", "bolt"], "or").select("nid")


@query("SELECT term, p_partkey AS nid FROM part, (VALUES ('red'), ('bolt')) t(term) WHERE contains(p_name, term)")
def combinatorial_product(spark, sf):
    return search.combinatorial(V.parts(spark, sf), ["red", "bolt"], "product").select("term", "nid")


@query("SELECT chapter, count(p_partkey) AS n FROM (VALUES ('Brand#1'), ('Brand#22'), ('none')) t(chapter) LEFT JOIN part ON p_brand = chapter AND contains(lower(p_name), 'ring') GROUP BY 1")
def cross_chapter(spark, sf):
    return search.cross_chapter(V.parts(spark, sf), "Ring", ["Brand#1", "Brand#22", "none"]).select("chapter", "n")


@query(f"""WITH {CTX}, {USERS} SELECT nid FROM users WHERE contains(text, 'user') AND EXISTS (SELECT 1 FROM ctx WHERE src = nid AND list_contains(string_split(lower(context), ','), 'purchase') AND NOT list_contains(string_split(lower(context), ','), 'monday') AND NOT list_contains(string_split(lower(context), ','), 'sunday'))""")
def inhibition_search(spark, sf):
    include, exclude = search.parse_inhibition("purchase NOT monday, sunday")
    return search.with_inhibition(V.users(spark, sf), V.ctx_links(spark, sf), V.contexts(spark), "user", include, exclude).select("nid")


@query(f"WITH {CTX} SELECT src AS node, count(*) AS n FROM ctx WHERE stindex = 7 AND (contains(context, 'click') OR contains(context, 'Friday')) GROUP BY 1")
def match_contexts(spark, sf):
    links = V.ctx_links(spark, sf).join(F.broadcast(V.contexts(spark).withColumnRenamed("ptr", "ctx")), "ctx").where("stindex = 7")
    return links.where(S.match_contexts(["click", "Friday"], F.col("labels"))).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))


@query(f"WITH {EVT} SELECT src AS node, CASE WHEN bool_or(stindex = 5) THEN 'source' ELSE 'sink' END AS role FROM evt GROUP BY 1 HAVING bool_or(stindex = 5) <> bool_or(stindex = 3)")
def singletons(spark, sf):
    return A.singletons(V.evt(spark, sf), [1])


@query(f"WITH {GEO} SELECT src AS node, count(*) AS n, string_agg(dst, ',' ORDER BY ord) AS members FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS nth FROM geo WHERE arr = 1) WHERE nth <= 100 GROUP BY 1")
def appointed_by_arrow(spark, sf):
    return A.appointed_by_arrow(V.geo(spark, sf), 2, {1: 2, 2: 1}, 100).select("node", "n", F.array_join("members", ",").alias("members"))


@query(f"WITH {GEO} SELECT src AS node, count(*) AS n, string_agg(dst, ',' ORDER BY ord) AS members FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS nth FROM geo WHERE stindex = 2) WHERE nth <= 100 GROUP BY 1")
def appointed_by_sttype(spark, sf):
    return A.appointed_by_sttype(V.geo(spark, sf), -2).select("node", "n", F.array_join("members", ",").alias("members"))


# Indexing of tables, edges


@query("SELECT 'db.' || t AS chapter, n FROM (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier)")
def index_rows(spark, sf):
    return _index(spark, sf)[0].groupBy("chapter").agg(F.count("*").alias("n"))


@query("SELECT s_name AS src, 's_acctbal: ' || printf('%.2f', s_acctbal) AS dst FROM supplier")
def index_property_links(spark, sf):
    return _index(spark, sf)[1].where("arrow = 'note'").select("src", "dst")


@query("SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def index_fk_links(spark, sf):
    return _index(spark, sf)[1].where("arrow = 'then'").select("src", "dst")


def _index(spark, sf):
    from processgraph.sources.importers import TableIndex, index_tables

    tables = {t: read(spark, sf, t) for t in ("region", "nation", "supplier")}
    tables["supplier"] = tables["supplier"].withColumn("s_acctbal", F.format_string("%.2f", "s_acctbal"))
    config = {"region": TableIndex("r_name", "r_regionkey"), "nation": TableIndex("n_name", "n_nationkey", [], [("n_regionkey", "region", "r_regionkey")]), "supplier": TableIndex("s_name", "s_suppkey", [], [("s_nationkey", "nation", "n_nationkey")])}
    return index_tables(tables, config)


@query("SELECT n_name AS src, 'hub' AS dst, CASE WHEN n_nationkey < 3 THEN [0.5, 2.0, 4.0][n_nationkey + 1] ELSE 1.0 END::DOUBLE AS wgt FROM nation")
def hub_join(spark, sf):
    from processgraph.graph import hub_join as hub

    members = read(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("text"))
    return hub(members, "hub", "has", [0.5, 2.0, 4.0]).select("src", "dst", F.col("wgt").cast("double").alias("wgt"))


@query(f"WITH {GEO} SELECT src, dst FROM geo WHERE src IN ('n:1', 'n:2') AND stindex = 6 AND arr = 1 ORDER BY src, ord LIMIT 40")
def one_hop_constrained(spark, sf):
    out = paths.one_hop(V.geo(spark, sf), ["n:1", "n:2"], arrows=[1], limit=40)
    return out.select(F.col("root").alias("src"), F.col("tip").alias("dst"))


# Cones and paths


def _cone_sql(base: str, table: str, start: str, depth: int, stindexes: str, extra: str = "") -> str:
    return f"""WITH RECURSIVE {base}, walk AS (
      SELECT [src, dst] AS path, [{{'s': stindex, 'o': ord}}] AS key, dst AS tip, 1 AS hops FROM {table} WHERE src = '{start}' AND stindex IN ({stindexes}) {extra}
      UNION ALL SELECT list_append(path, dst), list_append(key, {{'s': stindex, 'o': ord}}), dst, hops + 1 FROM walk JOIN {table} ON src = tip AND stindex IN ({stindexes}) {extra} WHERE hops < {depth} AND NOT list_contains(path, dst))"""


@query(_cone_sql(GEO, "geo", "r:1", 3, "5,6,7") + " SELECT array_to_string(path, '>') AS path, hops::BIGINT AS hops FROM walk")
def forward_cone(spark, sf):
    out = paths.forward_cone(V.geo(spark, sf), "r:1", 3, None)
    return out.select(joined().alias("path"), F.col("hops").cast("bigint").alias("hops"))


@query(_cone_sql(GEO, "geo", "c:7", 4, "1,2,3") + " SELECT array_to_string(path, '>') AS path, hops::BIGINT AS hops FROM walk")
def backward_cone(spark, sf):
    return paths.backward_cone(V.geo(spark, sf), "c:7", 4, None).select(joined().alias("path"), F.col("hops").cast("bigint").alias("hops"))


@query(_cone_sql(GEO, "geo", "r:2", 3, "5,6,7") + " SELECT array_to_string(path, '>') AS path FROM walk ORDER BY key LIMIT 60")
def cone_limit(spark, sf):
    return paths.forward_cone(V.geo(spark, sf), "r:2", 3, 60).select(joined().alias("path"))


@query(_cone_sql(EVT, "evt", "e:17", 6, "5,6,7") + " SELECT array_to_string(path, '>') AS path FROM walk")
def event_cone(spark, sf):
    return paths.forward_cone(V.evt(spark, sf), "e:17", 6).select(joined().alias("path"))


@query(f"WITH {GEO} SELECT array_to_string([src, dst], '>') AS path FROM geo WHERE src IN ('n:0', 'n:3') AND stindex = 6")
def constrained_cone(spark, sf):
    """Customers and suppliers are outside the chapter, so paths end there."""
    return paths.constrained_cone(V.geo(spark, sf), ["n:0", "n:3"], 3, V.geo_nodes(spark, sf), "nation", sttypes=[2, -2], limit=100_000).select(joined().alias("path"))


@query(f"WITH {GEO} SELECT array_to_string([a.src, a.dst, b.dst], '>') AS path FROM geo a JOIN geo b ON b.src = a.dst AND b.stindex = 6 WHERE a.src IN ('r:4', 'r:0') AND a.stindex = 6 UNION ALL SELECT array_to_string([src, dst], '>') FROM geo WHERE src IN ('r:4', 'r:0') AND stindex = 6")
def multi_start_cone(spark, sf):
    return paths.constrained_cone(V.geo(spark, sf), ["r:4", "r:0"], 2, sttypes=[2], limit=1_000_000).select(joined().alias("path"))


@query(_cone_sql(GEO, "geo", "r:0", 2, "5,6,7") + ", steps AS (SELECT unnest(path[2:]) AS node FROM walk) SELECT node, count(*) AS n FROM steps GROUP BY 1 HAVING count(*) > 1")
def supernodes(spark, sf):
    return paths.supernodes(paths.forward_cone(V.geo(spark, sf), "r:0", 2, None))


@query(_cone_sql(GEO, "geo", "r:0", 2, "5,6,7") + ", steps AS (SELECT unnest(path[2:]) AS node FROM walk) SELECT node, count(*) AS n FROM steps GROUP BY 1")
def path_tally(spark, sf):
    return A.tally(paths.forward_cone(V.geo(spark, sf), "r:0", 2, None))


@query(f"""WITH {GEO}, p AS (SELECT a.src AS root, a.dst AS mid, b.dst AS leaf FROM geo a JOIN geo b ON b.src = a.dst AND b.stindex = 2 WHERE a.stindex = 2 AND a.src LIKE 'c:%')
SELECT mid, leaf, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1""")
def transverse_supernodes(spark, sf):
    links = V.geo(spark, sf)
    starts = links.where("stindex = 2 and src like 'c:%'").select(F.col("src").alias("root"))
    both = walk(links, starts, 2, Limits(channels=BACKWARD)).where("hops = 2").select(F.col("root").alias("path_id"), "links")
    groups = A.transverse_supernodes(both)
    pair = F.explode(F.expr("transform(filter(nodes, x -> x like 'n:%'), m -> struct(m as mid, filter(nodes, x -> x like 'r:%') as leaves))"))
    # a nation's paths are fewer than its region's, so groups hold one of each kind at most
    n = groups.where(F.expr("exists(nodes, x -> x like 'n:%')")).select(F.size("paths").alias("n"), pair.alias("p")).select("p.mid", "n")
    up = links.where("stindex = 2 and src like 'n:%'").select(F.col("src").alias("mid"), F.col("dst").alias("leaf"))
    return n.join(up, "mid").select("mid", "leaf", F.col("n").cast("bigint").alias("n"))


@query(_cone_sql(GEO, "geo", "r:3", 3, "5,6,7") + " SELECT array_to_string(path, '>') AS path FROM walk WHERE tip = (SELECT min('c:' || c_custkey) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 3)")
def find_paths(spark, sf):
    end = read(spark, sf, "customer").join(F.broadcast(read(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).where("n_regionkey = 3").agg(F.min(V.key("c", "c_custkey"))).first()[0]
    return paths.find_paths(V.geo(spark, sf), "r:3", end, 3).select(joined().alias("path"))


@query("""WITH p AS (SELECT user_id AS path_id, event_type AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
f AS (SELECT path_id, node, min(i) AS a FROM p GROUP BY ALL)
SELECT p.path_id, p.i::BIGINT AS i, array_to_string(w.nodes[f.a + 1:p.i + 1], '>') AS loop FROM p JOIN f ON f.path_id = p.path_id AND f.node = p.node AND p.i > f.a JOIN (SELECT path_id, list(node ORDER BY i) AS nodes FROM p GROUP BY 1) w ON w.path_id = p.path_id""")
def path_loops(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").withColumn("i", F.row_number().over(w))
    p = e.groupBy(F.col("user_id").alias("path_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "event_type"))), lambda x: x["event_type"]).alias("path"))
    return paths.path_loops(p).select("path_id", F.col("i").cast("bigint").alias("i"), F.array_join("loop", ">").alias("loop"))


@query(f"""WITH {GEO} SELECT array_to_string([a.src, a.dst, b.dst], '>') AS path FROM geo a JOIN geo b ON b.src = a.dst AND b.stindex = 6 WHERE a.src = 'r:2' AND a.stindex = 6 AND b.dst IN ('c:1', 'c:2', 'c:3', 'c:4', 'c:5', 'c:6', 'c:7', 'c:8')""")
def wave_front_splice(spark, sf):
    g = V.geo(spark, sf)
    left = paths.constrained_cone(g, ["r:2"], 1, limit=None)
    right = paths.constrained_cone(g, [f"c:{k}" for k in range(1, 9)], 1, limit=None, forward=False)
    return paths.splice(left, right, {1: 2, 2: 1}).where("not is_loop").select(joined().alias("path"))


@query(f"""WITH RECURSIVE {SUP}, walk AS (SELECT [src, dst] AS path, dst AS tip, wgt::FLOAT::DOUBLE AS total, 1 AS hops FROM sup WHERE src = 'p:5' AND wgt >= 30
  UNION ALL SELECT list_append(path, dst), dst, total + wgt::FLOAT::DOUBLE, hops + 1 FROM walk JOIN sup ON src = tip AND wgt >= 30 WHERE hops < 2 AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, round(total, 6) AS total_weight FROM walk""")
def weighted_paths(spark, sf):
    return paths.weighted_search(V.sup(spark, sf), "p:5", 2, 30.0).select(joined().alias("path"), F.round("total_weight", 6).alias("total_weight"))


@query(f"""WITH RECURSIVE {SUP}, walk AS (SELECT [src, dst] AS path, dst AS tip, wgt::FLOAT::DOUBLE AS total, 1 AS hops FROM sup WHERE src = 'p:9'
  UNION ALL SELECT list_append(path, dst), dst, total + wgt::FLOAT::DOUBLE, hops + 1 FROM walk JOIN sup ON src = tip WHERE hops < 2 AND NOT list_contains(path, dst)) SELECT round(total, 6) AS total_weight FROM walk ORDER BY total DESC LIMIT 20""")
def rank_by_weight(spark, sf):
    ranked = paths.rank_by_weight(paths.weighted_search(V.sup(spark, sf), "p:9", 2))
    return ranked.limit(20).select(F.round("total_weight", 6).alias("total_weight"))


@query(f"""WITH RECURSIVE {GEO}, walk AS (SELECT 'r:1' AS node, ['r:1'] AS path, 0 AS d UNION ALL SELECT dst, list_append(path, dst), d + 1 FROM walk JOIN geo ON src = node WHERE NOT list_contains(path, dst) AND d < 4)
SELECT node, min(d)::DOUBLE AS distance FROM walk GROUP BY 1""")
def dijkstra(spark, sf):
    return paths.shortest(V.geo(spark, sf), "r:1").select("node", "distance")


@query(f"WITH {ORD}, firsts AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT 'o:' || a.o_orderkey AS root, (b.n - a.n)::BIGINT AS step, 'o:' || b.o_orderkey AS node FROM firsts a JOIN firsts b USING (o_custkey) WHERE b.n > a.n AND b.n - a.n <= 100")
def axial_paths(spark, sf):
    return paths.axial_paths(V.orders(spark, sf), 3, 100).select("root", F.col("step").cast("bigint").alias("step"), "node")


@query("WITH f AS (SELECT 'o:' || o_orderkey AS node, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS step FROM orders WHERE o_custkey = 7) SELECT step, node FROM f WHERE step > 0")
def sequence_story(spark, sf):
    first = read(spark, sf, "orders").where("o_custkey = 7").orderBy("o_orderdate", "o_orderkey").select(V.key("o", "o_orderkey").alias("n")).first()
    return paths.axial_path(V.orders(spark, sf), first["n"] if first else "", 3).select(F.col("step").cast("bigint").alias("step"), "node")


@query(_cone_sql(GEO, "geo", "r:1", 3, "5,6,7") + f", {GEO_NODES} SELECT text, min(hops)::BIGINT AS radius FROM walk JOIN nodes ON nid = tip GROUP BY 1")
def node_orbit(spark, sf):
    out = A.orbit(paths.forward_cone(V.geo(spark, sf), "r:1", 3, None), V.geo_nodes(spark, sf), limit=1_000_000)
    return out.select("text", F.col("radius").cast("bigint").alias("radius"))


@query(_cone_sql(GEO, "geo", "r:4", 2, "6") + " SELECT tip AS node, hops::BIGINT AS level, row_number() OVER (ORDER BY key) AS place FROM walk")
def focal_tree(spark, sf):
    from pyspark.sql import Window

    from processgraph.engine import tree

    t = tree(V.geo(spark, sf), "r:4", 2)
    return t.select("node", F.col("level").cast("bigint").alias("level"), F.row_number().over(Window.orderBy("key")).cast("bigint").alias("place"))


@query(f"WITH {GEO} SELECT src AS node FROM geo GROUP BY 1 HAVING bool_or(stindex = 6) AND NOT bool_or(stindex = 2)")
def hierarchy_roots(spark, sf):
    return A.hierarchy_roots(V.geo(spark, sf))


@query(f"WITH {GEO} SELECT src AS node, arg_min(dst, ord) AS parent FROM geo WHERE stindex = 2 GROUP BY 1")
def containing_parent(spark, sf):
    return A.parent(V.geo(spark, sf))


# Adjacency and analytics


@query(f"WITH {SUP} SELECT src, dst, round(sum(wgt::FLOAT::DOUBLE), 6) AS weight FROM sup WHERE arr = 3 GROUP BY ALL")
def adjacency(spark, sf):
    n = V.tasks(read(spark, sf, "lineitem"))
    return A.adjacency(V.sup(spark, sf), [3], tasks=n).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {ORD}, f AS (SELECT * FROM ords WHERE arr = 3) SELECT DISTINCT src AS node FROM f WHERE src NOT IN (SELECT dst FROM f)")
def sources(spark, sf):
    return A.sources(A.adjacency(V.orders(spark, sf), [3]))


@query(f"WITH {ORD}, f AS (SELECT * FROM ords WHERE arr = 3) SELECT DISTINCT dst AS node FROM f WHERE dst NOT IN (SELECT src FROM f)")
def sinks(spark, sf):
    return A.sinks(A.adjacency(V.orders(spark, sf), [3]))


@query(f"WITH {SUP}, f AS (SELECT src, dst, wgt::FLOAT::DOUBLE AS w FROM sup WHERE arr = 3) SELECT src, dst, round(sum(w), 6) AS weight FROM (SELECT src, dst, w FROM f UNION ALL SELECT dst, src, w FROM f) GROUP BY ALL")
def symmetrize(spark, sf):
    n = V.tasks(read(spark, sf, "lineitem"))
    return A.symmetrize(A.adjacency(V.sup(spark, sf), [3], tasks=n), n and 2 * n).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {ORD}, f AS (SELECT * FROM ords WHERE arr = 3) SELECT (SELECT count(*) FROM (SELECT src FROM f UNION SELECT dst FROM f)) AS nodes, (SELECT count(*) FROM f) AS links, (SELECT count(DISTINCT src) FROM f WHERE src NOT IN (SELECT dst FROM f)) AS sources, (SELECT count(DISTINCT dst) FROM f WHERE dst NOT IN (SELECT src FROM f)) AS sinks")
def graph_summary(spark, sf):
    from processgraph.lineage import cut

    adj = cut(A.adjacency(V.orders(spark, sf), [3]))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(A.members(adj), "nodes").crossJoin(one(adj, "links")).crossJoin(one(A.sources(adj), "sources")).crossJoin(one(A.sinks(adj), "sinks"))


def _evc_sql(steps: int) -> str:
    parts = [f"WITH {GEO}, adj AS (SELECT src, dst, count(*)::DOUBLE AS w FROM geo GROUP BY ALL), m AS (SELECT src AS node FROM adj UNION SELECT dst FROM adj), v0 AS (SELECT node, 1.0::DOUBLE AS evc FROM m)"]
    for k in range(steps):
        parts.append(f", s{k} AS (SELECT dst AS node, sum(w * evc) AS nxt FROM adj JOIN v{k} ON node = src GROUP BY 1), v{k + 1} AS (SELECT m.node, coalesce(nxt / (SELECT max(nxt) FROM s{k}), 0) AS evc FROM m LEFT JOIN s{k} USING (node))")
    return "".join(parts) + f" SELECT node, round(evc, 6) AS evc FROM v{steps}"


@query(_evc_sql(3))
def evc_k_iterations(spark, sf):
    return A.eigenvector_steps(A.adjacency(V.geo(spark, sf)), 3).select("node", F.round("evc", 6).alias("evc"))


@query()
def eigenvector_centrality(spark, sf):
    return A.eigenvector(A.adjacency(V.geo(spark, sf))).select("node", F.round("evc", 6).alias("evc"))


@query("""WITH d AS (SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS leaves FROM nation)
SELECT 'n:' || k AS node, leaves::DOUBLE AS betweenness FROM d WHERE leaves > 0 UNION ALL SELECT 'r:' || n_regionkey, 0.0 FROM nation GROUP BY 1 UNION ALL SELECT 'c:' || c_custkey, 0.0 FROM customer UNION ALL SELECT 's:' || s_suppkey, 0.0 FROM supplier""")
def betweenness(spark, sf):
    return A.betweenness(A.adjacency(V.geo(spark, sf), [1])).select("node", F.round("betweenness", 6).alias("betweenness"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT a.event_type AS src, b.event_type AS dst FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) a JOIN events b ON b.event_id = a.nxt),
walk AS (SELECT src AS root, dst AS tip, [src] AS path FROM t WHERE dst >= src UNION ALL SELECT root, t.dst, list_append(path, tip) FROM walk JOIN t ON t.src = tip WHERE tip <> root AND t.dst >= root AND NOT list_contains(path, tip))
SELECT array_to_string(path, '>') AS cycle FROM walk WHERE tip = root""")
def cycles_bounded(spark, sf):
    from pyspark.sql import Window

    e = read(spark, sf, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    adj = e.select(F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null").distinct()
    return A.cycles(adj, 5).select(F.array_join("cycle", ">").alias("cycle"))


@query(f"WITH {GEO} SELECT DISTINCT a.src, b.dst FROM geo a JOIN geo b ON b.src = a.dst AND b.arr = 1 WHERE a.arr = 1 AND a.src <> b.dst")
def closures(spark, sf):
    rules = spark.createDataFrame([(1, 1, 9, 6)], "first int, second int, result int, stindex tinyint")
    return A.closures(V.geo(spark, sf), rules).select("src", "dst")


@query("SELECT DISTINCT 'p:' || a.p_partkey AS src, 'p:' || b.p_partkey AS dst FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey")
def closeness(spark, sf):
    p = read(spark, sf, "part")
    near = p.select(*V.link(F.concat_ws("/", "p_name", "p_brand"), V.key("p", "p_partkey"), 4, 1, F.col("p_partkey")))
    return A.closeness(near).select("src", "dst")


@query("WITH t AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)), v AS (SELECT w, lower(w) AS k FROM t) SELECT a.w AS a, b.w AS b FROM v a JOIN v b ON a.k = b.k AND a.w <> b.w")
def caps_variants(spark, sf):
    w = read(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("text")).distinct()
    nodes = w.withColumn("class", S.n_channel(F.col("text"))).withColumn("nid", F.col("text"))
    return A.caps_variants(nodes)


@query(f"WITH {GEO} SELECT src AS node, false AS e, true AS t, false AS c FROM geo GROUP BY 1 UNION ALL (WITH {EVT} SELECT src, true, false, false FROM evt GROUP BY 1) UNION ALL SELECT 'u:' || user_id, false, true, true FROM events GROUP BY 1")
def etc_types(spark, sf):
    u = V.ctx_links(spark, sf).where("stindex = 7")
    return A.infer_types(V.geo(spark, sf)).unionByName(A.infer_types(V.evt(spark, sf))).unionByName(A.infer_types(u))


@query(f"WITH {GEO} SELECT src AS node, 'an event without links of order' AS warnings FROM geo GROUP BY 1")
def etc_warnings(spark, sf):
    links = V.geo(spark, sf)
    types = A.infer_types(links).withColumn("e", F.lit(True))
    return A.type_warnings(types, links).select("node", F.array_join("warnings", ";").alias("warnings"))


# Matrices: r is a nation's region, c its key modulo 7, v its number of customers


_M = "m AS (SELECT n_regionkey AS r, n_nationkey % 5 AS c, count(*)::DOUBLE AS v FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)"


def _matrix(spark, sf):
    n, c = read(spark, sf, "nation"), read(spark, sf, "customer")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r"), (F.col("n_nationkey") % 5).alias("c")).agg(F.count("*").cast("double").alias("v"))


@query(f"WITH {_M} SELECT a.r::BIGINT AS r, b.c::BIGINT AS c, sum(a.v * b.v) AS v, string_agg(a.r || '*' || a.c || b.r || '*' || b.c, '' ORDER BY a.c) AS s FROM m a JOIN m b ON b.r = a.c GROUP BY ALL")
def symbolic_matrix(spark, sf):
    m = _matrix(spark, sf)
    s = matrix.symbols(m)
    return matrix.symbolic_multiply(m, m, s, s).select(F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "v", "s")


@query(f"WITH {_M} SELECT r::BIGINT AS r, sum(v * 2.0) AS x FROM m GROUP BY 1")
def matrix_vector(spark, sf):
    m = _matrix(spark, sf)
    x = m.select(F.col("c").alias("r")).distinct().withColumn("x", F.lit(2.0))
    return matrix.apply(m, x).select(F.col("r").cast("bigint").alias("r"), "x")


@query(f"WITH {_M} SELECT r::BIGINT AS r, c::BIGINT AS c, sum(v) AS v FROM (SELECT r, c, v FROM m UNION ALL SELECT c, r, v FROM m) GROUP BY ALL")
def matrix_symmetrize(spark, sf):
    return matrix.symmetrize(_matrix(spark, sf)).select(F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "v")


@query(f"WITH {_M} SELECT r::BIGINT AS r, sum(v)::BIGINT AS n FROM m GROUP BY 1")
def sparse_occupancy(spark, sf):
    return matrix.occupancy(_matrix(spark, sf)).select(F.col("r").cast("bigint").alias("r"), "n")


@query(f"WITH {_M} SELECT c::BIGINT AS r, r::BIGINT AS c, v FROM m")
def matrix_transpose(spark, sf):
    return matrix.transpose(_matrix(spark, sf)).select(F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "v")


@query()
def gradient_tops(spark, sf):
    m = matrix.symmetrize(_matrix(spark, sf)).select(F.col("r").cast("int"), F.col("c").cast("int"), "v")
    return matrix.gradient_tops(m, matrix.eigenvector(m))


# Text

_SENT = r"""sent AS (SELECT doc_id, generate_subscripts(s, 1) AS ord, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ':' || chr(10), 'g'), '[\[\]]', '', 'g'), '([!?.])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents))"""
_WORD = _SENT + r""", word AS (SELECT doc_id, ord, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (SELECT doc_id, ord, list_filter(regexp_split_to_array(lower(sentence), '\s+'), lambda x: x <> '') AS w FROM sent))"""


@query(f"WITH {_SENT} SELECT doc_id, ord::BIGINT AS ord, sentence FROM sent")
def sentences(spark, sf):
    return text.sentences(read(spark, sf, "documents")).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "sentence")


@query(f"WITH {_WORD} SELECT doc_id, word, count(*) AS n FROM word GROUP BY ALL")
def vocabulary(spark, sf):
    return text.vocabulary(text.sentences(read(spark, sf, "documents")))


@query(f"WITH {_WORD}, f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, word)::DOUBLE AS n FROM word) SELECT doc_id, ord::BIGINT AS ord, round(sum(CASE WHEN n < 2 THEN 0 ELSE n * length(word) / (1 + exp(n / 45 - 1.0::DOUBLE / 30)) END), 4) AS score FROM f GROUP BY ALL")
def static_score(spark, sf):
    return scores.static_ranks(read(spark, sf, "documents")).select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.round("score", 4).alias("score"))


@query(f"WITH {_WORD}, f AS (SELECT *, lag(ord) OVER (PARTITION BY doc_id, word ORDER BY ord, pos) AS last FROM word) SELECT doc_id, ord::BIGINT AS ord, round(sum(CASE WHEN last IS NULL THEN length(word) ELSE length(word) * (1 - exp(-(ord - last) / 45.0::DOUBLE)) END), 4) AS score FROM f GROUP BY ALL")
def running_score(spark, sf):
    return scores.running_ranks(read(spark, sf, "documents")).select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.round("score", 4).alias("score"))


@query(f"""WITH {_WORD}, f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, word)::DOUBLE AS n FROM word), st AS (SELECT doc_id, ord, round(sum(CASE WHEN n < 2 THEN 0 ELSE n * length(word) / (1 + exp(n / 45 - 1.0::DOUBLE / 30)) END), 6) AS score FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS nth, greatest(1, round_even(count(*) OVER (PARTITION BY doc_id) * 0.25, 0)) AS most FROM st) SELECT doc_id, ord::BIGINT AS ord FROM r WHERE nth <= most""")
def significant_static(spark, sf):
    return scores.top_static(read(spark, sf, "documents"), 25.0).select("doc_id", F.col("ord").cast("bigint").alias("ord"))


def _ngram_sql(source: str) -> str:
    """frag(d, l, sentence, frag, f) and gram(d, l, sentence, frag, i, n, g) of a text expression: quotes by parity, sentence ends by pointers, brackets by recursion."""
    pure = """lower(trim(trim(replace(regexp_replace(regexp_replace({}, '---.*', '', 'g'), '["—“”!?`,.:;()_]+', '', 'g'), '  ', ' '), '-'), ''''))"""
    closer = "CASE c WHEN '(' THEN ')' WHEN '[' THEN ']' WHEN '{' THEN '}' ELSE '' END"
    ends, starts = (", ".join(f"'{x.replace(chr(39), chr(39) * 2)}'" for x in sorted(w)) for w in (text.ENDINGS, text.STARTERS))
    blank = r"[\s\x{a0}\x{85}]+"

    def strip(x: str) -> str:
        return f"regexp_replace({x}, '^{blank}|{blank}$', '', 'g')"

    plain = f"translate({strip('p')}, chr(10) || chr(9) || '“”`’', '  \"\"{chr(39) * 4}')"
    even = "x || repeat('\"', (len(x) - len(replace(x, '\"', ''))) % 2)"
    return rf"""par AS MATERIALIZED (SELECT d, pi, row_number() OVER () AS pid, {strip(plain)} AS s FROM (SELECT doc_id AS d, generate_subscripts(ps, 1) AS pi, unnest(ps) AS p FROM (SELECT doc_id, string_split({source}, chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL))),
sign AS (SELECT pid, pos, c, sum((c = '''')::INT) OVER o % 2 + sum((c = '"')::INT) OVER o % 2 AS open FROM (SELECT pid, generate_subscripts(cs, 1) AS pos, unnest(cs) AS c FROM (SELECT pid, string_split(s, '') AS cs FROM par WHERE strlen(s) >= 100)) WINDOW o AS (PARTITION BY pid ORDER BY pos)),
stop AS MATERIALIZED (SELECT pid, pos, min(pos) OVER (PARTITION BY pid ORDER BY pos RANGE BETWEEN 21 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM (SELECT pid, 0 AS pos FROM par WHERE strlen(s) >= 100 UNION ALL SELECT pid, pos FROM sign WHERE open = 0 AND c IN ('!', '.', '。'))),
hop(pid, pos, nxt) AS (SELECT pid, pos, nxt FROM stop WHERE pos = 0 UNION ALL SELECT s.pid, s.pos, s.nxt FROM hop h JOIN stop s ON s.pid = h.pid AND s.pos = h.nxt),
cutup AS (SELECT d, pi, pid, 0 AS pos, s AS x FROM par WHERE strlen(s) < 100 AND s <> '' UNION ALL SELECT d, pi, pid, pos, CASE WHEN nxt IS NULL THEN substr(s, pos + 1) ELSE substr(s, pos + 1, nxt - pos) END FROM hop JOIN par USING (pid)),
sen AS MATERIALIZED (SELECT d, row_number() OVER () AS sid, row_number() OVER (PARTITION BY d ORDER BY pi, pos) AS sentence, count(*) OVER (PARTITION BY d) AS l, {strip(even)} AS x FROM cutup WHERE x <> '' AND {strip('x')} <> ''),
br AS MATERIALIZED (SELECT sid, row_number() OVER o AS k, pos, c, sum((c = '(')::INT - (c = ')')::INT) OVER o AS d1, sum((c = '[')::INT - (c = ']')::INT) OVER o AS d2, sum((c = '{{')::INT - (c = '}}')::INT) OVER o AS d3
  FROM (SELECT sid, generate_subscripts(cs, 1) AS pos, unnest(cs) AS c FROM (SELECT sid, string_split(x, '') AS cs FROM sen WHERE regexp_matches(x, '[()\[\]{{}}]'))) WHERE c IN ('(', ')', '[', ']', '{{', '}}') WINDOW o AS (PARTITION BY sid ORDER BY pos)),
bal(sid, k, waiting, start, piece) AS (SELECT sid, 0, '', 1, NULL::VARCHAR FROM sen UNION ALL
  SELECT e.sid, e.k, CASE WHEN c IN ('(', '[', '{{') THEN CASE WHEN waiting = '' THEN {closer} ELSE waiting END WHEN done THEN '' ELSE waiting END,
    CASE WHEN c IN ('(', '[', '{{') THEN CASE WHEN waiting = '' THEN pos ELSE start END WHEN done THEN pos + 1 ELSE start END,
    CASE WHEN c IN ('(', '[', '{{') THEN CASE WHEN waiting = '' THEN trim(substr(x, start, pos - start)) END WHEN done THEN substr(x, start, pos - start + 1) END
  FROM (SELECT b.waiting, b.start, e.*, CASE b.waiting WHEN ')' THEN d1 WHEN ']' THEN d2 WHEN '}}' THEN d3 ELSE 0 END = 0 AS done FROM bal b JOIN br e ON e.sid = b.sid AND e.k = b.k + 1) e JOIN sen USING (sid)),
piece AS (SELECT sid, k, piece FROM bal WHERE piece <> '' UNION ALL SELECT sid, 1000000000, trim(substr(x, start)) FROM (SELECT sid, arg_max(start, k) AS start FROM bal GROUP BY sid) JOIN sen USING (sid)),
frags AS (SELECT sid, k, generate_subscripts(fs, 1) AS j, unnest(fs) AS f FROM (SELECT sid, k, CASE WHEN left(piece, 1) || right(piece, 1) IN ('()', '[]', '{{}}') THEN [piece]
  ELSE list_filter(list_transform(regexp_split_to_array(trim(piece), '["—“”!?,:;]+[ \n]'), lambda y: {strip('y')}), lambda y: len(y) > 1) END AS fs FROM piece WHERE piece <> '')),
frag AS MATERIALIZED (SELECT d, l, sentence, row_number() OVER (PARTITION BY sid ORDER BY k, j) - 1 AS frag, f FROM frags JOIN sen USING (sid) WHERE strlen({strip('f')}) > 2),
spelt AS (SELECT *, list_transform(w, lambda y: {pure.format('y')}) AS cw FROM (SELECT *, string_split(f, ' ') AS w FROM frag)),
gram AS MATERIALIZED (SELECT d, l, sentence, frag, i, n, {pure.format("array_to_string(w[i - n + 1:i], ' ')")} AS g FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM spelt), (SELECT unnest([2, 3, 4, 5]) AS n)
  WHERE n <= i AND len(cw[i]) > 2 AND len(cw[i - n + 1]) > 2 AND cw[i] NOT IN ({ends}) AND cw[i - n + 1] NOT IN ({starts}))"""


_GRAM = "WITH RECURSIVE " + _ngram_sql(r"regexp_replace(regexp_replace(text, '<[^>]*>', ':' || chr(10), 'g'), '[\[\]]', '', 'g')")
_STATIC = "CASE WHEN {0} < 2 THEN 0 ELSE {0} * length({1}) / (1 + exp({0} / 45.0::DOUBLE - 1.0::DOUBLE / 30)) END"
_GAP = """, gap AS (SELECT d, n, g, l, count(*) AS occurrences, least(99, min(gap)) AS min_gap, max(gap) AS max_gap FROM (SELECT *, sentence - lag(sentence, 1, 0) OVER (PARTITION BY d, n, g ORDER BY sentence) AS gap FROM gram) GROUP BY ALL)"""
_STRETCH = """, stretch AS (SELECT d, (l // 45 + 1)::INT AS m, n, least(sentence // 45, l // 45)::INT + 1 AS p, g FROM gram GROUP BY ALL)"""
_FAST = _STRETCH + """, fs AS (SELECT s.d, s.m, s.n, s.p, s.g, EXISTS (SELECT 1 FROM stretch t WHERE t.d = s.d AND t.n = s.n AND t.g = s.g AND t.p = s.p + 1) AS slow FROM stretch s WHERE s.p < s.m OR s.m = 1)"""


@query(_GRAM + " SELECT d AS doc_id, n, g AS ngram, count(*)::DOUBLE AS freq, string_agg(sentence, ',' ORDER BY sentence) AS locations FROM gram GROUP BY ALL")
def ngram_frequencies(spark, sf):
    return spans.ngram_table(read(spark, sf, "documents")).withColumn("locations", F.array_join("locations", ","))


@query(_GRAM + _GAP + " SELECT d AS doc_id, n, g AS ngram, occurrences, min_gap::INT AS min_gap, max_gap::INT AS max_gap, l::INT AS l, l < 45 OR occurrences < 2 OR max_gap > min_gap + 45 AS intentional FROM gap")
def ngram_gaps(spark, sf):
    return spans.gaps(read(spark, sf, "documents"))


@query(
    _GRAM
    + _GAP
    + f""", own AS (SELECT d, n, g, count(*) AS freq FROM gram GROUP BY ALL), w AS (SELECT d, n, g, string_split(g, ' ') AS w FROM own), cw AS (SELECT *, list_transform(w, lambda y: lower(trim(trim(replace(regexp_replace(regexp_replace(y, '---.*', '', 'g'), '["—“”!?`,.:;()_]+', '', 'g'), '  ', ' '), '-'), ''''))) AS cw FROM w),
inside AS (SELECT d, n, g, k, lower(trim(trim(replace(array_to_string(w[i - k + 1:i], ' '), '  ', ' '), '-'), '''')) AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM cw), (SELECT unnest([2, 3, 4, 5]) AS k)
  WHERE k <= i AND len(cw[i]) > 2 AND len(cw[i - k + 1]) > 2 AND cw[i] NOT IN ({", ".join(repr(x) if chr(39) not in x else "'it''s'" for x in sorted(text.ENDINGS))}) AND cw[i - k + 1] NOT IN ({", ".join(map(repr, sorted(text.STARTERS)))})),
sig AS (SELECT i.d, i.n, i.g, sum({_STATIC.format("coalesce(o.freq, 0)", "i.x")}) AS score FROM inside i LEFT JOIN own o ON o.d = i.d AND o.n = i.k AND o.g = i.x GROUP BY ALL),
r AS (SELECT d, n, CASE WHEN l < 45 OR occurrences < 2 OR max_gap > min_gap + 45 THEN 'intent' ELSE 'context' END AS kind, g, coalesce(score, 0) AS score FROM gap LEFT JOIN sig USING (d, n, g))
SELECT d AS doc_id, n, kind, g AS ngram, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY d, n, kind ORDER BY round(score, 6) DESC, g)::INT AS rank FROM r) WHERE rank <= CASE n WHEN 2 THEN 0 WHEN 5 THEN 45 ELSE 150 END"""
)
def ngram_anomalies(spark, sf):
    return spans.anomalies(read(spark, sf, "documents")).withColumn("score", F.round("score", 4))


@query(_GRAM + _FAST + " SELECT d AS doc_id, n, p, g AS ngram, slow FROM fs")
def fast_slow(spark, sf):
    return spans.fast_slow(read(spark, sf, "documents"))


@query(
    _GRAM
    + _STRETCH
    + """, pair AS (SELECT a.d, a.m, a.n, a.g, sum((EXISTS (SELECT 1 FROM stretch b WHERE b.d = a.d AND b.n = a.n AND b.g = a.g AND b.p = q.q))::INT) AS shared, count(*) AS n_pairs FROM stretch a, (SELECT unnest(range(1, 4000)) AS q) q WHERE q.q > a.p AND q.q <= a.m GROUP BY ALL)
SELECT d AS doc_id, n, g AS ngram, 1::BIGINT AS overlap, 0::BIGINT AS condensate FROM stretch WHERE m < 2
UNION ALL SELECT d, n, g, shared::BIGINT, CASE WHEN shared > 0 THEN 0 ELSE n_pairs END FROM pair"""
)
def coactivation(spark, sf):
    return spans.coactivation(read(spark, sf, "documents"))


@query(
    _GRAM
    + _FAST
    + f""", own AS (SELECT d, n, g, count(*) AS freq FROM gram GROUP BY ALL), sc AS (SELECT *, {_STATIC.format("freq", "g")} AS score, CASE WHEN slow THEN 'slow' ELSE 'fast' END AS kind FROM fs JOIN own USING (d, n, g)),
part AS MATERIALIZED (SELECT * FROM (SELECT d, p, n, kind, g, score, row_number() OVER (PARTITION BY d, p, n, kind ORDER BY round(score, 6) DESC, g) AS rank FROM sc) WHERE rank <= 15),
sel AS (SELECT d, f FROM frag WHERE sentence = 1), whole AS (SELECT d, n, max(kind) AS kind, g, any_value(score) AS score FROM part p WHERE score > 1 AND NOT EXISTS (SELECT 1 FROM sel WHERE sel.d = p.d AND NOT contains(sel.f, p.g)) GROUP BY d, n, g)
SELECT d AS doc_id, p, n, kind, g AS ngram, round(score, 4) AS score, rank::INT AS rank FROM part
UNION ALL SELECT * FROM (SELECT d, 0, n, kind, g, round(score, 4), row_number() OVER (PARTITION BY d, n, kind ORDER BY round(score, 6) DESC, g)::INT AS rank FROM whole) WHERE rank <= 15"""
)
def intentional_tokens(spark, sf):
    """The fragments of the first sentence are the selected ones."""
    return spans.intentional_tokens(read(spark, sf, "documents")).withColumn("score", F.round("score", 4))


@query(
    "WITH RECURSIVE "
    + _ngram_sql("text")
    + """, t AS (SELECT d, sentence, frag, row_number() OVER (PARTITION BY d ORDER BY sentence, frag) AS ord FROM frag), o AS (SELECT t.ord, gram.*, i * 10 + n AS pos FROM gram JOIN t USING (d, sentence, frag)),
seen AS (SELECT *, lag(ord) OVER (PARTITION BY d, n, g ORDER BY ord, pos) AS last FROM o), new AS (SELECT d, ord, max(pos) FILTER (last IS NULL) AS new FROM seen GROUP BY ALL),
sc AS (SELECT d, ord, sum(CASE WHEN last IS NULL THEN length(g) ELSE length(g) * (1 - exp(-(ord - last) / 45.0::DOUBLE)) END) AS score FROM seen JOIN new USING (d, ord) WHERE new IS NULL OR pos >= new GROUP BY ALL)
SELECT d AS doc_id, ord::INT AS ord, round(coalesce(score, 0), 4) AS score FROM t LEFT JOIN sc USING (d, ord)"""
)
def running_ngrams(spark, sf):
    return spans.running_scores(read(spark, sf, "documents")).withColumn("score", F.round("score", 4))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', ':' || chr(10), 'g'), '[\[\]]', '', 'g') AS text FROM pages")
def clean_html(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.clean(F.col("html")).alias("text"))


@query()
def entities(spark, sf):
    return text.entities(read(spark, sf, "documents"))


@query()
def suggested_links(spark, sf):
    return text.suggested_links(read(spark, sf, "documents"))


# Logs, context and time


@query("SELECT event_id, json_extract_string(props, '$.k') AS message, 'INFO' AS level FROM events")
def log_parse_json(spark, sf):
    from processgraph.sources.importers import json_line

    fields = {"timestamp": "ts", "message": "k", "level": "lvl", "source": "src"}
    e = read(spark, sf, "events").select("event_id", json_line(F.col("props"), fields).alias("e"))
    return e.select("event_id", "e.message", "e.level")


_LINE = "strftime(ts, '%b %d %H:%M:%S') || ' host' || (user_id % 3) || ' ' || event_type || '[' || user_id || ']: event ' || event_id"


@query("SELECT event_id AS ord, strftime(ts, '%b %d %H:%M:%S') AS timestamp, 'host' || (user_id % 3) AS source, event_type AS service, user_id::VARCHAR AS pid, 'event ' || event_id AS message FROM events")
def log_parse_syslog(spark, sf):
    from processgraph.sources.importers import syslog

    own = _log_lines(spark, sf).select("ord", syslog(F.col("line")).alias("e"))
    return own.select("ord", "e.timestamp", "e.source", "e.service", "e.pid", "e.message")


@query("SELECT 'event ' || event_id AS src, 'event ' || nxt AS dst FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NOT NULL")
def log_chain(spark, sf):
    from processgraph.sources.importers import LogConfig, log_graph

    _, edges = log_graph(_log_lines(spark, sf), LogConfig(), by="user_id")
    return edges.where("arrow = 'then'").select("src", "dst")


def _log_lines(spark, sf):
    u, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    line = F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host"), (F.col("user_id") % 3).cast("string"), F.lit(" "), "event_type", F.lit("["), u, F.lit("]: event "), e)
    return read(spark, sf, "events").select(F.col("event_id").alias("ord"), "user_id", line.alias("line"))


@query("""WITH s AS (SELECT event_type || ':' || user_id AS token, floor(epoch(ts))::BIGINT AS ts, event_id AS id FROM events), g AS (SELECT *, coalesce(ts - lag(ts) OVER w, 0) AS gap FROM s WINDOW w AS (PARTITION BY token ORDER BY ts, id)),
f AS (SELECT *, coalesce(lag(CASE WHEN gap > 10800 THEN 1 ELSE 0 END) OVER w, 0) AS fall FROM g WINDOW w AS (PARTITION BY token ORDER BY ts, id)), l AS (SELECT *, sum(fall) OVER (PARTITION BY token ORDER BY ts, id) AS life FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY token, life ORDER BY ts, id) AS freq FROM l)
SELECT token, id, freq, CASE WHEN freq = 1 THEN 0 ELSE gap END AS delta, CASE WHEN freq = 1 THEN 'intentional' ELSE 'ambient' END AS kind, (CASE WHEN freq = 1 THEN 0 ELSE gap END) <= 10800 AS active FROM n""")
def stm_classify(spark, sf):
    tokens = read(spark, sf, "events").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("token"), V.seconds().alias("ts"), F.col("event_id").alias("id"))
    return C.memory(tokens).select("token", "id", F.col("freq").cast("bigint").alias("freq"), "delta", "kind", "active")


def _seen(spark, sf):
    return read(spark, sf, "events").select(F.col("user_id").cast("string").alias("section"), V.seconds().alias("ts"))


@query("SELECT user_id::VARCHAR AS section, min(floor(epoch(ts))::BIGINT) AS first, max(floor(epoch(ts))::BIGINT) AS last, count(*) AS freq, round(CASE WHEN count(*) > 1 THEN (max(floor(epoch(ts))::BIGINT) - min(floor(epoch(ts))::BIGINT)) / (count(*) - 1) ELSE 0 END, 6) AS pdelta FROM events GROUP BY 1")
def last_seen(spark, sf):
    return C.last_seen(_seen(spark, sf)).withColumn("pdelta", F.round("pdelta", 6))


@query("SELECT user_id::VARCHAR AS section FROM events GROUP BY 1 HAVING 1706658000 - max(floor(epoch(ts))::BIGINT) < 5 * 3600")
def newly_seen(spark, sf):
    return C.newly_seen(_seen(spark, sf), 1_706_658_000, 5)


@query("""SELECT event_id, CASE WHEN month(ts) IN (12, 1, 2) THEN 'N_Winter, S_Summer' WHEN month(ts) < 6 THEN 'N_Spring, S_Autumn' WHEN month(ts) < 9 THEN 'N_Summer, S_Winter' ELSE 'N_Autumn, S_Spring' END || ', ' || ['Night', 'Morning', 'Afternoon', 'Evening'][hour(ts) // 6 + 1] || ', ' || dayname(ts) || ', Day' || day(ts) || ', ' || monthname(ts) || ', Yr' || year(ts) || strftime(ts, ', Hr%H, Qu') || (minute(ts) // 15 + 1) AS meaning,
left(dayname(ts), 3) || strftime(ts, ':Hr%H:Qu') || (minute(ts) // 15 + 1) || '-Min' || printf('%02d_%02d', minute(ts) // 5 * 5, (minute(ts) // 5 * 5 + 5) % 60) AS key FROM events""")
def semantic_time(spark, sf):
    return read(spark, sf, "events").select("event_id", S.semantic_time(F.col("ts")).alias("meaning"), S.time_key(F.col("ts")).alias("key"))


def _clusters(spark, sf):
    own = read(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("event_type", F.lit("-"), F.date_format("ts", "EEEE")))), ", ").alias("context"))
    return own


_CLUSTER = "cl AS (SELECT user_id, string_agg(t, ', ' ORDER BY t) AS context FROM (SELECT DISTINCT user_id, event_type || '-' || dayname(ts) AS t FROM events) GROUP BY 1)"


@query(f"WITH {_CLUSTER}, s AS (SELECT unnest(string_split(context, ', ')) AS token FROM cl) SELECT token, count(*) AS n, CASE WHEN count(*) < 3 THEN 'intentional' ELSE 'ambient' END AS kind FROM s GROUP BY 1")
def context_spectrum(spark, sf):
    return C.intent(C.spectrum(_clusters(spark, sf)))


@query("""WITH p AS (SELECT DISTINCT p_brand AS b, p_type AS t FROM part), c AS (SELECT b, list(t ORDER BY t) AS ts FROM p GROUP BY 1)
SELECT x.b AS a, y.b AS b, list_aggregate(list_sort(list_intersect(x.ts, y.ts)), 'string_agg', ',') AS shared FROM c x JOIN c y ON x.b < y.b AND len(list_intersect(x.ts, y.ts)) > 0""")
def context_overlap(spark, sf):
    c = read(spark, sf, "part").groupBy(F.col("p_brand").alias("b")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ", ").alias("context"))
    pair = c.alias("x").join(c.alias("y"), F.col("x.b") < F.col("y.b")).select(F.col("x.b").alias("a"), F.col("y.b").alias("b"), C.diff_clusters(F.col("x.context"), F.col("y.context"))["shared"].alias("shared"))
    return pair.where("shared <> ''")


# Interchange and layout


def _enc(c: str) -> str:
    return f"replace({c}, ' ', '_')"


@query(f"""WITH {GEO}, {GEO_NODES}, u AS (SELECT nid, text, chapter, 'http://example.org/graph/node/' || replace(url_encode({_enc('text')}), '*', '%2A') AS uri FROM nodes), v AS (SELECT 'http://example.org/graph/vocab#' AS b)
SELECT uri AS subject, '{RDF_TYPE}' AS predicate, b || 'Node' AS object FROM u, v UNION ALL SELECT uri, '{RDF_LABEL}', text FROM u UNION ALL SELECT uri, b || 'chapter', 'http://example.org/graph/chapter/' || chapter FROM u, v
UNION ALL SELECT a.uri, b || CASE arr WHEN 1 THEN 'contain' ELSE 'belong' END, c.uri FROM v, geo JOIN u a ON a.nid = src JOIN u c ON c.nid = dst
UNION ALL SELECT b || CASE arr WHEN 1 THEN 'contain' ELSE 'belong' END, '{RDF_TYPE}', b || 'Contains' FROM v, geo JOIN u a ON a.nid = src JOIN u c ON c.nid = dst
UNION ALL SELECT b || CASE arr WHEN 1 THEN 'contain' ELSE 'belong' END, '{RDF_LABEL}', CASE arr WHEN 1 THEN 'contain' ELSE 'belong' END FROM v, geo JOIN u a ON a.nid = src JOIN u c ON c.nid = dst""")
def rdf_triples(spark, sf):
    from processgraph.sources.rdf import triples

    return triples(_exported(spark, sf))


def _exported(spark, sf):
    """GEO as a graph."""
    from processgraph.graph import Graph
    from processgraph.registry import Registry

    r = Registry()
    r.pair("contains", "contain", "contains", "belong", "belongs to")
    nodes = V.geo_nodes(spark, sf).withColumn("len", F.length("text")).withColumn("ord", F.col("cptr"))
    return Graph(spark, r, nodes, V.geo(spark, sf), nodes.select("chapter").distinct(), spark.createDataFrame([], "chapter string"))


@query(f"""WITH {GEO}, {GEO_NODES}, u AS (SELECT * FROM nodes) SELECT '"' || text || '" <x:contain> "' || d || '" .' AS line FROM (SELECT a.text, c.text AS d FROM geo JOIN u a ON a.nid = src JOIN u c ON c.nid = dst WHERE arr = 1)""")
def turtle_lines(spark, sf):
    from processgraph.sources.rdf import turtle_lines as lines

    named = _exported(spark, sf).named_links().where("arr = 1")
    t = named.select(F.col("src_text").alias("subject"), F.lit("x://contain").alias("predicate"), F.col("dst_text").alias("object"))
    return lines(t).select(F.replace("line", F.lit("x://"), F.lit("x:")).alias("line"))


@query(f"""WITH {GEO}, {GEO_NODES}, u AS (SELECT * REPLACE (len(string_split(text, ' ')) AS class), 'n' || len(string_split(text, ' ')) || '_' || cptr AS id FROM nodes) SELECT '  ' || id || ' [label="' || text || '"];' AS line FROM u UNION ALL SELECT '  ' || a.id || ' -> ' || c.id || ' [label="contain", color=green];' FROM geo JOIN u a ON a.nid = src JOIN u c ON c.nid = dst WHERE arr = 1""")
def dot_lines(spark, sf):
    from processgraph.sources.rdf import dot_lines as lines

    return lines(_exported(spark, sf)).select("line")


@query("SELECT 'conversation ' || conv_id AS chapter, turn::BIGINT AS line FROM conversations WHERE role = 'user' ORDER BY chapter, line LIMIT 60 OFFSET 60")
def pagemap_page(spark, sf):
    return C.page(V.pagemap(spark, sf), "CONVERSATION", 1, 2).select("chapter", F.col("line").cast("bigint").alias("line"))


@query("SELECT 'conversation ' || conv_id AS chapter, string_agg(CASE role WHEN 'user' THEN 'user' ELSE 'other' END, ',' ORDER BY turn, role) AS contexts FROM conversations GROUP BY conv_id ORDER BY chapter LIMIT 100")
def contents(spark, sf):
    names = spark.createDataFrame([(1, "user"), (2, "other")], "ptr int, context string")
    return C.contents(V.pagemap(spark, sf), names).select("chapter", F.array_join("contexts", ",").alias("contexts"))


@query("""WITH a AS (SELECT n_nationkey AS n, asin(greatest(-1.0, least(1.0, 2.0::DOUBLE * n_nationkey / (2.0 * 25 + 1)))) AS lat, 2 * pi() * n_nationkey / 1.618::DOUBLE AS l FROM nation), b AS (SELECT n, lat, CASE WHEN l < -pi() THEN l + 2 * pi() WHEN l > pi() THEN l - 2 * pi() ELSE l END AS lon FROM a)
SELECT n::BIGINT AS n, round(-0.75 * sin(lon), 6) + 0.0 AS x, round(0.75 * sin(lat), 6) + 0.0 AS y, round(0.75 * cos(lon) * cos(lat), 6) + 0.0 AS z FROM b""")
def chapter_coords(spark, sf):
    c = layout.chapter_coordinates(F.col("n_nationkey"), F.lit(25))
    return read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"), *[(F.round(c[k], 6) + 0.0).alias(k) for k in "xyz"])


@query(f"""WITH {GEO}, p AS (SELECT dst AS node, 1 AS depth, row_number() OVER (ORDER BY ord) AS slot, count(*) OVER () AS n FROM geo WHERE src = 'r:1' AND stindex = 6),
q AS (SELECT b.dst AS node, 2 AS depth, row_number() OVER (ORDER BY a.ord, b.ord) AS slot, count(*) OVER () AS n FROM geo a JOIN geo b ON b.src = a.dst AND b.stindex = 6 WHERE a.src = 'r:1' AND a.stindex = 6)
SELECT node, round(-1.0 + 2.0::DOUBLE / (n + 1) * slot, 6) AS x, -1.0::DOUBLE + (depth - 1) AS z FROM (SELECT * FROM p UNION ALL SELECT * FROM q)""")
def cone_coords(spark, sf):
    out = layout.cone_coordinates(paths.forward_cone(V.geo(spark, sf), "r:1", 2, None))
    return out.select("node", F.round("x", 6).alias("x"), F.col("z").cast("double").alias("z"))


# Notes


_NOTE = "- trade\n\n :: %s ::\n\n %s (note) %s\n %s (then) %s\n"


@query("SELECT n_nationkey::BIGINT AS id, 3 AS nodes, 2 AS links, 0 AS errors FROM nation")
def notes_compile(spark, sf):
    from processgraph.registry import Registry
    from processgraph.sources.notes import parse_files

    r = Registry.standard()
    r.pair("properties", "note", "is noted as", "isnote", "is a note for")
    n = read(spark, sf, "nation")
    text_ = F.format_string(_NOTE, F.lit("any"), "n_name", F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")), "n_name", F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))
    rows = parse_files(n.select(F.col("n_nationkey").cast("string").alias("path"), text_.alias("content")), r)
    count = lambda kind: F.sum((F.col("kind") == kind).cast("int")).cast("int")
    return rows.groupBy(F.col("path").cast("bigint").alias("id")).agg(count("node").alias("nodes"), count("link").alias("links"), count("error").alias("errors"))


from processgraph.plans import built  # noqa: E402,F401  its queries join the others
