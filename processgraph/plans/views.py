"""Graphs over the driver tables, as DataFrames and as the same SQL.

GEO: region contains nation contains customer and supplier. EVT: each user's events in order. ORD: each
customer's orders in order. SUP: part leads to supplier with the quantity as weight. CTX: users express
events in the context "type,weekday". Node keys are texts such as n:3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = 500_000
COLUMNS = ("src", "stindex", "ord", "arr", "wgt", "ctx", "dst")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def link(src, dst, stindex: int, arr: int, order, wgt=1.0, ctx=0) -> list:
    cols = {"src": src, "stindex": F.lit(stindex).cast("tinyint"), "ord": order.cast("bigint"), "arr": F.lit(arr), "wgt": F.lit(wgt).cast("float") if not hasattr(wgt, "cast") else wgt.cast("float"), "ctx": F.lit(ctx) if not hasattr(ctx, "cast") else ctx.cast("int"), "dst": dst}
    return [cols[c].alias(c) for c in COLUMNS]


def both(df: DataFrame, src, dst, stindex: int, arr: int, order, wgt=1.0, ctx=0) -> DataFrame:
    """Each row as a link and its inverse, in one pass."""
    one, two = F.struct(*link(src, dst, stindex, arr, order, wgt, ctx)), F.struct(*link(dst, src, 8 - stindex, arr + 1, order, wgt, ctx))
    return df.select(F.explode(F.array(one, two)).alias("x")).select("x.*")


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def geo(spark: SparkSession, sf: str) -> DataFrame:
    n, c, s = (read(spark, sf, t) for t in ("nation", "customer", "supplier"))
    out = both(n, key("r", "n_regionkey"), key("n", "n_nationkey"), 6, 1, F.col("n_nationkey"))
    out = out.unionByName(both(c, key("n", "c_nationkey"), key("c", "c_custkey"), 6, 1, F.col("c_custkey")))
    return out.unionByName(both(s, key("n", "s_nationkey"), key("s", "s_suppkey"), 6, 1, F.col("s_suppkey") + 1_000_000_000_000))


GEO = """geo AS (
  SELECT 'r:' || n_regionkey AS src, 6 AS stindex, n_nationkey::BIGINT AS ord, 1 AS arr, 'n:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n:' || n_nationkey, 2, n_nationkey, 2, 'r:' || n_regionkey FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 6, c_custkey, 1, 'c:' || c_custkey FROM customer
  UNION ALL SELECT 'c:' || c_custkey, 2, c_custkey, 2, 'n:' || c_nationkey FROM customer
  UNION ALL SELECT 'n:' || s_nationkey, 6, s_suppkey + 1000000000000, 1, 's:' || s_suppkey FROM supplier
  UNION ALL SELECT 's:' || s_suppkey, 2, s_suppkey + 1000000000000, 2, 'n:' || s_nationkey FROM supplier)"""


def geo_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """nodes with texts for GEO: nid is the key, cptr the table's key."""
    from processgraph.functions.scalars import n_channel

    parts = [("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name")]
    out = None
    for table, p, k, name in parts:
        own = read(spark, sf, table).select(key(p, k).alias("nid"), n_channel(F.col(name)).alias("class"), F.col(k).cast("bigint").alias("cptr"), F.col(name).alias("text"), F.lit(table).alias("chapter"), F.lit(False).alias("seq"))
        out = own if out is None else out.unionByName(own)
    return out


GEO_NODES = """nodes AS (
  SELECT 'r:' || r_regionkey AS nid, 1 AS class, r_regionkey::BIGINT AS cptr, r_name AS text, 'region' AS chapter FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 1, n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 1, c_custkey, c_name, 'customer' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 1, s_suppkey, s_name, 'supplier' FROM supplier)"""


def chain(df: DataFrame, by: str, order: list[str], node) -> DataFrame:
    nxt = F.lead(node).over(Window.partitionBy(by).orderBy(*order))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    own = df.select(node.alias("a"), nxt.alias("b"), nth.alias("n"))
    return both(own.where("b is not null"), F.col("a"), F.col("b"), 5, 3, F.col("n"))


def evt(spark: SparkSession, sf: str) -> DataFrame:
    return chain(read(spark, sf, "events"), "user_id", ["ts", "event_id"], key("e", "event_id"))


EVT = """chained AS (SELECT 'e:' || event_id AS a, lead('e:' || event_id) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
evt AS (SELECT a AS src, 5 AS stindex, n AS ord, 3 AS arr, b AS dst FROM chained WHERE b IS NOT NULL UNION ALL SELECT b, 3, n, 4, a FROM chained WHERE b IS NOT NULL)"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return chain(read(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], key("o", "o_orderkey"))


ORD = """chained AS (SELECT 'o:' || o_orderkey AS a, lead('o:' || o_orderkey) OVER w AS b, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
ords AS (SELECT a AS src, 5 AS stindex, n AS ord, 3 AS arr, b AS dst FROM chained WHERE b IS NOT NULL UNION ALL SELECT b, 3, n, 4, a FROM chained WHERE b IS NOT NULL)"""


def tasks(df: DataFrame) -> int | None:
    """How many tasks keep to ROWS rows each, if these are more than the session says."""
    n = -(-df.count() // ROWS)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def sup(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "lineitem")
    by, n = ("l_partkey", "l_suppkey"), tasks(own)
    # dealt out first: hardly two rows of a file have the same pair, and a task would hold all pairs of its part of the file
    own = (own.repartition(n, *by) if n else own.repartition(*by)).groupBy(*by).agg(F.sum("l_quantity").alias("q"))
    return both(own, key("p", "l_partkey"), key("s", "l_suppkey"), 5, 3, F.col("l_suppkey"), F.col("q"))


SUP = """supplied AS (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
sup AS (SELECT 'p:' || p AS src, 5 AS stindex, s AS ord, 3 AS arr, q AS wgt, 's:' || s AS dst FROM supplied UNION ALL SELECT 's:' || s, 3, s, 4, q, 'p:' || p FROM supplied)"""

TYPES = ["click", "error", "purchase", "signup", "view"]
WEEKDAYS = ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]


def contexts(spark: SparkSession) -> DataFrame:
    """(ptr, context, labels) of all event types and weekdays."""
    rows = [(k, f"{t},{d}", [t, d]) for k, (t, d) in enumerate([(t, d) for t in TYPES for d in WEEKDAYS], 1)]
    return spark.createDataFrame(rows, "ptr int, context string, labels array<string>")


def ctx_links(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    t = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type"))
    d = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.date_format("ts", "EEEE"))
    return both(e, key("u", "user_id"), key("e", "event_id"), 7, 5, F.col("event_id"), F.col("value"), (t - 1) * 7 + d)


CTX = """ctx AS (SELECT 'u:' || user_id AS src, 7 AS stindex, event_id AS ord, 'e:' || event_id AS dst, value::FLOAT AS wgt, event_type || ',' || dayname(ts) AS context FROM events
  UNION ALL SELECT 'e:' || event_id, 1, event_id, 'u:' || user_id, value::FLOAT, event_type || ',' || dayname(ts) FROM events)"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    """One node a user: its text is the user's commonest event types and its number."""
    own = read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return own.select(key("u", "user_id").alias("nid"), F.lit(2).alias("class"), F.col("user_id").cast("bigint").alias("cptr"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("text"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("chapter"), F.lit(False).alias("seq"))


USERS = """users AS (SELECT DISTINCT 'u:' || user_id AS nid, 2 AS class, user_id AS cptr, 'user ' || user_id AS text, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS chapter FROM events)"""


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as nodes: the name is the text, the brand the chapter."""
    from processgraph.functions.scalars import n_channel

    return read(spark, sf, "part").select(F.col("p_partkey").alias("nid"), n_channel(F.col("p_name")).alias("class"), F.col("p_partkey").alias("cptr"), F.col("p_name").alias("text"), F.col("p_brand").alias("chapter"), (F.col("p_size") > 25).alias("seq"))


def pagemap(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as pages: a chapter each, a line a turn."""
    own = read(spark, sf, "conversations")
    none = F.expr("array(named_struct('arr', 0, 'wgt', 1.0f, 'ctx', 0, 'dst', conv_id * 1000 + turn))")
    return own.select(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("chapter"), F.col("role").alias("alias"), F.when(F.col("role") == "user", 1).otherwise(2).alias("ctx"), F.col("turn").cast("int").alias("line"), none.alias("path"))


def seconds(column: str = "ts"):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")
