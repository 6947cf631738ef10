"""Short-term memory of context tokens, session tracking, context spectra and page maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORGOTTEN, PAGE, INTENT_LIMIT = 10_800, 60, 3


def memory(tokens: DataFrame, forgotten: int = FORGOTTEN) -> DataFrame:
    """(token, ts, id, freq, delta, kind, active) for each sight of a token: first intended, then ambient.

    tokens have (token, ts, id), ts in seconds; id orders equal times. A token whose last two sights lie
    further apart than `forgotten` is dropped; its next sight is a first one again.
    """
    by = Window.partitionBy("token").orderBy("ts", "id")
    own = tokens.where("token <> '' and token <> '%%'").withColumn("gap", F.coalesce(F.col("ts") - F.lag("ts").over(by), F.lit(0)))
    long = F.when(F.col("gap") > forgotten, 1).otherwise(0)
    # a dropped token starts again at the sight after the gap's one
    own = own.withColumn("fall", F.coalesce(F.lag(long).over(by), F.lit(0)))
    own = own.withColumn("life", F.sum("fall").over(by))
    life = Window.partitionBy("token", "life").orderBy("ts", "id")
    own = own.withColumn("freq", F.row_number().over(life))
    delta = F.when(F.col("freq") == 1, 0).otherwise(F.col("gap"))
    out = own.withColumn("delta", delta.cast("bigint"))
    return out.select("token", "ts", "id", "freq", "delta", F.when(F.col("freq") == 1, "intentional").otherwise("ambient").alias("kind"), (F.col("delta") <= forgotten).alias("active"))


def last_seen(seen: DataFrame) -> DataFrame:
    """(section, first, last, freq, pdelta): the mean gap between sights; 0 for one. seen has (section, ts)."""
    own = seen.groupBy("section").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("freq"))
    return own.withColumn("pdelta", F.when(F.col("freq") > 1, (F.col("last") - F.col("first")) / (F.col("freq") - 1)).otherwise(0.0))


def since(seen: DataFrame, now: int) -> DataFrame:
    return last_seen(seen).withColumn("ndelta", F.lit(now) - F.col("last"))


def newly_seen(seen: DataFrame, now: int, hours: int) -> DataFrame:
    """Sections seen within so many hours; 0 or less means all."""
    own = last_seen(seen)
    return (own.where(F.lit(now) - F.col("last") < hours * 3600) if hours > 0 else own).select("section")


def spectrum(contexts: DataFrame, separator: str = ", ") -> DataFrame:
    """(token, n) over context strings."""
    parts = F.filter(F.transform(F.split("context", separator), F.trim), lambda x: x != "")
    return contexts.select(F.explode(parts).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def intent(spec: DataFrame) -> DataFrame:
    return spec.withColumn("kind", F.when(F.col("n") < INTENT_LIMIT, "intentional").otherwise("ambient"))


def diff_clusters(a: Column, b: Column, separator: str = ", ") -> Column:
    """struct(shared, different) of two context strings, each sorted and joined by commas."""
    x, y = (F.array_distinct(F.filter(F.transform(F.split(c, separator), F.trim), lambda t: t != "")) for c in (a, b))
    shared, different = F.array_intersect(x, y), F.array_union(F.array_except(x, y), F.array_except(y, x))
    return F.struct(F.array_join(F.array_sort(shared), ",").alias("shared"), F.array_join(F.array_sort(different), ",").alias("different"))


def overlaps(clusters: DataFrame, separator: str = ", ") -> DataFrame:
    """(a, b, shared, different) for each pair of distinct cluster strings that share a token, a before b."""
    own = clusters.select("context").distinct()
    parts = own.select("context", F.explode(F.array_distinct(F.transform(F.split("context", separator), F.trim))).alias("token")).where("token <> ''")
    pairs = parts.select(F.col("context").alias("a"), "token").join(parts.select(F.col("context").alias("b"), "token"), "token").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("d", diff_clusters(F.col("a"), F.col("b"), separator)).select("a", "b", "d.shared", "d.different")


def prune_intentional(clusters: DataFrame, spec: DataFrame, separator: str = ", ") -> DataFrame:
    """Cluster strings without their intended tokens; empty ones go."""
    parts = clusters.select("context", F.posexplode(F.transform(F.split("context", separator), F.trim)).alias("i", "token")).where("token <> ''")
    kept = parts.join(intent(spec).where("kind = 'ambient'").select("token"), "token", "left_semi")
    return kept.groupBy("context").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), separator).alias("pruned"))


def page(pagemap: DataFrame, chapter: str = "", ctx: int | None = None, number: int = 0, size: int = PAGE) -> DataFrame:
    """Lines of chapters with the term inside (without case), of one context, in order; page 0 is all."""
    own = pagemap
    if chapter and chapter not in ("any", "%%"):
        own = own.where(F.contains(F.lower("chapter"), F.lit(chapter.lower())))
    if ctx is not None:
        own = own.where(F.col("ctx") == ctx)
    own = own.orderBy("chapter", "line")
    return own.offset(size * (number - 1)).limit(size) if number > 0 else own


def contents(pagemap: DataFrame, contexts: DataFrame, chapter: str = "any", limit: int = 100) -> DataFrame:
    """(chapter, contexts): each chapter's contexts in the order of its lines."""
    from processgraph.functions.scalars import split_chapters

    own = pagemap.join(F.broadcast(contexts.select(F.col("ptr").alias("ctx"), "context")), "ctx", "left").select(F.explode(split_chapters(F.col("chapter"))).alias("chapter"), "line", F.coalesce("context", F.lit("")).alias("context"))
    if chapter and chapter not in ("any", "%%"):
        own = own.where(F.contains(F.lower("chapter"), F.lit(chapter.lower())))
    out = own.groupBy("chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "context"))), lambda x: x["context"]).alias("contexts"))
    return out.orderBy("chapter").limit(limit)


def node_context(node_contexts: DataFrame, contexts: DataFrame) -> DataFrame:
    """(nid, context, labels) that the note parser hung on nodes."""
    return node_contexts.join(F.broadcast(contexts.select(F.col("ptr").alias("ctx"), "context", "labels")), "ctx").select("nid", "context", "labels")
