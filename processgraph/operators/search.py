"""Structured search: predicates over nodes and semi or anti joins with their links."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from processgraph.functions.scalars import context_labels, inhibition, similar

STTYPES = {"NEAR": 0, "LEADSTO": 1, "CONTAINS": 2, "EXPRESS": 3}


def search_text(nodes: DataFrame, pattern: str, chapter: str = "", limit: int | None = None) -> DataFrame:
    """Nodes whose text has the pattern inside, without case; limited by pointer order."""
    own = nodes.where(F.contains(F.lower("text"), F.lit(pattern.lower())))
    if chapter and chapter not in ("any", "%%"):
        own = own.where(F.contains("chapter", F.lit(chapter)))
    return own if limit is None else own.orderBy("class", "cptr").limit(limit)


def name_condition(name: str, chapter: str = "", seq: bool = False) -> Column:
    """A chapter's and a name's condition: a name with wildcards is LIKE, one with spaces a substring, a word a token."""
    parts = [F.lit(True)]
    if chapter and chapter not in ("any", "%%"):
        parts.append(F.lower("chapter").like(f"%{chapter.lower()}%"))
    if name and name not in ("any", "%%"):
        low = name.lower()
        if "%" in name or "_" in name:
            parts.append(F.lower("text").like(low))
        elif " " in name:
            parts.append(F.contains(F.lower("text"), F.lit(low)))
        else:
            parts.append(F.array_contains(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), low))
    if seq:
        parts.append(F.col("seq"))
    return reduce(lambda a, b: a & b, parts)


def nccs(nodes: DataFrame, links: DataFrame, name: str, chapter: str = "", seq: bool = False, limit: int = 100) -> DataFrame:
    """Matches by text, and among equal texts by the number of links of the channels +EXPRESS, -EXPRESS and +LEADSTO."""
    degree = links.where(F.col("stindex").isin(1, 5, 7)).groupBy(F.col("src").alias("nid")).agg(F.count("*").alias("degree"))
    own = nodes.where(name_condition(name, chapter, seq)).join(degree, "nid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return own.orderBy("text", F.desc("degree")).limit(limit)


@dataclass
class Unified:
    text: str = ""
    chapters: list[str] = field(default_factory=list)
    contexts: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    min_weight: float = 0.0
    sttype: int | None = None
    limit: int | None = 100


def parse_unified(query: str) -> Unified:
    """Words, NOT word, in:chapter, st:TYPE and w>number."""
    out, words, rest = Unified(), query.split(), []
    while words:
        w = words.pop(0)
        if w == "NOT" and words:
            out.excluded.append(words.pop(0))
        elif w.startswith("in:"):
            out.chapters.append(w[3:])
        elif w.startswith("st:"):
            out.sttype = STTYPES.get(w[3:].upper())
        elif m := re.fullmatch(r"w>(\d+(?:\.\d+)?)", w):
            out.min_weight = float(m[1])
        else:
            rest.append(w)
    out.text = " ".join(rest)
    return out


def unified(nodes: DataFrame, links: DataFrame, contexts: DataFrame, p: Unified | str, excluded_in_text: bool = False) -> DataFrame:
    """All conditions at once. links' contexts are compared by substring; a query string also excludes by text."""
    if isinstance(p, str):
        p, excluded_in_text = parse_unified(p), True
    own = nodes
    if p.text:
        own = own.where(F.contains(F.lower("text"), F.lit(p.text.lower())))
    if p.chapters:
        own = own.where(F.col("chapter").isin(*p.chapters))
    if excluded_in_text:
        for x in p.excluded:
            own = own.where(~F.contains(F.lower("text"), F.lit(x.lower())))
    named = links.join(F.broadcast(contexts.select(F.col("ptr").alias("ctx"), "context")), "ctx").select(F.col("src").alias("nid"), "context")
    for x in p.excluded:
        own = own.join(named.where(F.contains("context", F.lit(x))).select("nid"), "nid", "left_anti")
    if p.contexts:
        every = reduce(lambda a, b: a & b, [F.contains("context", F.lit(x)) for x in p.contexts])
        own = own.join(named.where(every).select("nid"), "nid", "left_semi")
    if p.min_weight > 0:
        own = own.join(links.where(F.col("wgt") >= p.min_weight).select(F.col("src").alias("nid")), "nid", "left_semi")
    if p.sttype is not None:
        own = own.join(links.where(F.abs(F.col("stindex") - 4) == p.sttype).select(F.col("src").alias("nid")), "nid", "left_semi")
    return own if p.limit is None else own.orderBy("class", "cptr").limit(p.limit)


def combinatorial(nodes: DataFrame, terms: list[str], mode: str = "and") -> DataFrame:
    """Nodes with all terms, with any, or (product) for each term its nodes."""
    low = F.lower("text")
    if mode == "and":
        return nodes.where(reduce(lambda a, b: a & b, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(bool(terms))))
    if mode == "or":
        return nodes.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(False)))
    if mode == "product":
        hit = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t)))
        return nodes.select(F.explode(hit).alias("term"), "*")
    raise ValueError(f"no such mode: {mode}")


def cross_chapter(nodes: DataFrame, query: str, chapters: list[str]) -> DataFrame:
    """(chapter, matches) for each chapter of the list, none included."""
    wanted = nodes.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(chapters)], "chapter string")
    hit = search_text(nodes, query).groupBy("chapter").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("text")).alias("texts"))
    return wanted.join(hit, "chapter", "left").select("chapter", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def parse_inhibition(query: str) -> tuple[list[str], list[str]]:
    """Labels before and after the word NOT."""
    want, *rest = re.split(r"\bNOT\b", query, maxsplit=1, flags=re.I)
    parts = [[x for x in re.split(r"[,\s]+", p) if x] for p in (want, *rest, "")]
    return parts[0], parts[1]


def with_inhibition(nodes: DataFrame, links: DataFrame, contexts: DataFrame, query: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Text matches of which some link's context has all included labels and no excluded one; without contexts, if nothing is included."""
    named = links.join(F.broadcast(contexts.select(F.col("ptr").alias("ctx"), "context")), "ctx")
    state = named.groupBy(F.col("src").alias("nid")).agg(F.max(inhibition(context_labels(F.col("context")), include, exclude)).alias("ok"))
    own = search_text(nodes, query).join(state, "nid", "left")
    return own.where(F.coalesce("ok", F.lit(not include))).drop("ok")


def stories_by_arrow(links: DataFrame, nodes: list, arrows: list[int], stindexes: list[int], limit: int) -> DataFrame:
    """Of listed nodes those with a link of the arrows in the channels (1 to 7), the first of the list."""
    own = links.where((F.col("arr").isin(*arrows) if arrows else F.lit(True)) & (F.col("stindex").isin(*stindexes) if stindexes else F.lit(True)))
    given = links.sparkSession.createDataFrame([(n, k) for k, n in enumerate(nodes)], f"node {links.schema['src'].dataType.simpleString()}, pos int")
    return given.join(own.select(F.col("src").alias("node")), "node", "left_semi").orderBy("pos").limit(limit)


def solve_names(nodes: DataFrame, names: list[str], chapter: str = "", limit: int = 100) -> DataFrame:
    """Nodes of literal pointers (class,cptr) and of exact texts, these in a similar chapter."""
    from processgraph.functions.search_language import literal_pointers

    pointers, rest = literal_pointers(names)
    by_ptr = reduce(lambda a, b: a | b, [(F.col("class") == c) & (F.col("cptr") == p) for c, p in pointers], F.lit(False))
    by_name = F.col("text").isin(*rest) if rest else F.lit(False)
    if chapter and chapter != "%%":
        by_name &= similar(F.col("chapter"), F.lit(chapter))
    return nodes.where(by_ptr | by_name).orderBy("class", "cptr").limit(limit)
