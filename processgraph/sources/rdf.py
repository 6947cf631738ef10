"""Triples and Turtle text, DOT text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from processgraph.graph import Graph
from processgraph.registry import Registry

_W3 = "http://www.w3.org/"
TYPE = _W3 + "1999/02/22-rdf-syntax-ns#type"
LABEL = _W3 + "2000/01/rdf-schema#label"
_KINDS = ["Near", "LeadsTo", "Contains", "Expresses"]


@dataclass(frozen=True)
class Namespace:
    base: str = "http://example.org/graph/"
    vocab: str = "http://example.org/graph/vocab#"


def uri_encode(text: str) -> str:
    """Spaces become underscores; letters, digits and -_.~ stay, other signs are percent-coded."""
    return "".join("_" if c == " " else c if c.isalpha() or c.isdigit() or c in "-_.~" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def uri_decode(text: str) -> str:
    raw = re.sub(rb"%([a-fA-F0-9]{2})", lambda m: bytes([int(m[1], 16)]), text.replace("_", " ").encode())
    return raw.decode("utf-8", "replace")


def encode_column(c: Column) -> Column:
    """uri_encode as an expression: url_encode's form with the signs that stay put back."""
    e = F.url_encode(F.replace(c, F.lit(" "), F.lit("_")))
    return F.replace(F.replace(e, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def local_name(uri: str) -> str:
    return re.split(r"[/#]", uri)[-1]


def triples(g: Graph, ns: Namespace = Namespace()) -> DataFrame:
    """(subject, predicate, object): type, label and chapter of each node; edge, predicate's type and label and context of each link."""
    uri = lambda kind, c: F.concat(F.lit(f"{ns.base}{kind}/"), encode_column(c))
    node = g.nodes.select(uri("node", F.col("text")).alias("s"), "text", "chapter")
    row = lambda p, o: F.struct(F.col("s").alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    of_nodes = node.select(F.explode(F.array_compact(F.array(row(TYPE, F.lit(ns.vocab + "Node")), row(LABEL, F.col("text")), F.when(F.col("chapter") != "", row(ns.vocab + "chapter", uri("chapter", F.col("chapter"))))))).alias("t")).select("t.*")
    named = g.named_links().select(uri("node", F.col("src_text")).alias("s"), uri("node", F.col("dst_text")).alias("d"), F.concat(F.lit(ns.vocab), encode_column(F.col("short"))).alias("p"), "short", "context", "stindex")
    kind = F.element_at(F.array(*[F.lit(ns.vocab + k) for k in _KINDS]), (F.abs(F.col("stindex") - 4) + 1).cast("int"))
    t = lambda s, p, o: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"))
    parts = F.array_compact(F.array(t(F.col("s"), F.col("p"), F.col("d")), t(F.col("p"), F.lit(TYPE), kind), t(F.col("p"), F.lit(LABEL), F.col("short")), F.when(F.col("context") != "", t(F.col("s"), F.lit(ns.vocab + "context"), uri("context", F.col("context"))))))
    return of_nodes.unionByName(named.select(F.explode(parts).alias("t")).select("t.*"))


def is_uri(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][-+.0-9A-Za-z]*://")


def term(c: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(is_uri(c), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def turtle_lines(t: DataFrame) -> DataFrame:
    return t.select(F.concat(term(F.col("subject")), F.lit(" "), term(F.col("predicate")), F.lit(" "), term(F.col("object")), F.lit(" .")).alias("line"))


def turtle_header(ns: Namespace = Namespace()) -> list[str]:
    prefixes = {"node": ns.base + "node/", "rdf": TYPE.rpartition("#")[0] + "#", "rdfs": LABEL.rpartition("#")[0] + "#", "vocab": ns.vocab}
    return [f"@prefix {k}: <{v}> ." for k, v in prefixes.items()]


_TERM = re.compile(r'<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^\S+)?|([^\s<>"]+)')


def parse_turtle(text: str) -> list[tuple[str, str, str]]:
    """Triples of a line each: URIs, literals (language and type dropped) and prefixed names. Other lines are passed over."""
    prefixes, out = {}, []
    for line in text.splitlines():
        line = line.strip()
        if m := re.match(r"@prefix\s+([\w-]*):\s*<([^>]*)>", line):
            prefixes[m[1]] = m[2]
            continue
        if not line or line.startswith("#"):
            continue
        found = []
        for m in _TERM.finditer(line):
            if m[1] is not None:
                found.append(m[1])
            elif m[2] is not None:
                found.append(re.sub(r"\\(.)", lambda k: {"n": "\n", "t": "\t"}.get(k[1], k[1]), m[2]))
            elif m[3] not in (".", ";", ","):
                name = m[3].rstrip(".") if m[3] != "a" else "a"
                head, colon, tail = name.partition(":")
                found.append(TYPE if name == "a" else prefixes[head] + tail if colon and head in prefixes else name)
        if len(found) >= 3:
            out.append((found[0], found[1], found[2]))
    return out


def read_turtle(files: DataFrame) -> DataFrame:
    """(subject, predicate, object) of Turtle texts (text), a file a row."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([t for x in frame["text"] if x for t in parse_turtle(x)], columns=["subject", "predicate", "object"])

    return files.select("text").mapInPandas(run, "subject string, predicate string, object string")


def from_triples(t: DataFrame, registry: Registry, ns: Namespace = Namespace(), chapter: str = "imported", mapping: dict[str, tuple[str, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges. Labels and chapters come from metadata; predicates from the mapping, the vocabulary, or as new similarity arrows.

    Only distinct predicates come to the driver. A predicate with a negative type in the mapping is turned round.
    """
    meta = [TYPE, LABEL, ns.vocab + "chapter", ns.vocab + "context"]
    labels = t.where(F.col("predicate") == LABEL).groupBy(F.col("subject").alias("uri")).agg(F.min("object").alias("label"))
    chapters = t.where(F.col("predicate") == ns.vocab + "chapter").groupBy(F.col("subject").alias("uri")).agg(F.min("object").alias("chapter"))
    decode = F.udf(uri_decode)
    name = lambda c: decode(F.regexp_extract(c, r"([^/#]*)$", 1))
    facts = t.where(~F.col("predicate").isin(*meta) & ~F.startswith("subject", F.lit(ns.vocab)))
    arrows = []
    for row in facts.select("predicate").distinct().orderBy("predicate").collect():
        uri, turn = row["predicate"], False
        if mapping and uri in mapping:
            short, st = mapping[uri]
            turn = st < 0
            registry.by_name(short) or registry.insert(abs(st), short, short)
        else:
            short = uri_decode(local_name(uri))
            if registry.by_name(short) is None:
                ptr = registry.insert(0, short, short)
                registry.invert(ptr, ptr)
        arrows.append((uri, short, turn))
    spark = t.sparkSession
    names = F.broadcast(spark.createDataFrame(arrows, "predicate string, arrow string, turn boolean"))
    uris = facts.select(F.explode(F.array("subject", "object")).alias("uri")).union(labels.select("uri").where(F.startswith("uri", F.lit(ns.base + "node/")))).distinct()
    texts = uris.join(labels, "uri", "left").join(chapters, "uri", "left").select("uri", F.coalesce("label", F.when(is_uri(F.col("uri")), name(F.col("uri"))).otherwise(F.col("uri"))).alias("text"), F.coalesce(name(F.col("chapter")), F.lit(chapter)).alias("chapter"))
    at = F.xxhash64("text").bitwiseAND((1 << 38) - 1)
    vertices = texts.select("text", "chapter", F.lit(False).alias("seq"), at.alias("ord"))
    s, o = texts.select(F.col("uri").alias("subject"), F.col("text").alias("st")), texts.select(F.col("uri").alias("object"), F.col("text").alias("ot"))
    edges = facts.join(names, "predicate").join(s, "subject").join(o, "object").where("st <> ot")
    edges = edges.select(F.when(F.col("turn"), F.col("ot")).otherwise(F.col("st")).alias("src"), "arrow", F.when(F.col("turn"), F.col("st")).otherwise(F.col("ot")).alias("dst"), F.array().cast("array<string>").alias("context"), F.lit(1.0).cast("float").alias("wgt"), F.xxhash64("st", "arrow", "ot").bitwiseAND((1 << 38) - 1).alias("ord"))
    return vertices, edges


_COLOURS = {5: "blue", 6: "green", 7: "orange"}


def dot_lines(g: Graph, chapter: str = "") -> DataFrame:
    """(part, line): nodes, then the links of forward channels with their arrows; similarity is left out."""
    esc = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    own = g.nodes.where(F.col("chapter") == chapter) if chapter else g.nodes
    ident = F.format_string("n%d_%d", "class", "cptr")
    nodes = own.select(F.lit(1).alias("part"), F.concat(F.lit("  "), ident, F.lit(' [label="'), esc(F.col("text")), F.lit('"];')).alias("line"))
    ids = own.select("nid", ident.alias("id"))
    colour = F.create_map(*[F.lit(x) for kv in _COLOURS.items() for x in kv])
    e = g.links.where("stindex > 4").join(ids.select(F.col("nid").alias("src"), F.col("id").alias("a")), "src").join(ids.select(F.col("nid").alias("dst"), F.col("id").alias("b")), "dst").join(F.broadcast(g.arrows().select(F.col("ptr").alias("arr"), "short")), "arr")
    edges = e.select(F.lit(2).alias("part"), F.concat(F.lit("  "), "a", F.lit(" -> "), "b", F.lit(' [label="'), esc(F.col("short")), F.lit('", color='), colour[F.col("stindex").cast("int")], F.lit("];")).alias("line"))
    return nodes.unionByName(edges)


def save_dot(g: Graph, path: str, chapter: str = "", title: str = "graph", limit: int = 100_000) -> int:
    """One DOT file; it is meant to be looked at, so its lines are limited."""
    lines = [r["line"] for r in dot_lines(g, chapter).orderBy("part", "line").limit(limit).collect()]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([f'digraph "{title}" {{', *lines, "}"]) + "\n")
    return len(lines)
