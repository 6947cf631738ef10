"""Logs, JSON, relational tables and asset files as vertices and edges."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from processgraph.functions.scalars import strip

SYSLOG = r"^(\w\w\w\s+[0-9]+\s+[0-9:]+)\s+([^\s]+)\s+([^\s]+?)(?:\[([0-9]+)\])?:\s\s*(.*)$"
HEADERS = {
    "timestamp": "timestamp time date @timestamp".split(),
    "message": "message msg text body".split(),
    "level": "level severity loglevel".split(),
    "source": "source host hostname origin".split(),
}


@dataclass
class LogConfig:
    format: str = "syslog"
    chapter: str = "logs"
    fields: dict[str, str] = field(default_factory=lambda: {k: k for k in ("timestamp", "message", "level", "source")})
    patterns: list[str] = field(default_factory=list)
    sequential: bool = True


def syslog(line: Column) -> Column:
    """struct(timestamp, source, service, pid, message, level); a line of another form is a message alone."""
    ok = line.rlike(SYSLOG)
    part = lambda k: F.regexp_extract(line, SYSLOG, k)
    return F.struct(part(1).alias("timestamp"), part(2).alias("source"), part(3).alias("service"), part(4).alias("pid"), F.when(ok, part(5)).otherwise(strip(line)).alias("message"), F.lit("INFO").alias("level"))


def json_line(line: Column, fields: dict[str, str] | None = None) -> Column:
    """struct(timestamp, source, message, level) of named fields; missing ones are empty, the level INFO."""
    fields = fields or LogConfig().fields
    get = lambda k, d: F.coalesce(F.get_json_object(line, f"$['{fields[k]}']"), F.lit(d)).alias(k)
    return F.struct(get("timestamp", ""), get("source", ""), get("message", ""), get("level", "INFO"))


def delimited(lines: DataFrame, delimiter: str = ",", header: bool = True) -> DataFrame:
    """(ord, timestamp, source, message, level) of lines (ord, line): columns by known names of the header; quotes mean nothing.

    Without a header the first column is the time and the rest the message.
    """
    own = lines.select("ord", F.transform(F.split(strip(F.col("line")), F.lit("\\Q" + delimiter + "\\E")), strip).alias("f")).where(F.size("f") > 0).where(F.array_join("f", "") != "")
    if not header:
        return own.select("ord", F.get("f", F.lit(0)).alias("timestamp"), F.lit("").alias("source"), F.array_join(F.slice("f", 2, 1 << 20), delimiter).alias("message"), F.lit("INFO").alias("level"))
    first = own.orderBy("ord").first()
    names = [x.lower() for x in first["f"]] if first else []
    pick = {k: next((i for i, n in enumerate(names) if n in known), None) for k, known in HEADERS.items()}
    get = lambda k, d: (F.coalesce(F.get("f", F.lit(pick[k])), F.lit(d)) if pick[k] is not None else F.lit(d)).alias(k)
    body = own.where(F.col("ord") > first["ord"]) if first else own
    return body.select("ord", get("timestamp", ""), get("source", ""), get("message", ""), get("level", "INFO"))


def log_entries(lines: DataFrame, config: LogConfig) -> DataFrame:
    """(ord, timestamp, source, message, level) of lines (ord, line) that aren't blank."""
    own = lines.where(F.length(strip(F.col("line"))) > 0)
    if config.format in ("csv", "tsv"):
        return delimited(own, "," if config.format == "csv" else "\t")
    parsed = json_line(F.col("line"), config.fields) if config.format == "json" else syslog(F.col("line"))
    return own.select("ord", parsed.alias("e")).select("ord", "e.timestamp", "e.source", "e.message", "e.level")


def log_graph(lines: DataFrame, config: LogConfig, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges: messages noted with level, source, time and pattern matches, each followed by the next one.

    `by` names a column of lines within which entries follow each other; without it all lines are one
    sequence, which one task has to order.
    """
    extra = [by] if by else []
    own = log_entries(lines, config).where("message <> ''")
    if by:
        own = own.join(lines.select("ord", by), "ord")
    notes = [F.col("level"), F.col("source"), F.col("timestamp")]
    found = F.flatten(F.array(*[F.regexp_extract_all("message", F.lit(f"({p})"), F.lit(1)) for p in config.patterns])) if config.patterns else F.array().cast("array<string>")
    noted = own.select("message", "ord", F.explode(F.filter(F.concat(F.array(*notes), found), lambda x: x != "")).alias("dst"))
    edges = noted.select(F.col("message").alias("src"), F.lit("note").alias("arrow"), "dst", F.col("ord"))
    if config.sequential:
        after = F.lead("message").over(Window.partitionBy(*extra).orderBy("ord") if by else Window.orderBy("ord"))
        chain = own.withColumn("dst", after).where("dst is not null")
        edges = edges.unionByName(chain.select(F.col("message").alias("src"), F.lit("then").alias("arrow"), "dst", "ord"))
    edges = edges.select("src", "arrow", "dst", F.array().cast("array<string>").alias("context"), F.lit(1.0).cast("float").alias("wgt"), "ord")
    texts = own.select(F.col("message").alias("text"), "ord").unionByName(noted.select(F.col("dst").alias("text"), "ord"))
    return texts.select("text", F.lit(config.chapter).alias("chapter"), F.lit(False).alias("seq"), "ord"), edges


def json_nodes(text: str, parent: str = "") -> list[tuple[str, str]]:
    """(parent, text) of a JSON text, depth first: keys and plain values are nodes, arrays fan out."""
    out: list[tuple[str, str]] = []

    def visit(value: object, above: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                out.append((above, str(k)))
                visit(v, str(k))
        elif isinstance(value, list):
            for v in value:
                visit(v, above)
        elif value is not None:
            out.append((above, json.dumps(value) if isinstance(value, bool) else str(value)))

    visit(json.loads(text), parent)
    return [(p, t) for p, t in out if t]


def json_graph(docs: DataFrame, chapter: str = "json_import", arrow: str = "contain") -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of JSON texts (ord, text)."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(o * 1_000_000 + k, p, t) for o, text in zip(frame["ord"], frame["text"]) if text for k, (p, t) in enumerate(json_nodes(text))]
            yield pd.DataFrame(rows, columns=["ord", "parent", "text"])

    rows = docs.select("ord", "text").mapInPandas(run, "ord bigint, parent string, text string")
    edges = rows.where("parent <> '' and parent <> text").select(F.col("parent").alias("src"), F.lit(arrow).alias("arrow"), F.col("text").alias("dst"), F.array().cast("array<string>").alias("context"), F.lit(1.0).cast("float").alias("wgt"), "ord")
    return rows.select("text", F.lit(chapter).alias("chapter"), F.lit(False).alias("seq"), "ord"), edges


@dataclass
class TableIndex:
    """How a table becomes nodes: the label column, columns to leave out, and foreign keys (column, table, key)."""

    label: str
    key: str
    skip: list[str] = field(default_factory=list)
    foreign: list[tuple[str, str, str]] = field(default_factory=list)


def index_tables(tables: dict[str, DataFrame], config: dict[str, TableIndex], prefix: str = "db") -> tuple[DataFrame, DataFrame]:
    """Vertices and edges: a row is a node by its label, its other columns are noted as "column: value", foreign keys lead on.

    Nulls are left out; rows with equal labels are one node; the chapter is prefix.table.
    """
    vertices, edges = None, None
    join = lambda a, b: b if a is None else a.unionByName(b)
    none = F.array().cast("array<string>")
    for name, df in tables.items():
        own = config[name]
        rows = df.where(F.col(own.label).isNotNull())
        label, at = F.col(own.label).cast("string"), F.xxhash64(F.lit(name), own.key).bitwiseAND((1 << 38) - 1)
        vertices = join(vertices, rows.select(label.alias("text"), F.lit(f"{prefix}.{name}").alias("chapter"), F.lit(False).alias("seq"), at.alias("ord")))
        rest = [c for c in df.columns if c not in {own.label, own.key, *own.skip, *(f[0] for f in own.foreign)}]
        if rest:
            values = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in rest])
            noted = rows.select(label.alias("src"), F.explode(F.array_compact(values)).alias("dst"), at.alias("ord"))
            edges = join(edges, noted.select("src", F.lit("note").alias("arrow"), "dst", none.alias("context"), F.lit(1.0).cast("float").alias("wgt"), "ord"))
        for column, table, key in own.foreign:
            other = tables[table].select(F.col(key).alias("__key"), F.col(config[table].label).cast("string").alias("dst"))
            led = rows.select(label.alias("src"), F.col(column).alias("__key"), at.alias("ord")).join(other, "__key").where("dst is not null and src <> dst")
            edges = join(edges, led.select("src", F.lit("then").alias("arrow"), "dst", none.alias("context"), F.lit(1.0).cast("float").alias("wgt"), "ord"))
    return vertices, edges


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of text files: files in the order of their names, lines in that of each file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).select((F.shiftleft(F.xxhash64("file").bitwiseAND((1 << 20) - 1), 40) + F.col("n")).alias("ord"), "line")


def read_assets(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime, content) of the files in an asset folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
