"""The note language: text to nodes, links and diagnostics, and the configuration of its arrows.

A file is parsed by one task, since its lines depend on each other; many files are parsed in parallel.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from processgraph.graph import Graph
from processgraph.registry import Registry

QUOTES = "\"'"
COMPLETE = {"event", "lookup", "blank", "section", "context"}


class NoteError(Exception):
    """A line that can't be understood; parsing goes on with the next one."""


@dataclass
class Notes:
    """What a text says. links are (from, arrow, to, weight, context labels); ghosts are (text, context labels)."""

    nodes: dict[str, list] = field(default_factory=dict)
    links: dict[tuple, None] = field(default_factory=dict)
    ghosts: dict[tuple, None] = field(default_factory=dict)
    errors: list[tuple[int, str]] = field(default_factory=list)
    warnings: list[tuple[int, str]] = field(default_factory=list)

    @property
    def chapters(self) -> list[str]:
        return sorted({c or "default" for c, _ in self.nodes.values()})


def normalise(text: str) -> str:
    return text.replace("“", '"').replace("”", '"')


class Scanner:
    """Tokens of a text with their lines; None marks the end of a line."""

    def __init__(self, text: str):
        self.s, self.at, self.line = normalise(text), 0, 1

    def peek(self, k: int = 0) -> str:
        return self.s[self.at + k] if self.at + k < len(self.s) else ""

    def blank(self) -> list[None]:
        """Passes white space and comments; one None for each line that ends."""
        ends = []
        while self.at < len(self.s):
            c = self.peek()
            if c == "#" or (c == "/" and self.peek(1) == "/"):
                end = self.s.find("\n", self.at)
                self.at = len(self.s) if end < 0 else end
            elif c.isspace():
                self.at += 1
                if c == "\n":
                    ends.append(None)
            else:
                break
        return ends

    def skip_line(self) -> None:
        end = self.s.find("\n", self.at)
        self.at = len(self.s) if end < 0 else end + 1

    def match(self, pattern: str) -> re.Match | None:
        m = re.compile(pattern).match(self.s, self.at)
        if m:
            self.at = m.end()
        return m

    def plain(self) -> str:
        """Text up to a parenthesis, comment or line end; quoted parts may hold those."""
        m = self.match(r'(?:"[^"]*"|//(?<!//)|/(?!/)|[^"/()#\n]|"(?![^"]*"))*')
        if self.peek() == ")":
            raise NoteError("a closing parenthesis inside an item")
        return m.group().strip() if m else ""

    def token(self) -> str:
        c = self.peek()
        if c in ":+-" and (c == ":" or self.peek(1) == ":"):
            m = self.match(r"[+-]?:+[^:\n]*:+[ \t]*") or self.match(r"[^\n]*")
            return m.group().strip()
        if c == "(":
            m = self.match(r"\([^\n)]*(?:\([^\n)]*\))*[^\n)]*\)+") or self.match(r"[^\n]*")
            return m.group().strip()
        if c in QUOTES:
            if re.compile(r".[ \t\r]*(?:[(#\n]|\Z)").match(self.s, self.at):
                self.at += 1
                return '"'
            if c == '"' and self.peek(1).isspace():
                raise NoteError("a quoted text that begins with white space, or a ditto mark out of place")
            m = re.compile(rf"{c}([^{c}]*){c}(?=\s|\(|\Z)").match(self.s, self.at)
            if m is None:
                if c == "'":
                    return self.plain()
                raise NoteError("quotes that don't match")
            self.at = m.end()
            return m[1]
        if c == "@":
            return self.match(r"\S*").group()
        return self.plain()


class Parser:
    def __init__(self, registry: Registry):
        self.r, self.out = registry, Notes()
        self.chapter, self.context = "", {"any": None}
        self.sequence, self.last, self.fresh = False, "", False
        self.aliases: dict[str, list[str]] = {}
        self.previous: list[str] = []
        self.new_line()

    def new_line(self) -> None:
        self.items: list[str] = []
        self.alias, self.state, self.link = "", "blank", None

    def end_line(self) -> None:
        if self.state not in COMPLETE:
            self.out.errors.append((self.scan.line, "an item is missing after a section, relation or context"))
        if self.state != "blank" and self.items:
            self.previous = self.items
        self.new_line()
        self.scan.line += 1

    def parse(self, text: str) -> Notes:
        self.scan = Scanner(text)
        while True:
            for _ in self.scan.blank():
                self.end_line()
            if self.scan.at >= len(self.scan.s):
                break
            try:
                start = self.scan.at
                token = self.scan.token()
                self.scan.line += self.scan.s.count("\n", start, self.scan.at)
                if token:
                    self.take(token)
                elif self.scan.at == start:
                    self.scan.at += 1
            except NoteError as e:
                self.out.errors.append((self.scan.line, str(e)))
                self.scan.skip_line()
                self.scan.line += 1
                self.new_line()
        if self.state not in COMPLETE:
            self.out.errors.append((self.scan.line, "an item is missing at the end"))
        self.complete_caps()
        return self.out

    # Roles

    def take(self, t: str) -> None:
        if re.match(r"[+-]?:", t):
            self.set_context(t)
        elif t[0] == "-" and not self.chapter:
            self.start_chapter(t[1:].strip())
        elif t[0] == "(":
            if self.state == "relation":
                raise NoteError("two relations without an item between them")
            self.link, self.state = self.relation(t), "relation"
        elif t == '"':
            self.item(self.of(self.previous, len(self.items) + 1))
        elif t[0] == "@":
            if len(t) == 1:
                raise NoteError("a label without a name")
            self.alias, self.state = t[1:], "alias"
        elif t[0] == "$":
            self.item(self.resolve(t), "lookup", store=False)
        else:
            self.item(t)

    def start_chapter(self, name: str) -> None:
        if name.startswith(":"):
            raise NoteError(f"a chapter's name that looks like a context: {name}")
        if "," in name:
            raise NoteError(f"a comma in a chapter's name: {name}")
        self.chapter, self.state, self.sequence, self.fresh = name, "section", False, False

    def set_context(self, t: str) -> None:
        expression = next((x.strip() for x in t.split(":")[1:] if x.strip()), "")
        sign = t[0] if t[0] in "+-" else "="
        if "_sequence_" in expression:
            self.sequence = self.fresh = sign != "-"
            if sign != "-":
                self.last = ""
        self.state = "context"
        if not expression:
            return
        if "(" in expression:
            self.out.warnings.append((self.scan.line, "a context expression with parentheses; a simpler one reads better"))
        parts = [x.strip() for x in split_outside(clean_expression(expression), "|") if x.strip()]
        if sign == "=":
            self.context = {}
        if sign == "-":
            self.context = {c: None for c in self.context if not any(p in part for p in parts for part in split_outside(c, "."))}
        else:
            self.context |= dict.fromkeys(parts)
        self.in_section()

    def in_section(self) -> None:
        if not self.chapter:
            raise NoteError("something outside a section or chapter")

    def relation(self, t: str) -> tuple[int, float, tuple[str, ...]]:
        name, *rest = (x.strip() for x in t.strip()[1:-1].split(","))
        weights, labels = [], []
        for x in rest:
            try:
                weights.append(float(x))
            except ValueError:
                labels.append(x)
        if len(weights) > 1:
            raise NoteError(f"more than one weight in {t}")
        if weights and weights[0] < 0:
            raise NoteError(f"a negative weight in {t}")
        arrow = self.r.by_name(name)
        if arrow is None:
            raise NoteError(f"no such arrow: {name}")
        return arrow.ptr, weights[0] if weights else 1.0, tuple(labels)

    def of(self, items: list[str], k: int) -> str:
        if not 1 <= k <= len(items):
            raise NoteError("a ditto mark or label that stands for nothing")
        return items[k - 1]

    def resolve(self, t: str) -> str:
        word = t.split()[0]
        if "." not in t or word in ("$", "$$"):
            return t
        name, _, number = word[1:].partition(".")
        if not number.strip().isdigit() or int(number) < 1:
            raise NoteError(f"labels are used as $name.1: {t}")
        return self.of(self.previous if name == "PREV" else self.aliases.get(name, []), int(number))

    def item(self, text: str, state: str = "event", store: bool = True) -> None:
        self.in_section()
        if self.alias and store:
            self.aliases.setdefault(self.alias, []).append(text)
        if self.state == "relation":
            if not self.items:
                raise NoteError("a relation without an item before it")
            origin = self.items[-1]
            if origin == text:
                raise NoteError("an arrow that leads to where it starts")
            self.node(text)
            self.add_link(self.clean(origin), self.link[0], self.clean(text), self.link[1], self.link[2])
        else:
            if shouting(text):
                self.out.warnings.append((self.scan.line, f"a possible note to self: {text}"))
            self.node(text)
            self.chain(text)
        self.items.append(text)
        self.state = state

    # Nodes and links

    def clean(self, text: str) -> str:
        return strip_marks(text, self.r.annotations)[0]

    def node(self, text: str) -> None:
        clean, marks = strip_marks(text, self.r.annotations)
        self.add_node(clean)
        for mark, word in marks:
            arrow = self.r.by_name(self.r.annotations[mark])
            if arrow is None:
                raise NoteError(f"no such arrow: {self.r.annotations[mark]}")
            if word:
                self.add_node(word)
                self.add_link(clean, arrow.ptr, word, 1.0, ())
        self.out.ghosts[clean, tuple(sorted(self.context))] = None

    def add_node(self, text: str, seq: bool = False) -> None:
        own = self.out.nodes.setdefault(text, [self.chapter, seq])
        own[0] = own[0] or self.chapter
        own[1] = own[1] or seq

    def add_link(self, a: str, arrow: int, b: str, weight: float, labels: tuple[str, ...]) -> None:
        self.out.links[a, arrow, b, weight, tuple(sorted({*self.context, *labels}))] = None

    def chain(self, text: str) -> None:
        """In a sequence, the first items of lines follow each other."""
        text = self.clean(text)
        if not self.sequence or text == self.last:
            return
        if not self.items and self.last:
            self.add_node(self.last, self.fresh)
            self.fresh = False
            self.add_link(self.last, self.r.by_name("then").ptr, text, 1.0, ())
        self.last = text

    def complete_caps(self) -> None:
        """Short texts that differ in case only are near each other."""
        caps = self.r.by_name("caps")
        by: dict[str, list[str]] = {}
        for text in self.out.nodes:
            if text.count(" ") <= 2 or len(text) < 128:
                by.setdefault(text.lower(), []).append(text)
        for same in by.values():
            for a in same:
                for b in same:
                    if a != b and caps:
                        self.out.links[a, caps.ptr, b, 1.0, ("ambiguous",)] = None


def shouting(s: str) -> bool:
    """More than four signs and no small letter or digit; a long sentence is not meant."""
    return len(s) > 4 and not (len(s) > 50 and s.endswith(".")) and all(c.isupper() or not c.isalnum() for c in s)


def clean_expression(s: str) -> str:
    s = s.strip()
    while s.startswith("(") and s.endswith(")") and _closes_last(s):
        s = s[1:-1].strip()
    return re.sub(r"[.&]+", ".", re.sub(r"[|,]+", "|", s))


def _closes_last(s: str) -> bool:
    depth = 0
    for i, c in enumerate(s):
        depth += (c == "(") - (c == ")")
        if not depth:
            return i == len(s) - 1
    return False


def split_outside(s: str, mark: str) -> list[str]:
    """Parts between marks outside parentheses."""
    out, depth = [""], 0
    for c in s:
        depth += (c == "(") - (c == ")")
        if c == mark and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [x for x in out if x] if s else []


def strip_marks(text: str, marks: dict[str, str]) -> tuple[str, list[tuple[str, str]]]:
    """The text without annotation marks that a word follows, outside quotes, and the marks with their words."""
    if not marks:
        return text, []
    found, out, i, quoted = [], "", 0, False
    longest = sorted(marks, key=len, reverse=True)
    while i < len(text):
        quoted ^= text[i] == '"'
        mark = None if quoted else next((m for m in longest if text.startswith(m, i) and i + len(m) < len(text) and not text[i + len(m)].isspace()), None)
        if mark:
            i += len(mark)
            quote = text[i] in QUOTES
            m = re.compile(rf"{text[i]}([^{text[i]}]*)" if quote else r"([^\W\d_]*)").match(text, i)
            found.append((mark, m[1].strip()))
        else:
            out += text[i]
            i += 1
    return out, found


def parse(text: str, registry: Registry | None = None) -> Notes:
    return Parser(registry or Registry.standard()).parse(text)


def validate(text: str, registry: Registry | None = None) -> dict:
    """Whether a text has no errors, and what it holds."""
    n = parse(text, registry)
    return {"valid": not n.errors, "nodes": len(n.nodes), "links": len(n.links), "chapters": n.chapters, "errors": n.errors, "warnings": n.warnings}


def summary(text: str, registry: Registry | None = None) -> str:
    v = validate(text, registry)
    lines = [f"valid: {v['valid']}", f"nodes: {v['nodes']}", f"links: {v['links']}", f"chapters: {', '.join(v['chapters'])}"]
    return "\n".join(lines + [f"error, line {n}: {m}" for n, m in v["errors"]] + [f"warning, line {n}: {m}" for n, m in v["warnings"]])


def edges_created(n: Notes, registry: Registry) -> int:
    """Links of one direction; those of an arrow that is its own inverse count in both."""
    return sum(2 if registry.inverse.get(k[1]) == k[1] else 1 for k in n.links)


def compile_notes(spark: SparkSession, text: str, registry: Registry | None = None, provenance: tuple[str, str] | None = None) -> tuple[Graph, Notes]:
    """A graph of one text. provenance (source, author) notes where each node is from, if there is a note arrow."""
    r = registry or Registry.standard()
    n = parse(text, r)
    vertices = [(t, c or "default", s, k) for k, (t, (c, s)) in enumerate(n.nodes.items())]
    edges = [(a, r.by_ptr(p).short, b, list(c), w, k) for k, (a, p, b, w, c) in enumerate(n.links)]
    if provenance and r.by_name("note"):
        for t in n.nodes:
            for key, value in zip(("source", "author"), provenance):
                if value:
                    edges.append((t, "note", f"prov:{key}:{value}", [], 1.0, len(edges)))
    from processgraph.graph import EDGE, VERTEX

    return Graph.build(spark.createDataFrame(vertices, VERTEX), spark.createDataFrame(edges, EDGE), r), n


def provenance_of(g: Graph) -> DataFrame:
    """(src_text, source, line, time, author) read back from notes; nodes without a source have none."""
    own = g.named_links().where(F.startswith("dst_text", F.lit("prov:"))).select("src_text", F.regexp_extract("dst_text", r"^prov:(\w+):(.*)$", 1).alias("k"), F.regexp_extract("dst_text", r"^prov:(\w+):(.*)$", 2).alias("v"))
    return own.groupBy("src_text").pivot("k", ["source", "line", "time", "author"]).agg(F.min("v")).where("source is not null")


def parse_files(files: DataFrame, registry: Registry) -> DataFrame:
    """(path, kind, line, a, arrow, b, wgt, context, seq) of files (path, content): nodes, links, ghosts, errors and warnings."""
    held = files.sparkSession.sparkContext.broadcast(registry)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                r = copy.deepcopy(held.value)
                n = parse(content or "", r)
                rows += [(path, "node", k, t, "", c or "default", 0.0, [], s) for k, (t, (c, s)) in enumerate(n.nodes.items())]
                rows += [(path, "link", k, a, r.by_ptr(p).short, b, w, list(c), False) for k, (a, p, b, w, c) in enumerate(n.links)]
                rows += [(path, "ghost", k, t, "", "", 0.0, list(c), False) for k, (t, c) in enumerate(n.ghosts)]
                rows += [(path, kind, line, text, "", "", 0.0, [], False) for kind, found in (("error", n.errors), ("warning", n.warnings)) for line, text in found]
            yield pd.DataFrame(rows, columns=["path", "kind", "line", "a", "arrow", "b", "wgt", "context", "seq"])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, line int, a string, arrow string, b string, wgt float, context array<string>, seq boolean")


def files_graph(files: DataFrame, registry: Registry) -> Graph:
    """One graph of many note files, in the order of their paths."""
    rows = parse_files(files, registry)
    at = F.shiftleft(F.xxhash64("path").bitwiseAND((1 << 16) - 1), 20) + F.col("line")
    v = rows.where("kind = 'node'").select(F.col("a").alias("text"), F.col("b").alias("chapter"), "seq", at.alias("ord"))
    e = rows.where("kind = 'link'").select(F.col("a").alias("src"), "arrow", F.col("b").alias("dst"), "context", "wgt", at.alias("ord"))
    return Graph.build(v, e, registry)


# Configuration


def read_config(registry: Registry, text: str) -> list[str]:
    """Arrows of the sections leadsto, contains, properties and similarity, and annotation marks; what is wrong comes back."""
    problems: list[str] = []
    section, forward, name, mark = "", None, "", ""
    for number, raw in enumerate(normalise(text).splitlines(), 1):
        line = re.sub(r"(?:^|\s)(?:#|//).*$", "", raw).strip()
        if not line or line.startswith(":"):
            continue
        if m := re.fullmatch(r"-\s*([A-Za-z]+)", line):
            section, forward = m[1].lower(), None
            if section not in ("leadsto", "contains", "properties", "similarity", "annotations", "closures"):
                problems.append(f"line {number}: no such section: {section}")
            continue
        if section in ("leadsto", "contains", "properties"):
            for sign, long, short in re.findall(r"([+-])\s*([^()]+?)\s*\(([^)]*)\)", line):
                if sign == "+":
                    forward = registry.insert(section, short.strip(), long, "+")
                elif forward:
                    registry.invert(forward, registry.insert(section, short.strip(), long, "-"))
                else:
                    problems.append(f"line {number}: an inverse without its arrow")
            if "(" not in line:
                problems.append(f"line {number}: an arrow without a short name")
        elif section == "similarity":
            if line[0] in "+-":
                problems.append(f"line {number}: similarity has no sign")
            elif m := re.fullmatch(r"([^()]+?)\s*\(([^)]*)\)", line):
                ptr = registry.insert(section, m[2].strip(), m[1], "+")
                registry.invert(ptr, ptr)
        elif section == "annotations":
            if m := re.fullmatch(r"(\S+)\s*\((.*)\)", line):
                mark, name = m[1], m[2].strip(" ()")
                if re.search(r"[^\W\d_]", mark) or mark[0] in "+-":
                    problems.append(f"line {number}: a mark must be a sign other than + and -: {mark}")
                elif registry.annotations.get(mark, name) != name:
                    problems.append(f"line {number}: the mark {mark} has another meaning already")
                else:
                    registry.annotations[mark] = name
            else:
                problems.append(f"line {number}: a mark without an arrow")
    return problems


def read_closures(text: str) -> list[tuple[str, str, str]]:
    """Rules first + second => result, one a line; # starts a comment."""
    found = (re.fullmatch(r"\s*(.+?)\s*\+\s*(.+?)\s*=>\s*(.+?)\s*", re.sub(r"#.*", "", line)) for line in text.splitlines())
    return [(m[1], m[2], m[3]) for m in found if m]


def closure_rules(spark: SparkSession, rules: list[tuple[str, str, str]], registry: Registry) -> DataFrame:
    """(first, second, result, stindex) of rules whose arrows are all known."""
    rows = []
    for names in rules:
        a, b, c = (registry.by_name(x) for x in names)
        if a and b and c:
            rows.append((a.ptr, b.ptr, c.ptr, c.stindex))
    return spark.createDataFrame(rows, "first int, second int, result int, stindex tinyint")
