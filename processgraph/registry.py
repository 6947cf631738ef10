"""Arrow and context directories: small dimension tables, kept on the driver and broadcast as DataFrames."""

from __future__ import annotations

import copy
import os
import re
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

ZERO, TOP = 4, 7
STTYPES = {"NEAR": 0, "LEADSTO": 1, "CONTAINS": 2, "EXPRESS": 3}
CHANNELS = {i: c for i, c in enumerate("Im3 Im2 Im1 In0 Il1 Ic2 Ie3".split(), 1)}
_ALIASES = {
    0: {"0", "near", "nearness", "near/similar", "nr", "similarity"},
    1: {"1", "leads to", "leads_to", "leadsto", "lt"},
    2: {"2", "cn", "contains", "part of"},
    3: {"3", "ep", "express", "expresses", "properties", "property"},
}
#: Type, short | long name, and of the inverse: the arrows that every graph has.
BUILT_IN = """
1 empty|debug|void|unbug
2 has-extract|contains extract/quote|extract-fr|extract/quote from
2 has-frag|contains intented characteristic|charct-in|characteristic of
3 has_theme|has contextual theme|theme_of|is a context theme in
3 has_highlight|has contextual highlight|highlight_of|is contextual highlight of
1 then|then followed by|from|follows on from
3 url|has URL|isurl|is a URL for
3 img|has image|isimg|is an image for
0 caps|capitalization
3 accepts|accepts|accepted-by|is accepted by
3 employs|employs|employed-by|is employed by
3 expresses|expresses|expressed-by|is expressed by
3 has accusee|has accusee|is accusee of|is accusee of
3 has intended promisee|has intended promisee|is intended promisee of|is intended promisee of
3 has intended promiser|has intended promiser|is intended promiser of|is intended promiser of
3 has promisee|has promisee|is promisee of|is promisee of
3 has promiser|has promiser|is promiser of|is promiser of
3 observes|observes|observed-by|is observed by
3 rents|rents from|rented-by|is rented by
1 imposes|imposes on|imposed-by|is imposed on by
0 has overlap|has overlap with|overlaps-with|overlaps with
0 may be influenced by|may be influenced by|may influence|may influence
0 observed by|observed by|observer-of|is an observer of
0 !eq|is not equal to|!eq-inv|is not equal to (inverse)
0 cf|compare with|cf-inv|compared from
2 decision|a decision was made|decided-in|was decided as part of
2 episode|an episode occurred|happened|this happened in/during
2 haskind|has a kind called|kind of|is a kind of
2 incl|includes|is-incl|is included in
2 rel|characterises|relation|relationship kind
2 work|work was done|work-in|was work done during
3 about|is about topic/theme|theme-of|is the topic/theme of
3 advisor|thesis advisor|advisor-for|was thesis advisor for
3 born|date of birth|bday|is the birthday of
3 canex|can express|isexpr|is expressible by
3 disc|discusses|is-disc|is discussed in
3 expr|expresses property|expr-by|is/are expressed by
3 like|likes|lk-by|is liked by
3 published in|is published in|citation|is the published citation for
3 significance|has a special significance|siginv|is a significant reflection
3 source|has source|source-of|the source for
3 supply|has supplier|supply-by|is the supplier of
3 th-title|wrote a thesis with title|thauthor|is a thesis title of
3 wrongabt|is wrong about|narb|is not accurately represented by
3 year|happened in years|year-for|the years in which
1 did|did|done-by|was done by
1 result|results in|result-of|was a result of
1 worked|worked on|work-proj|was a work project by
"""


def stindex_by_name(name: str, sign: str = "+") -> int:
    """A type's name or alias and a sign to 1..7; similarity has no sign. Unknown names are an error."""
    for st, names in _ALIASES.items():
        if name.strip().lower() in names:
            return ZERO + (0 if st == 0 else -st if sign == "-" else st)
    raise ValueError(f"no such link type: {name}")


def stindex_label(stindex: int) -> str:
    """1..7 to -EXPRESS .. +EXPRESS."""
    st = stindex - ZERO
    name = next(k for k, v in STTYPES.items() if v == abs(st))
    return name if st == 0 else ("+" if st > 0 else "-") + name


def channel(sttype: int) -> str:
    if not -3 <= sttype <= 3:
        raise ValueError(f"link type {sttype} is not between -3 and 3")
    return CHANNELS[sttype + ZERO]


def compile_context(labels: list[str]) -> str:
    return ",".join(sorted({x.strip() for x in labels if x.strip()}))


@dataclass(frozen=True)
class Arrow:
    ptr: int
    stindex: int
    short: str
    long: str


@dataclass
class Registry:
    """Arrows by pointer (from 1), inverses both ways, contexts by pointer (from 1; 0 is none), closure and annotation settings."""

    arrows: list[Arrow] = field(default_factory=list)
    inverse: dict[int, int] = field(default_factory=dict)
    contexts: list[str] = field(default_factory=list)
    annotations: dict[str, str] = field(default_factory=dict)
    _names: dict[str, int] = field(default_factory=dict)
    _longs: dict[str, int] = field(default_factory=dict)
    _context: dict[str, int] = field(default_factory=dict)

    @classmethod
    def standard(cls) -> Registry:
        r = cls()
        r.context(["any"])
        for line in BUILT_IN.strip().splitlines():
            st, _, names = line.partition(" ")
            r.pair(int(st), *names.split("|"))
        return r

    def insert(self, st: int | str, short: str, long: str, sign: str = "+") -> int:
        """Pointer of a new arrow, or of the one that has either name already."""
        for known in (self._names.get(short), self._longs.get(long)):
            if known:
                return known
        ptr = len(self.arrows) + 1
        self.arrows.append(Arrow(ptr, stindex_by_name(str(st), sign), short, long))
        self._names[short], self._longs[long] = ptr, ptr
        return ptr

    def invert(self, forward: int, backward: int) -> None:
        self.inverse[forward], self.inverse[backward] = backward, forward

    def pair(self, st: int | str, short: str, long: str, inv_short: str = "", inv_long: str = "") -> int:
        ptr = self.insert(st, short, long)
        if inv_short:
            self.invert(ptr, self.insert(st, inv_short, inv_long or inv_short, "-"))
        return ptr

    def by_name(self, name: str) -> Arrow | None:
        ptr = self._names.get(name.strip()) or self._longs.get(name.strip())
        return self.arrows[ptr - 1] if ptr else None

    def by_ptr(self, ptr: int) -> Arrow:
        if not 1 <= ptr <= len(self.arrows):
            raise IndexError(f"no arrow {ptr}")
        return self.arrows[ptr - 1]

    def matching(self, name: str) -> list[Arrow]:
        """!name! matches a name as written, name alone without case."""
        if len(name) > 2 and name[0] == name[-1] == "!":
            return [a for a in self.arrows if name[1:-1] in (a.short, a.long)]
        return [a for a in self.arrows if name.lower() in (a.short.lower(), a.long.lower())]

    def by_sttype(self, sttype: int) -> list[Arrow]:
        return [a for a in self.arrows if a.stindex - ZERO == sttype]

    def with_name(self, name: str) -> tuple[int, int]:
        a = self.by_name(name)
        return (a.ptr, a.stindex - ZERO) if a else (0, 0)

    def sttypes_of(self, ptrs: list[int]) -> list[int]:
        return sorted({self.by_ptr(p).stindex for p in ptrs})

    def resolve(self, names: list[str]) -> tuple[list[int], list[int]]:
        """Names or numbers to (arrow pointers, link types); -3..3 is a type, larger numbers are pointers."""
        ptrs, types = [], []
        for name in names:
            number = int(name) if re.fullmatch(r"[+-]?\d+", name) else None
            if number is not None and -3 <= number <= 3:
                types.append(number)
                continue
            found = self.by_name(name.strip("!")) if number is None else self.arrows[number - 1] if 3 < number <= len(self.arrows) else None
            if found:
                ptrs.append(found.ptr)
                types.append(found.stindex - ZERO)
        return ptrs, types

    def adjoint(self, ptrs: list[int]) -> list[int]:
        return list(dict.fromkeys(self.inverse[p] for p in ptrs if p in self.inverse))

    def context(self, labels: list[str]) -> int:
        """Pointer of a context, registered if new; 0 for no labels."""
        text = compile_context(labels)
        if not text:
            return 0
        if text not in self._context:
            self.contexts.append(text)
            self._context[text] = len(self.contexts)
        return self._context[text]

    def context_ptr(self, text: str) -> int:
        return self._context.get(text, 0)

    def context_text(self, ptr: int) -> str:
        return self.contexts[ptr - 1] if 1 <= ptr <= len(self.contexts) else ""

    def merge_contexts(self, one: list[str], two: list[str]) -> int:
        return self.context([*one, *two])

    def arrow_table(self, spark: SparkSession) -> DataFrame:
        rows = [(a.ptr, a.stindex, a.short, a.long, self.inverse.get(a.ptr)) for a in self.arrows]
        return spark.createDataFrame(rows, "ptr int, stindex tinyint, short string, long string, inv_ptr int")

    def context_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, c, c.split(",")) for k, c in enumerate(self.contexts, 1)]
        return spark.createDataFrame(rows, "ptr int, context string, labels array<string>")

    @classmethod
    def from_tables(cls, arrows: DataFrame, contexts: DataFrame) -> Registry:
        r = cls()
        for row in arrows.orderBy("ptr").collect():
            r.arrows.append(Arrow(row["ptr"], row["stindex"], row["short"], row["long"]))
            r._names[row["short"]], r._longs[row["long"]] = row["ptr"], row["ptr"]
            if row["inv_ptr"]:
                r.inverse[row["ptr"]] = row["inv_ptr"]
        for row in contexts.orderBy("ptr").collect():
            r.contexts.append(row["context"])
            r._context[row["context"]] = row["ptr"]
        return r

    @contextmanager
    def scratch(self, reset: bool = False, config_dir: str | None = None):
        """A block whose changes to this registry are undone at its end."""
        kept = copy.deepcopy(self.__dict__)
        try:
            if reset:
                self.__dict__.update(copy.deepcopy(Registry.standard().__dict__))
            if config_dir:
                self.load(config_dir)
            yield self
        finally:
            self.__dict__.update(kept)

    def load(self, config_dir: str) -> list[str]:
        """Reads the configuration files of a folder; returns what was wrong with them."""
        from processgraph.sources.notes import read_config

        problems = []
        for path in config_files(config_dir):
            with open(path, encoding="utf-8") as f:
                problems += read_config(self, f.read())
        return problems


def config_files(folder: str) -> list[str]:
    """The folder's files: those of arrows first, then annotations, closures and others, each by name."""
    order = ("arrows", "annotations", "closures")
    names = [n for n in os.listdir(folder) if os.path.isfile(os.path.join(folder, n)) and not n.startswith(".")]
    rank = lambda n: next((k for k, o in enumerate(order) if n.startswith(o)), len(order))
    return [os.path.join(folder, n) for n in sorted(names, key=lambda n: (rank(n), n))]


def config_folder(paths: list[str] = ()) -> str | None:
    """The folder that PROCESSGRAPH_CONFIG names, else the first of the given and the usual ones that exists."""
    named = os.environ.get("PROCESSGRAPH_CONFIG", "")
    usual = [os.path.join(up, "arrows") for up in (".", "..", os.path.join("..", ".."))]
    return next((p for p in [named, *paths, *usual] if p and os.path.isdir(p)), None)
