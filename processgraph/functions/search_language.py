"""The search command language: text to parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from processgraph.registry import Registry

GROUPS = {
    "chapter": "chapter section in contents toc map",
    "context": "context ctx as",
    "arrow": "arrow arrows",
    "from": "from path paths",
    "to": "to",
    "range": "range limit distance",
    "depth": "depth",
    "page": "page",
    "seq": "sequence seq story stories",
    "notes": "notes browse",
    "names": "on about for",
    "finds": "finds finding",
    "stats": "stats",
    "help": "help",
    "remind": "remind",
    "min": "gt min atleast",
    "max": "lt max atmost",
    "never": "never",
    "new": "new",
    "forward": "forward",
    "backward": "backward",
}
OF = {w: g for g, ws in GROUPS.items() for w in ws.split()}
BARE = {"on", "for", "to", "as", "in", "toc", "stats", "help", "forward", "backward"}
KEYWORDS = [("" if w in ("forward", "backward") else "\\") + w for w in OF] + sorted(BARE - {"forward", "backward"})
RECENT, NEVER = 4, -1
NAMES_ALL = "%%"


@dataclass
class Search:
    names: list[str] = field(default_factory=list)
    chapter: str = ""
    context: list[str] = field(default_factory=list)
    arrows: list[int] = field(default_factory=list)
    seq_only: bool = False
    limit: int = 100
    from_node: tuple[int, int] | None = None
    to_node: tuple[int, int] | None = None
    orientation: str = ""
    depth: int = 0
    from_names: list[str] = field(default_factory=list)
    to_names: list[str] = field(default_factory=list)
    stats: bool = False
    horizon: int = 0
    min_limits: list[int] = field(default_factory=list)
    max_limits: list[int] = field(default_factory=list)
    page_nr: int = 0
    range_val: int = 0
    finds: list[str] = field(default_factory=list)


def group(word: str) -> str:
    """The command that a word is, with or without its backslash."""
    return OF.get(word[1:] if word.startswith("\\") else word, "")


def is_keyword(word: str) -> bool:
    return bool(group(word.strip().lower()))


def is_command(word: str, keywords: list[str] = KEYWORDS) -> bool:
    return any(word == k or (len(k) > 5 and word.startswith(k)) for k in keywords)


def something_like(word: str, keywords: list[str] = KEYWORDS) -> str:
    return next((k for k in keywords if word == k or (min(len(word), len(k)) > 4 and word.startswith(k))), word)


def pointer(text: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"\(([0-9]+),([0-9]+)\)", text.strip())
    return (int(m[1]), int(m[2])) if m else None


def literal_pointers(names: list[str]) -> tuple[list[tuple[int, int]], list[str]]:
    """Pointers in parentheses, and what else the names hold."""
    found, rest = [], []
    for name in names:
        for outside, inside in re.findall(r"([^()]*)(?:\(([^)]*)\))?", name):
            if outside.strip():
                rest.append(outside.strip())
            if inside:
                p = pointer(f"({inside.strip()})")
                found.append(p) if p else rest.append(f"({inside})")
    return found, rest


def bracketed(term: str) -> tuple[bool, str]:
    s = term.strip()
    return (True, s[1:-1].strip().replace("'", "''")) if len(s) > 1 and s[0] == "(" and s[-1] == ")" else (False, s)


def bracketed_list(terms: list[str]) -> tuple[bool, list[str]]:
    found = [bracketed(t) for t in terms]
    return any(b for b, _ in found), [f"|{x}|" if b else t for (b, x), t in zip(found, terms)]


def exact(term: str) -> tuple[bool, str]:
    """!x! and |x| are exact."""
    s = term.strip()
    return (True, s.strip("!|").lower()) if s and s[0] == s[-1] and s[0] in "!|" else (False, s)


def any_exact(terms: list[str]) -> bool:
    return any(exact(t)[0] for t in terms)


def is_fragment(s: str) -> bool:
    """Plain text rather than a full-text pattern."""
    if re.search(r"[|&!]|<(?:-|[1-4])>", s) or "<->" in s:
        return False
    return bool(re.search(r"[ \-_'\"]", s)) or len(s) > 12


def term_length(names: list[str]) -> int:
    return max((len(n) for n in names if pointer(n) is None), default=0)


def limits(p: Search) -> tuple[int, int]:
    """(least, most) results that a search asks for."""
    least = p.min_limits[0] if p.min_limits and p.max_limits and len(p.min_limits) == 1 else 1
    if p.range_val > 0:
        return least, p.range_val
    if len(p.max_limits) == 1:
        return least, p.max_limits[0]
    if p.from_names or p.to_names or p.from_node or p.to_node or p.seq_only:
        return least, 30
    if len(p.names) < 3 and any_exact(p.names):
        return least, 30
    return least, 5 if term_length(p.names) < 5 else 10


def dirac(s: str) -> tuple[bool, str, str, str]:
    """<a|b> and <a|ctx|b>: (ok, begin, end, context) with the path from b to a."""
    m = re.fullmatch(r"<([^|<>]+)\|(?:([^|<>]+)\|)?([^|<>]+)>", s.strip())
    return (True, m[3], m[1], m[2] or "") if m else (False, "", "", "")


def split_quotes(s: str) -> list[str]:
    """Words, with quoted and parenthesised parts whole; the sign after such a part is skipped."""
    out, at, word = [], 0, ""
    closing = {'"': '"', "'": "'", "“": "“", "”": "”", "(": ")"}
    while at < len(s):
        c = s[at]
        if c in closing or c == " ":
            if word:
                out.append(word)
            word = ""
            if c != " ":
                end = s.find(closing[c], at + 1)
                end = len(s) if end < 0 else end + 1
                out.append(s[at:end])
                at = end
        else:
            word += c
        at += 1
    return out + [word] * bool(word)


def _any(name: str) -> str:
    return NAMES_ALL if name == "any" else name


def _number(text: str) -> int | None:
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else None


def decode_field(query: str, registry: Registry | None = None) -> Search:
    """The short form: words after a command belong to it up to the next command; other words are names."""
    p, words = Search(), re.sub(r"[ \t]+", " ", query).strip().lower().split(" ")
    if words == [""]:
        return p

    def many() -> list[str]:
        out = []
        while words and not is_keyword(words[0]):
            out.append(words.pop(0))
        return out

    while words:
        w = words.pop(0)
        g = group(w)
        if g == "" or w in ("\\path", "\\paths", "path", "paths"):
            if not g:
                p.names.append(_any(w))
        elif g in ("chapter", "notes") and w.lstrip("\\") in ("chapter", "section", "in", "notes", "browse"):
            if words:
                p.chapter = _any(words.pop(0).strip("\"'"))
        elif g == "context":
            p.context += [x for part in many() for x in (y.strip("\"' ") for y in part.split(",")) if x]
        elif g == "arrow":
            p.arrows += [a.ptr for a in ((registry.by_name(x.strip("\"'")) if registry else None) for x in many()) if a]
        elif g in ("from", "to"):
            if words:
                text = words.pop(0).strip("\"'")
                node = pointer(text)
                if node:
                    setattr(p, f"{g}_node", node)
                else:
                    p.names.append(text)
        elif g in ("range", "page", "depth"):
            if words and (n := _number(words.pop(0))) and n > 0:
                setattr(p, "depth" if g == "depth" else "limit", n)
        elif g == "seq":
            p.seq_only = True
        elif g in ("forward", "backward"):
            p.orientation = g
        elif g == "names":
            p.names += [_any(x.strip("\"'")) for x in many()]
        elif g == "finds":
            p.names += many()
    return p


def fill(parts: list[list[str]], registry: Registry | None = None, keywords: list[str] = KEYWORDS) -> Search:
    p = Search()
    for part in parts:
        at = 0

        def params(most: int | None = None) -> list[str]:
            nonlocal at
            out = []
            while at + 1 < len(part) and not is_command(part[at + 1], keywords) and (most is None or len(out) < most):
                at += 1
                out.append(part[at])
            return out

        while at < len(part):
            word = something_like(part[at], keywords)
            g = group(word)
            if g == "stats":
                p.stats = True
            elif g == "help":
                p.chapter = "help"
                p.names.append("any")
            elif g in ("chapter", "notes"):
                got = params(1)
                if got:
                    p.chapter = _any(got[0].strip('"'))
                else:
                    (p.to_names or p.from_names or p.names).append(word)
            elif g in ("page", "range", "depth"):
                got = params(1)
                if got and (n := _number(got[0])) and n > 0:
                    setattr(p, {"page": "page_nr", "range": "range_val", "depth": "depth"}[g], n)
            elif g in ("min", "max"):
                got = params(1)
                if got and (n := _number(got[0])) is not None:
                    getattr(p, f"{g}_limits").append(n)
            elif g == "arrow":
                p.arrows += [a.ptr for a in ((registry.by_name(x.strip('"')) if registry else None) for x in params()) if a]
            elif g == "context":
                p.context += [x.strip() for y in params() for x in y.strip('"').split(",") if x.strip()]
            elif g in ("from", "to", "finds"):
                getattr(p, {"from": "from_names", "to": "to_names", "finds": "finds"}[g]).extend(x.strip('"') for x in params())
            elif g == "seq":
                p.seq_only = True
            elif g == "new":
                p.horizon = RECENT
            elif g == "never":
                p.horizon = NEVER
            elif g == "remind":
                p.chapter = "reminders"
            elif g == "names":
                p.names += [_any(x.strip('"')) for x in params()]
            else:
                p.names.append(_any(part[at].strip('"')))
            at += 1
    real = [n for n in p.names if n not in (NAMES_ALL, "any")]
    if real:
        p.names = real
    return p


def decode_command(command: str, registry: Registry | None = None, keywords: list[str] = KEYWORDS) -> Search:
    """The long form, with quotes, limits and <a|b>."""
    parts: list[list[str]] = []
    part: list[str] = []
    for k, piece in enumerate(split_quotes(re.sub(r"[ \t]+", " ", command.lower()).strip())):
        for j, word in enumerate(split_quotes(piece)):
            inside = (k > 0 and word == "to") or (j > 0 and word.startswith("to"))
            if is_command(word, keywords) and not inside and part:
                parts.append(part)
                part = []
            part.append(word)
    p = fill(parts + [part] * bool(part), registry, keywords)
    for name in p.names:
        ok, begin, end, context = dirac(name)
        if ok:
            p.names, p.from_names, p.to_names = [], [begin], [end]
            p.context = [context] if context else p.context
            break
    return p


def help_query(name: str) -> str:
    return '\\notes \\chapter "help and search" \\limit 40' if name == "\\help" else name


def pointer_query(name: str, cls: str, cptr: str) -> str:
    return f"({int(cls)},{int(cptr)})" if not name and _number(cls) is not None and _number(cptr) is not None else name


def remind_query(name: str, when: str, key: str) -> str:
    return f"any \\chapter reminders \\context any, {key} {when} \\limit 20" if name in ("", "\\remind") else name


def concept_query(name: str) -> str:
    return re.sub(r"\\(?:dna|concepts?|terms) ", lambda _: "any \\arrow contains \\limit 20 ", name)


def route(p: Search) -> str:
    """Which handler answers: the first rule that fits."""
    if not (p.names or p.chapter or p.context or p.from_node or p.to_node or p.seq_only):
        return "stats"
    if p.chapter and not p.names and not p.from_node:
        return "chapters"
    if p.from_node and p.to_node:
        return "paths"
    if p.seq_only and p.names:
        return "stories"
    if p.names and p.orientation:
        return "cone"
    if p.arrows:
        return "arrows"
    return "orbit" if p.names else "error"
