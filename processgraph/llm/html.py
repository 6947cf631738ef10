"""Main text of HTML pages from shallow features of flat text blocks.

A page is cut into blocks at the tags that break lines; tags inside a line don't cut. A block has a
number of words and a link density, the share of its words inside links. A decision tree over these two
of a block and its two neighbours says which blocks are main text. The tree is grown on LABELLED, a
small table of pages with a label for each block.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages as (words, words in links, main text or not) of their blocks in order.
LABELLED: list[list[tuple[int, int, int]]] = [
    [(1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (8, 0, 0), (9, 0, 1), (7, 0, 1), (140, 2, 1), (96, 0, 1), (12, 0, 1), (70, 0, 1), (11, 1, 0)],
    [(2, 2, 0), (1, 1, 0), (3, 3, 0), (12, 0, 0), (14, 0, 1), (60, 0, 1), (4, 0, 1), (33, 0, 1), (1, 0, 1), (85, 3, 1), (2, 0, 1), (9, 0, 0)],
    [(1, 1, 0), (2, 2, 0), (1, 1, 0), (5, 0, 0), (3, 0, 1), (25, 0, 1), (41, 0, 1), (18, 0, 1), (7, 0, 0)],
    [(4, 4, 0), (3, 3, 0), (2, 2, 0), (6, 0, 0), (11, 0, 1), (11, 0, 1), (210, 0, 1), (3, 0, 1), (6, 0, 1), (180, 4, 1), (14, 0, 0)],
    [(1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (10, 0, 0), (8, 0, 1), (8, 0, 1), (29, 0, 1), (12, 0, 0)],
    [(1, 1, 0), (1, 1, 0), (9, 0, 0), (13, 0, 1), (5, 0, 1), (2, 0, 1), (7, 0, 1), (6, 0, 0)],
    [(12, 10, 0), (15, 0, 1), (120, 3, 1), (8, 8, 0), (9, 9, 0), (150, 1, 1), (44, 0, 1), (5, 5, 0), (7, 6, 0), (6, 6, 0), (10, 2, 0)],
    [(3, 3, 0), (14, 0, 0), (6, 0, 1), (22, 1, 1), (35, 0, 1), (16, 15, 0), (12, 12, 0), (13, 0, 0)],
    [(1, 1, 0), (2, 2, 0), (1, 1, 0), (7, 0, 0), (10, 0, 1), (1, 0, 1), (92, 0, 1), (1, 0, 1), (1, 0, 1), (64, 0, 1), (8, 0, 0)],
    [(30, 0, 1), (45, 0, 1)],
    [(200, 0, 1)],
    [(6, 6, 0), (4, 4, 0), (5, 5, 0), (20, 18, 0), (9, 1, 0)],
    [(1, 1, 0), (1, 1, 0), (6, 0, 0), (12, 0, 1), (9, 0, 1), (10, 0, 1), (11, 0, 1), (8, 0, 1), (9, 0, 0)],
    [(2, 2, 0), (2, 2, 0), (11, 0, 0), (4, 0, 1), (300, 0, 1), (15, 0, 0)],
]
DEPTH, LEAF = 6, 1
#: Attributes, whose quoted values may hold any sign; where a quote has no end, what there is up to the next bracket.
_ATTRS = r"""(?:(?>(?:[^<>"']|"[^"]*"|'[^']*')*)>|[^<>]*>)"""
_TOKEN = re.compile(rf"<!--|<(script|style|noscript|template|title|svg)(?=[\s/>]){_ATTRS}|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>]){_ATTRS}|<[!?][^<>]*>", re.S | re.I)
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "title", "svg")}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, words, words in links) of each block that has a word. Comments, scripts, styles and the title have none.

    A comment or script that never ends loses its mark only, and what follows is text; the head has no other text than the
    title's and needs no end. Values of attributes may hold brackets. A link ends with its block.
    """
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = 0
    link, at, comments = False, 0, True

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            clean = entities.unescape(raw)
            parts.append(clean)
            if link:
                linked += len(clean.split())

    def flush() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            out.append((" ".join(words), len(words), min(linked, len(words))))
        parts.clear()
        linked = 0

    open_ = dict.fromkeys(_CLOSED, True)  # False once a name has no end tag any more
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        if m.group() == "<!--":
            end = page.find("-->", at) if comments else -1
            comments = end >= 0
            at = end + 3 if comments else at
            continue
        if skipped := (m.group(1) or "").lower():
            end = _CLOSED[skipped].search(page, at) if open_[skipped] else None
            open_[skipped] = end is not None
            at = end.end() if end else at
        name = (m.group(3) or "").lower()
        if name == "a":
            link = not m.group(2)
        elif name and name not in _INLINE or m.group(1):
            flush()
            link = False
    text(page[at:])
    flush()
    return out


def features(words: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Words and link density of each block, of the one before and the one after; 0 where there is none."""
    density = linked / np.maximum(words, 1)
    out = np.zeros((len(words), 6))
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple:
    """A tree of (feature, threshold, at most, above) and leaves (label,), by Gini impurity; of equal splits the first counts."""
    label = (int(y.mean() >= 0.5),)
    if depth == 0 or len(set(y)) < 2:
        return label
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            n = low.sum()
            if min(n, len(y) - n) < LEAF:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(t), low
    if best is None:
        return label
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def learn(pages: list[list[tuple[int, int, int]]] = LABELLED) -> tuple:
    table = [np.array(p, float) for p in pages if p]
    return grow(np.concatenate([features(p[:, 0], p[:, 1]) for p in table]), np.concatenate([p[:, 2] for p in table]))


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), bool(tree[0]))
    f, t, low, high = tree
    side = x[:, f] <= t
    return np.where(side, decide(low, x), decide(high, x))


def main_text(page: str, tree: tuple) -> tuple[str, int, int]:
    """The main blocks, one a line, how many they are, and how many blocks there were."""
    found = blocks(page)
    if not found:
        return "", 0, 0
    words, linked = np.array([b[1] for b in found], float), np.array([b[2] for b in found], float)
    keep = decide(tree, features(words, linked))
    lines = [b[0] for b, k in zip(found, keep) if k]
    return "\n".join(lines), len(lines), len(found)


def extract(pages: DataFrame, tree: tuple | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_main, n_blocks), one row for each row of pages, in one pass without a shuffle.

    A null page has null text and 0 blocks, an empty one empty text; broken markup is read as it stands,
    pages of any length whole. A leaf of the tree with as many main blocks as others counts as main. Repeated rows give repeated rows, null ids stay null, no rows give no
    rows, other columns are not read.
    """
    tree = tree or learn()
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(None, 0, 0) if p is None else main_text(p, tree) for p in batch.column(1).to_pylist()]
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["page_id", "text", "n_main", "n_blocks"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string")).mapInArrow(run, f"page_id {kind}, text string, n_main int, n_blocks int")
