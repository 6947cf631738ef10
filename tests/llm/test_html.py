import html as entities
import random

import numpy as np
from processgraph.llm import html as H

PAGE = """<html><head><title>no</title></head><body><nav><ul><li><a href=x>Home</a></li><li><a>News</a></li><li><a>More</a></li></ul></nav>
<!-- ad --><div class=ad>Buy now our seven new things today</div><article><h1>A title of some six words</h1>
<p>%s<br>%s <b>bold</b> &amp; more</p><script>var t="</p>";</script></article><footer>&copy; 2020 some company or other</footer></body></html>"""
LONG = " ".join(["sentence"] * 40)


def test_main_text():
    text, kept, n = H.main_text(PAGE % (LONG, LONG), H.learn())
    assert text.split("\n") == ["A title of some six words", LONG, LONG + " bold & more"] and (kept, n) == (3, 8)


def test_blocks_count_links_and_survive_broken_markup():
    assert H.blocks("a <a>b c</a> d<p>e") == [("a b c d", 4, 2), ("e", 1, 0)]
    assert H.blocks("x<!-- never ends <p>y") == [("x never ends", 3, 0), ("y", 1, 0)]
    assert H.blocks("x<script>never ends") == [("x", 1, 0), ("never ends", 2, 0)]
    assert H.blocks("<html><head><title>t</title><body><p>one<p>two") == [("one", 1, 0), ("two", 1, 0)]
    assert H.blocks("""<a title="a > b" href='q>r'>link</a> z""") == [("link z", 2, 1)]
    assert H.blocks('<p title="no end>one<p>two') == [("one", 1, 0), ("two", 1, 0)]
    assert H.blocks("1 < 2 <<<< 3") == [("1 < 2 <<<< 3", 5, 0)]
    assert H.blocks("<a>one<p>two") == [("one", 1, 1), ("two", 1, 0)]


def test_tree_fits_its_table_and_is_gini_best():
    table = [np.array(p, float) for p in H.LABELLED]
    x, y = np.concatenate([H.features(p[:, 0], p[:, 1]) for p in table]), np.concatenate([p[:, 2] for p in table])
    assert (H.decide(H.learn(), x) == y.astype(bool)).mean() >= 0.97
    x, y = np.array([[0.0, 5], [1, 5], [2, 5], [3, 5]]), np.array([0, 0, 1, 1])
    assert H.grow(x, y) == (0, 1.5, (0,), (1,))


def test_held_out_pages():
    rng, tree, right, total = np.random.default_rng(5), H.learn(), 0, 0
    for _ in range(60):
        body = [" ".join(["w"] * int(n)) for n in rng.integers(1, 120, rng.integers(2, 8))]
        page = "".join(f"<li><a>{'n ' * int(k)}</a></li>" for k in rng.integers(1, 3, 5)) + "<div>some words of an ad here</div><h1>the title of this page is here</h1>" + "".join(f"<p>{b}</p>" for b in body) + "<footer>all rights reserved by some company</footer>"
        got = H.main_text(page, tree)[0].split("\n")
        right += got == ["the title of this page is here", *body]
        total += 1
    assert right >= 0.85 * total


def test_tables(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", PAGE % (LONG, LONG)), (3, "u", PAGE % (LONG, LONG)), (None, "u", "<p>x</p>"), (4, "u", "<" * 100_000), (5, "u", "<!--" * 30_000), (6, "u", "<div>" * 30_000 + LONG)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = H.extract(pages).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[1].text is None and by[1].n_blocks == 0 and by[2].text == "" and by[3].n_main == 3 and by[6].text == LONG
    assert H.extract(pages.limit(0)).count() == 0


def slow_blocks(page):
    """Sign by sign, for markup that is closed."""
    out, words, linked, raw, link, k = [], [], 0, "", False, 0

    def close():
        nonlocal raw, linked
        own = entities.unescape(raw).split()
        linked += len(own) if link else 0
        words.append(raw)
        raw = ""

    def flush():
        nonlocal linked
        all_ = entities.unescape("".join(words)).split()
        if all_:
            out.append((" ".join(all_), len(all_), min(linked, len(all_))))
        words.clear()
        linked = 0

    while k < len(page):
        if page[k] != "<":
            raw += page[k]
            k += 1
            continue
        close()
        if page.startswith("<!--", k):
            k = page.index("-->", k) + 3
            continue
        end, quote = k + 1, ""
        while quote or page[end] != ">":
            quote = "" if page[end] == quote else page[end] if not quote and page[end] in "\"'" else quote
            end += 1
        tag = page[k + 1 : end].split()[0].rstrip("/").lower()
        k = end + 1
        if tag in ("script", "style", "title"):
            k = page.index(f"</{tag}>", k) + len(tag) + 3
            flush()
            link = False
        elif tag.strip("/") == "a":
            link = tag == "a"
        elif tag.strip("/") not in H._INLINE:
            flush()
            link = False
    close()
    flush()
    return out


def test_blocks_and_decisions_against_brute_force():
    rng, tree = random.Random(3), H.learn()
    pieces = ["<p>", "</p>", "<div class='a > b'>", "</div>", "<a href=\"x?a=1>2\">", "</a>", "<b>", "</b>", "<br/>", "<!-- c <p> -->", "<script>if (a<b) x</script>", "<title>t</title>", "word ", "two words ", "&amp; ", "<li>", "long " * 12, "\n"]
    for _ in range(400):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40)))
        want = slow_blocks(page)
        assert H.blocks(page) == want, page
        keep = []
        for i in range(len(want)):
            x = [v for j in (i, i - 1, i + 1) for v in ((want[j][1], want[j][2] / want[j][1]) if 0 <= j < len(want) else (0, 0))]
            node = tree
            while len(node) > 1:
                node = node[2] if x[node[0]] <= node[1] else node[3]
            keep.append(bool(node[0]))
        lines = [b[0] for b, k in zip(want, keep) if k]
        assert H.main_text(page, tree) == ("\n".join(lines), len(lines), len(want))
