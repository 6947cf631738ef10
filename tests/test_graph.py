import random

import pytest
from processgraph.engine import Focus, command, focal, path_text, query, tree_lines
from processgraph.graph import Graph, GraphBuilder
from processgraph.operators import analytics as A
from processgraph.operators import paths as P
from processgraph.registry import Registry
from pyspark.sql import functions as F


def registry():
    r = Registry.standard()
    r.pair("contains", "has", "contains element", "in", "element of")
    r.pair("properties", "note", "is noted as", "isnote", "is a note for")
    ptr = r.insert("similarity", "near", "is similar to")
    r.invert(ptr, ptr)
    return r


def graph(spark, edges, chapter="test"):
    with GraphBuilder(spark, registry()) as b:
        for e in edges:
            for text in (e[0], e[2]):
                b.vertex(text, chapter)
            b.edge(*e)
    return b.graph


def ids(g):
    return {r.text: r.nid for r in g.nodes.collect()}


def names(g, paths, column="path"):
    back = {v: k for k, v in ids(g).items()}
    return [[back[x] for x in r[column]] for r in paths.collect()]


@pytest.fixture(scope="module")
def epidemic(spark):
    e = [("spillover", "first case"), ("first case", "cluster"), ("cluster", "community spread"), ("community spread", "surge"), ("surge", "case decline"), ("cluster", "border closure"), ("border closure", "case decline")]
    return graph(spark, [(a, "then", b) for a, b in e])


def test_build_registers_inverses_and_dedupes(spark):
    g = graph(spark, [("a", "then", "b"), ("a", "then", "b"), ("a", "then", "b", ["x", "y"], 2.0), ("a", "near", "c"), ("one two", "has", "a")])
    assert g.nodes.count() == 4 and g.links.count() == 8
    assert [(r["class"], r.cptr, r.text) for r in g.ordered().collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "one two")]
    assert g.registry.contexts == ["any", "x,y"]
    assert {r.chapter for r in g.chapters().collect()} == {"test"}
    assert g.stats().first() == (4, 8)


def test_chapter_rules_and_unknown_arrow(spark):
    b = GraphBuilder(spark, registry())
    b.vertex("a", "")
    b.vertex("a", "late")
    b.vertex("a", "later")
    assert b.build().nodes.first().chapter == "late"
    with pytest.raises(ValueError):
        b.edge("a", "no such", "b")


def test_hub(spark):
    with GraphBuilder(spark, registry()) as b:
        b.hub("hub", "c", ["x", "y", "z"], "then", weights=[0.5])
    w = {r.src_text: r.wgt for r in b.graph.named_links().where("dst_text = 'hub'").collect()}
    assert w == {"x": 0.5, "y": 1.0, "z": 1.0}


def test_save_and_load(spark, tmp_path, epidemic):
    epidemic.save(str(tmp_path / "g"))
    g = Graph.load(spark, str(tmp_path / "g"))
    assert g.stats().first() == epidemic.stats().first() and g.registry.by_name("then") == epidemic.registry.by_name("then")
    assert g.registry.inverse == epidemic.registry.inverse


def test_cones(spark, epidemic):
    i = ids(epidemic)
    cone = P.forward_cone(epidemic.links, i["spillover"], 5)
    assert names(epidemic, cone)[-1][-1] in i and cone.count() == 7
    assert P.backward_cone(epidemic.links, i["case decline"], 2).count() == 4
    paths = names(epidemic, P.find_paths(epidemic.links, i["spillover"], i["case decline"]))
    assert sorted(map(len, paths)) == [5, 6]
    assert P.forward_cone(epidemic.links, i["spillover"], 5, 3).count() == 3
    assert P.forward_cone(epidemic.links, i["spillover"], 0).count() == 0


def dfs(adj, start, depth, limit):
    """The recursive walk that the frontier has to agree with."""
    out = []

    def visit(path, left):
        for _, dst in sorted(adj.get(path[-1], [])):
            if len(out) >= limit or left == 0:
                return
            if dst not in path:
                out.append([*path, dst])
                visit([*path, dst], left - 1)

    visit([start], depth)
    return out[:limit]


@pytest.mark.parametrize("seed", range(3))
def test_cone_with_limit_is_the_depth_first_walk(spark, seed):
    r = random.Random(seed)
    rows = sorted({(f"v{r.randrange(9)}", f"v{r.randrange(9)}") for _ in range(26)})
    links = spark.createDataFrame([(a, 5, k, 1, 1.0, 0, b) for k, (a, b) in enumerate(rows) if a != b], "src string, stindex tinyint, ord bigint, arr int, wgt float, ctx int, dst string")
    adj = {}
    for x in links.collect():
        adj.setdefault(x.src, []).append((x.ord, x.dst))
    for limit in (5, 40):
        got = [x.path for x in P.forward_cone(links, rows[0][0], 4, limit).orderBy("key").collect()]
        assert got == dfs(adj, rows[0][0], 4, limit)


def test_weighted_goldens(spark):
    e = [("start", "then", "A", [], 1.0), ("start", "then", "B", [], 5.0), ("A", "then", "C", [], 2.0), ("B", "then", "end", [], 1.0), ("C", "then", "end", [], 3.0)]
    g = graph(spark, e)
    i = ids(g)
    best = P.shortest(g.links, i["start"], i["end"])
    assert names(g, best) == [["start", "B", "end"]] and best.first().total_weight == 6.0
    found = P.weighted_search(g.links.where("stindex = 5"), i["start"], 3)
    assert sorted(r.total_weight for r in found.collect()) == [1.0, 3.0, 5.0, 6.0, 6.0]
    top = P.rank_by_weight(found).first()
    assert top.total_weight == 6.0


def test_dijkstra_prefers_heavy_links(spark):
    g = graph(spark, [("A", "then", "B", [], 1.0), ("B", "then", "D", [], 1.0), ("A", "then", "C", [], 0.5), ("C", "then", "D", [], 2.0)])
    i = ids(g)
    assert names(g, P.shortest(g.links, i["A"], i["D"])) == [["A", "B", "D"]]
    assert P.shortest(g.links, i["A"], 10**9).count() == 0


def test_axial_and_supernodes(spark):
    g = graph(spark, [("la", "then", "lb"), ("lb", "then", "lc"), ("lc", "then", "ld"), ("lc", "has", "ld")])
    i, then = ids(g), g.registry.by_name("then").ptr
    assert [r.node for r in P.axial_path(g.links, i["la"], then).orderBy("step").collect()] == [i["lb"], i["lc"], i["ld"]]
    assert P.axial_paths(g.links, then).where(F.col("root") == i["la"]).count() == 3
    d = graph(spark, [("top", "then", "left"), ("top", "then", "right"), ("left", "then", "bottom"), ("right", "then", "bottom")])
    assert P.supernodes(P.forward_cone(d.links, ids(d)["top"])).count() == 3


def test_spliced_paths(spark):
    g = graph(spark, [("A", "then", "B"), ("B", "then", "C"), ("C", "then", "D")])
    i, inv = ids(g), g.registry.inverse
    assert names(g, P.paths_and_symmetries(g.links, [i["A"]], [i["D"]], inv)) == [["A", "B", "C", "D"]]
    assert P.paths_and_symmetries(g.links, [i["A"]], [i["B"]], inv, compat=True).count() == 0
    back = {v: k for k, v in i.items()}
    old = P.paths_and_symmetries(g.links, [i["A"]], [i["D"]], inv, compat=True).collect()
    assert [[back[x.dst] for x in r.links] for r in old] == [["B", "C"], ["B", "C"]]


def test_loops(spark):
    p = spark.createDataFrame([(1, ["a", "b", "a", "c", "b"])], "path_id int, path array<string>")
    assert sorted(r.loop for r in P.path_loops(p).collect()) == [["a", "b", "a"], ["b", "a", "c", "b"]]
    adj = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "d", 1.0), ("c", "b", 1.0)], "src string, dst string, weight double")
    assert sorted(r.cycle for r in A.cycles(adj).collect()) == [["a", "b", "c"], ["b", "c"], ["d"]]


def test_centralities(spark):
    star = spark.createDataFrame([("b", x, 1.0) for x in "acde"] + [(x, "b", 1.0) for x in "acde"], "src string, dst string, weight double")
    evc = {r.node: r.evc for r in A.eigenvector(star).collect()}
    assert evc["b"] == 1.0 or evc["a"] == 1.0
    assert {r.node: r.betweenness for r in A.betweenness(star).collect()} == {"a": 0, "b": 12, "c": 0, "d": 0, "e": 0}
    web = spark.createDataFrame([(a, b, 1.0) for a, b in [("sun", "grass"), ("grass", "hare"), ("hare", "fox")]], "src string, dst string, weight double")
    s = A.summary(web)
    assert (s["nodes"], s["links"], s["sources"], s["sinks"]) == (4, 3, 1, 1)
    assert A.sources(web).first().node == "sun" and A.sinks(web).first().node == "fox"


def test_food_web_vector_resets(spark):
    """On a graph without cycles the vector of zeros starts again: after 100 steps every value is 1 / n."""
    names_ = ["sunlight", "algae", "krill", "fish", "eagle"]
    web = spark.createDataFrame([(a, b, 1.0) for a, b in zip(names_, names_[1:])], "src string, dst string, weight double")
    assert {round(r.evc, 4) for r in A.eigenvector(web, 10).collect()} == {0.2}


def test_types_and_warnings(spark):
    g = graph(spark, [("e1", "then", "e2"), ("box", "has", "thing"), ("x", "note", "y")])
    t = {r.node: (r.e, r.t, r.c) for r in A.infer_types(g.links).collect()}
    i = ids(g)
    assert t[i["e1"]] == (True, False, False) and t[i["box"]] == (False, True, False) and t[i["x"]] == (False, True, True) and t[i["y"]] == (False, True, False)
    assert A.type_warnings(A.infer_types(g.links), g.links).count() == 0
    wrong = A.infer_types(g.links).withColumn("e", F.lit(True))
    assert {r.node for r in A.type_warnings(wrong, g.links).collect()} == {i[k] for k in ("box", "thing", "x", "y")}


def test_inferences(spark):
    g = graph(spark, [("a", "then", "b", [], 2.0), ("b", "then", "c", [], 3.0), ("p", "near", "q"), ("p", "near", "r")])
    then = g.registry.by_name("then").ptr
    rules = spark.createDataFrame([(then, then, then, 5)], "first int, second int, result int, stindex tinyint")
    i = ids(g)
    assert [(r.src, r.dst, r.wgt) for r in A.closures(g.links, rules).collect()] == [(i["a"], i["c"], 6.0)]
    assert {(r.src, r.dst) for r in A.closeness(g.links).collect()} >= {(i["q"], i["r"]), (i["r"], i["q"])}
    c = graph(spark, [("Apple", "then", "apple"), ("other", "then", "apple")])
    assert A.caps_variants(c.nodes).count() == 2
    both = g.with_links(A.closures(g.links, rules))
    assert both.links.count() == g.links.count() + 1


def test_orbit_hierarchy_and_focus(spark):
    g = graph(spark, [("root", "has", "kid"), ("root", "has", "kid2"), ("kid", "has", "leaf")])
    i = ids(g)
    assert {r.node for r in A.hierarchy_roots(g.links).collect()} == {i["root"]}
    assert focal(g, i["kid"]) == {"root": i["kid"], "children": [i["leaf"]], "parent": i["root"]}
    f = Focus(g, i["root"]).down(i["kid"])
    assert f.view["root"] == i["kid"] and f.up().view["root"] == i["root"]
    with pytest.raises(ValueError):
        f.up()
    with pytest.raises(ValueError):
        f.down(i["leaf"])
    assert tree_lines(g.links, i["root"], g.nodes) == ["  kid", "    leaf", "  kid2"]
    orbit = {(r.text, r.radius) for r in A.orbit(P.forward_cone(g.links, i["root"], 3), g.nodes).collect()}
    assert orbit == {("kid", 1), ("kid2", 1), ("leaf", 2)}
    own = A.appointed_by_arrow(g.links, g.registry.by_name("in").ptr, g.registry.inverse).collect()
    assert {r.node: r.members for r in own} == {i["root"]: [i["kid"], i["kid2"]], i["kid"]: [i["leaf"]]}


def test_commands(spark, epidemic):
    assert query(epidemic, "").first() == epidemic.stats().first()
    assert query(epidemic, "spillover").count() > 0
    assert query(epidemic, "spillover forward \\depth 2").count() == 3
    a = epidemic.by_name("spillover").first()
    b = epidemic.by_name("case decline").first()
    assert query(epidemic, f"\\from ({a['class']},{a.cptr}) \\to ({b['class']},{b.cptr})").count() == 2
    assert command(epidemic, '\\from spillover \\to "cluster"').count() == 1
    lines = [r.line for r in path_text(epidemic, P.forward_cone(epidemic.links, a.nid, 1)).collect()]
    assert lines == ["-(then)-> first case"]


def test_co_depth_groups(spark):
    rows = [(1, ["a", "b"]), (2, ["c", "b"]), (3, ["d", "e"])]
    p = spark.createDataFrame([(k, [(0, 1.0, 0, x) for x in v]) for k, v in rows], "path_id int, links array<struct<arr:int,wgt:float,ctx:int,dst:string>>")
    groups = {r.node: r.grp for r in A.co_depth_groups(p, 5).collect()}
    assert groups == {"a": "a", "c": "a", "d": "a", "b": "b", "e": "b"}
    assert {tuple(r.nodes) for r in A.transverse_supernodes(p).collect()} == {("b",)}


def test_remove_chapter(spark):
    with GraphBuilder(spark, registry()) as b:
        b.vertex("a", "one")
        b.vertex("b", "two")
        b.edge("a", "then", "b")
    g = b.graph.remove_chapter("one")
    assert [r.text for r in g.nodes.collect()] == ["b"] and g.links.count() == 1
    with pytest.raises(ValueError):
        g.remove_chapter("")


def _axial(links: list[tuple], limit: int) -> set[tuple]:
    """Walks one after the other: always the first link whose end wasn't visited."""
    out = set()
    for root in {a for a, _, _ in links}:
        at, seen = root, [root]
        for step in range(1, limit + 1):
            options = sorted((o, b) for a, o, b in links if a == at and b not in seen)
            if not options:
                break
            at = options[0][1]
            seen.append(at)
            out.add((root, step, at))
    return out


@pytest.mark.parametrize("shape", ["chains", "rings", "tree", "choices", "mixed up"])
def test_axial_walks_one_by_one(spark, monkeypatch, shape):
    rng = random.Random(shape)
    names_ = [f"v{k}" for k in range(600 if shape == "chains" else 120)]
    rng.shuffle(names_)
    pairs = [(a, b) for a, b in zip(names_, names_[1:]) if rng.random() < 0.97] + [("self", "self")]
    if shape == "rings":
        pairs = list(zip(names_[:50], names_[1:50] + names_[:1])) + list(zip(names_[50:], names_[51:] + names_[50:51]))
    elif shape == "tree":
        pairs = [(names_[k], names_[rng.randrange(k)]) for k in range(1, 60)]
    elif shape == "choices":
        pairs = list({(rng.choice(names_[:30]), rng.choice(names_[:30])) for _ in range(70)})
    if shape != "chains":
        rng.shuffle(pairs)
    links = [(a, k, b) for k, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame([(a, 5, o, 3, 1.0, 0, b) for a, o, b in links], "src string, stindex tinyint, ord long, arr int, wgt float, ctx int, dst string").repartition(1 if shape == "chains" else 5)
    if shape in ("chains", "rings", "mixed up"):  # no step by step
        monkeypatch.setattr(P, "_axial_steps", None)
    for limit in (100, 9) if shape in ("chains", "rings") else (9,):
        assert {tuple(r) for r in P.axial_paths(df, 3, limit).collect()} == _axial(links, limit)


def _betweenness(pairs: set[tuple]) -> dict:
    """By its definition, of numbers and lengths of shortest paths between all nodes."""
    nodes, dist, ways = {x for p in pairs for x in p}, {}, {}
    for s in nodes:
        dist[s, s], ways[s, s], front = 0, 1, [s]
        while front:
            nxt = []
            for a, b in ((a, b) for a in front for x, b in pairs if x == a and a != b):
                if (s, b) not in dist:
                    dist[s, b], ways[s, b] = dist[s, a] + 1, 0
                    nxt.append(b)
                if dist[s, b] == dist[s, a] + 1:
                    ways[s, b] += ways[s, a]
            front = nxt
    on = lambda s, v, t: (s, v) in dist and (v, t) in dist and dist[s, v] + dist[v, t] == dist[s, t]
    return {v: round(sum(ways[s, v] * ways[v, t] / ways[s, t] for s, t in dist if v not in (s, t) and s != t and on(s, v, t)), 6) for v in nodes}


@pytest.mark.parametrize("limit", [0, 200_000])
def test_betweenness_by_its_definition(spark, limit):
    rng = random.Random(4)
    pairs = {(f"a{rng.randrange(12)}", f"a{rng.randrange(12)}") for _ in range(26)} | {(f"a{rng.randrange(12)}", f"leaf{k}") for k in range(20)} | {("hub", f"own{k}") for k in range(3)} | {("lone", "lone")}
    adj = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    assert {r.node: round(r.betweenness, 6) for r in A.betweenness(adj, limit).collect()} == _betweenness(pairs)


def test_betweenness_of_more_pairs_than_a_task_may_hold(spark):
    n = F.col("id")
    pairs = spark.range(200_100).select((n % 50 + 10**6).alias("src"), n.alias("dst"), F.lit(1.0).alias("weight"))
    pairs = pairs.unionByName(spark.createDataFrame([(-1, 10**6 + k, 1.0) for k in range(50)], "src long, dst long, weight double"))
    got = A.betweenness(pairs)
    assert got.count() == 200_151 and {r.betweenness for r in got.where("betweenness > 0").collect()} == {4002.0}


@pytest.mark.parametrize("limit", [0, 200_000])
def test_eigenvector_step_by_step(spark, monkeypatch, limit):
    rng = random.Random(3)
    pairs = {(f"a{rng.randrange(9)}", f"a{rng.randrange(9)}"): rng.randrange(1, 4) for _ in range(20)}
    pairs |= {(f"a{rng.randrange(9)}", f"leaf{k}"): rng.randrange(1, 3) for k in range(30)} | {(f"leaf{k}", f"a{k % 9}"): 1 for k in range(15)} | {(f"source{k}", f"a{k}"): 2 for k in range(4)}
    nodes = {x for p in pairs for x in p}
    v = dict.fromkeys(nodes, 1.0)
    for _ in range(6):
        new = {x: sum(w * v[a] for (a, b), w in pairs.items() if b == x) for x in nodes}
        v = {x: y / max(new.values()) for x, y in new.items()}
    adj = spark.createDataFrame([(a, b, float(w)) for (a, b), w in pairs.items()], "src string, dst string, weight double")
    times = []
    own = A.cut
    monkeypatch.setattr(A, "cut", lambda df: times.append(1) or own(df))
    got = {r.node: round(r.evc, 9) for r in A.eigenvector(adj, 6, 0.0, limit).collect()}
    assert got == {x: round(y, 9) for x, y in v.items()}
    assert limit == 0 or len(times) == 3


def test_closeness_of_nodes_with_several_neighbours(spark):
    rng = random.Random(5)
    near = {(f"n{rng.randrange(6)}", rng.randrange(2), f"d{rng.randrange(12)}") for _ in range(40)} | {(f"own{k % 2}", 1, f"e{k}") for k in range(8)}
    rows = [(a, 4, 0, r, 1.0, 0, d) for a, r, d in near] * 2 + [("n0", 5, 0, 1, 1.0, 0, "x"), ("n0", 5, 0, 1, 1.0, 0, "y")]
    got = [(r.arr, r.src, r.dst) for r in A.closeness(spark.createDataFrame(rows, "src string, stindex tinyint, ord long, arr int, wgt float, ctx int, dst string")).collect()]
    assert sorted(got) == sorted({(r, d, e) for a, r, d in near for b, q, e in near if (a, r) == (b, q) and d != e})


def test_closeness_does_not_shuffle_pairs(spark):
    rows = [(f"n{k % 5}", 4, 0, 1, 1.0, 0, f"d{k}") for k in range(100)]
    out = A.closeness(spark.createDataFrame(rows, "src string, stindex tinyint, ord long, arr int, wgt float, ctx int, dst string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 2 and out.count() == 5 * 20 * 19


def test_sums_over_many_rows_are_divided_among_more_tasks(spark, monkeypatch):
    from processgraph.plans import catalogue
    from processgraph.plans import views as V

    sf = "/root/testdata/sf0.001"
    for name in ("adjacency", "symmetrize"):
        monkeypatch.setattr(V, "ROWS", 500_000)
        want = sorted(map(tuple, catalogue.QUERIES[name](spark, sf).collect()))
        monkeypatch.setattr(V, "ROWS", 1000)
        out = catalogue.QUERIES[name](spark, sf)
        assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect())) == want
