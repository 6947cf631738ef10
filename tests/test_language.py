from datetime import datetime

import pytest
from processgraph.functions import codecs as K
from processgraph.functions import search_language as L
from processgraph.functions import timesem as T
from processgraph.operators import search
from processgraph.registry import Registry, channel, compile_context, stindex_by_name, stindex_label
from processgraph.sources import notes as N


def config():
    r = Registry.standard()
    text = """
- leadsto
 + forward (fwd) - back (bk)   # a comment
- contains
 + contain (contain) - belongs to (belong)
- properties
 + note remark (note) - is a note for (isnotefor)
- similarity
 similar to (ll)
- annotations
 % (note)
"""
    assert N.read_config(r, text) == []
    return r


def test_registry():
    r = Registry.standard()
    assert r.by_name("then").long == "then followed by" and r.by_name("follows on from").short == "from"
    assert r.inverse[r.by_name("then").ptr] == r.by_name("from").ptr
    assert r.insert("leadsto", "then", "another") == r.by_name("then").ptr
    assert stindex_by_name("LeadsTo", "-") == 3 and stindex_by_name("nr", "-") == 4 and stindex_label(2) == "-CONTAINS" and channel(-3) == "Im3"
    with pytest.raises(ValueError):
        stindex_by_name("nothing")
    assert compile_context([" b", "a", "b", ""]) == "a,b"
    assert r.context(["b", "a"]) == r.context(["a", "b "]) and r.context([]) == 0
    assert r.resolve(["then", "2", "-1", "!from!", "nope"]) == ([r.by_name("then").ptr, r.by_name("from").ptr], [1, 2, -1, -1])
    n = len(r.arrows)
    with r.scratch():
        r.insert("leadsto", "temporary", "only here")
        assert len(r.arrows) == n + 1
    assert len(r.arrows) == n and r.by_name("temporary") is None


def test_vocabulary_text():
    said = ["apple", "fruit (contain) apple", "apple (note) a common fruit", "apple (ll) äppel", "banana", "fruit (contain) banana", "banana (note) a tropical fruit", "apple (fwd) banana"]
    text = "\n ".join(["-vocabulary\n\n:: language, learning ::\n", *said]) + "\n"
    r = config()
    n = N.parse(text, r)
    assert not n.errors and len(n.nodes) == 6 and N.edges_created(n, r) == 7 and n.chapters == ["vocabulary"]
    assert {k[4] for k in n.links} == {("language", "learning")}


@pytest.mark.parametrize(
    ("text", "errors"),
    [
        ("apple\n", 1),
        ("-s\n\n a (nothing) b\n", 1),
        ("-s\n a (then)\n", 1),
        ("-s\n a (then) a\n", 1),
        ("-s\n a (then, -1) b\n", 1),
        ("-s\n a (then, 1, 2) b\n", 1),
        ("-s\n a ) b\n", 1),
        ("-a, b\n", 1),
        ('-s\n "never ends\n', 1),
        ("-s\n a (then, 0.5, why) b\n", 0),
        ("-s\n a\n \" (then) b\n", 0),
        ("-s\n@x a (then) b\n $x.1 (then) c\n", 0),
        ("-s\n@x a\n $x.7 (then) c\n", 1),
    ],
)
def test_diagnostics(text, errors):
    assert len(N.parse(text).errors) == errors, N.parse(text).errors


def test_sequences_contexts_and_marks():
    r = config()
    n = N.parse("-story\n :: _sequence_, day ::\n one\n two (note) x\n three\n -:: _sequence_ ::\n four\n", r)
    then = r.by_name("then").ptr
    assert [(k[0], k[2]) for k in n.links if k[1] == then] == [("one", "two"), ("two", "three")]
    assert n.nodes["one"][1] and not n.nodes["two"][1]
    m = N.parse("-c\n a %word here\n", r)
    assert set(m.nodes) == {"a word here", "word"} and len(m.links) == 1
    assert N.parse("-c\n TODO FIX THIS\n", r).warnings
    c = N.parse("-c\n Apple\n apple\n", r)
    assert len(c.links) == 2
    two = N.parse("-one\n a\n-two\n b\n", r)
    assert two.chapters == ["one"] and "-two" in two.nodes


def test_compile_and_files(spark):
    g, n = N.compile_notes(spark, "-s\n a (fwd) b (note) c\n", config(), ("file.txt", "me"))
    assert not n.errors and g.nodes.count() == 5
    assert {r.src_text: (r.source, r.author) for r in N.provenance_of(g).collect()} == {x: ("file.txt", "me") for x in "abc"}
    files = spark.createDataFrame([("1", "-s\n a (fwd) b\n"), ("2", "-t\n b (fwd) c\n x\n"), ("3", "no section\n")], "path string, content string")
    rows = N.parse_files(files, config())
    assert {r.path: r["count"] for r in rows.where("kind = 'error'").groupBy("path").count().collect()} == {"3": 1}
    assert sorted(r.text for r in N.files_graph(files, config()).nodes.collect()) == ["a", "b", "c", "x"]
    v = N.validate("-s\n a\n")
    assert v["valid"] and v["nodes"] == 1 and "valid: True" in N.summary("-s\n a\n")
    assert N.read_closures("# c\n then + then => then\nbad\n") == [("then", "then", "then")]


def test_short_commands():
    p = L.decode_field('\\chapter "bio" \\context cell, dna \\limit 20 \\depth 3 forward enzyme any')
    assert (p.chapter, p.context, p.limit, p.depth, p.orientation, p.names) == ("bio", ["cell", "dna"], 20, 3, "forward", ["enzyme", "%%"])
    p = L.decode_field("\\from (1,2) \\to (1,3)", Registry.standard())
    assert p.from_node == (1, 2) and p.to_node == (1, 3) and L.route(p) == "paths"
    assert L.decode_field("\\arrow then", Registry.standard()).arrows == [Registry.standard().by_name("then").ptr]
    assert L.route(L.decode_field("")) == "stats" and L.route(L.decode_field("\\notes x")) == "chapters" and L.route(L.decode_field("\\story x")) == "stories"
    assert L.decode_field("x y \\page 4").limit == 4


def test_long_commands():
    p = L.decode_command('\\from "start here" \\to end \\min 2 \\max 9 \\finds gold \\new')
    assert p.from_names == ["start here"] and p.to_names == ["end"] and p.min_limits == [2] and p.max_limits == [9] and p.finds == ["gold"] and p.horizon == 4
    assert L.limits(p) == (2, 9)
    d = L.decode_command("<b|cause|a>")
    assert d.from_names == ["a"] and d.to_names == ["b"] and d.context == ["cause"]
    assert L.decode_command("any thing").names == ["thing"]
    assert L.decode_command("\\chapter").names == ["\\chapter"]
    assert L.split_quotes('a "b c" (d e) f') == ["a", '"b c"', "(d e)", "f"]


def test_search_words():
    assert L.literal_pointers(["(1,2) x", "plain", "(a,b)"]) == ([(1, 2)], ["x", "plain", "(a,b)"])
    assert L.exact("!Word!") == (True, "word") and L.any_exact(["a", "|b|"]) and not L.any_exact(["a"])
    assert L.limits(L.Search(names=["abc"])) == (1, 5) and L.limits(L.Search(names=["abcdef"])) == (1, 10) and L.limits(L.Search(seq_only=True)) == (1, 30)
    assert L.is_fragment("two words") and not L.is_fragment("a & b") and not L.is_fragment("word")
    assert L.bracketed_list(["(x)", "y"]) == (True, ["|x|", "y"]) and L.concept_query("\\dna x") == "any \\arrow contains \\limit 20 x"
    assert L.pointer_query("", "3", "41") == "(3,41)" and "reminders" in L.remind_query("", "w", "k") and "help" in L.help_query("\\help")
    p = search.parse_unified("apple NOT pie in:food st:CONTAINS w>0.5")
    assert (p.text, p.excluded, p.chapters, p.sttype, p.min_weight) == ("apple", ["pie"], ["food"], 2, 0.5)
    assert search.parse_inhibition("art,music NOT sport") == (["art", "music"], ["sport"])
    assert search.parse_inhibition("NOT junk,spam") == ([], ["junk", "spam"]) and search.parse_inhibition("A,B not C") == (["A", "B"], ["C"])


def test_times():
    now = datetime(2024, 3, 13, 14, 37)
    assert T.describe(now) == ("N_Spring, S_Autumn, Afternoon, Wednesday, Day13, March, Yr2024, Hr14, Qu3", "Wed:Hr14:Qu3-Min35_40")
    assert T.resolve(["x", "Wednesday"], now) == datetime(2024, 3, 13) and T.resolve(["x", "Tuesday"], now) == datetime(2024, 3, 19)
    assert T.resolve(["x", "Day3", "Hr9", "Min05_10", "January", "Yr2030"], now) == datetime(2030, 1, 3, 9, 5)
    assert T.expand("Dynamic:in {TimeUntil Day14 Hr14 Min37}", now) == "in 1 Days" and T.expand("no {Other x}", now) == "no " and T.duration(0) == "0 Minutes"
    assert T.season("July") == ("N_Summer", "S_Winter") and T.season("x") == ("hurricane", "typhoon")


def test_codecs(tmp_path):
    link = (3, 0.5, 2, (1, 7))
    assert K.parse_link(K.link_text(link)) == link and K.parse_links(K.link_array([link, link])) == [link, link] and K.parse_links("{}") == []
    assert K.parse_array('{a,"b,c"}') == ["a", "b,c"] and K.string_array(["b", "a"]) == '{"a","b"}' and K.parse_pointers(K.pointer_array([(1, 2)])) == [(1, 2)]
    assert K.parse_path("1,1.0,0,1,2;3,1.0,0,1,4\n") == [[(1, 1.0, 0, (1, 2)), (3, 1.0, 0, (1, 4))]]
    a = K.parse_appointment('(5,1,"chap","{x,y}","(1,2)","{(1,3),(1,4)}")')
    assert a["arr"] == 5 and a["contexts"] == ["x", "y"] and a["to"] == (1, 2) and a["from"] == [(1, 3), (1, 4)]
    path = K.attach_asset(b"data", "a name", "ch", root=str(tmp_path), filename="Pic 1.PNG")
    assert path.endswith("Pic_1.png") and K.assets("a name", "ch", root=str(tmp_path)) == [path] and K.content_type(path) == "image/png"
    assert K.attach_asset("file://" + path, "other", "ch", root=str(tmp_path)).endswith(".png")
    with pytest.raises(ValueError):
        K.attach_asset(b"x" * (K.MAX_ASSET + 1), "n", "c", root=str(tmp_path))
    with pytest.raises(ValueError):
        K.attach_asset("http://example.org/x", "n", "c", root=str(tmp_path))


def test_config_folder(tmp_path, monkeypatch):
    from processgraph.registry import config_files, config_folder

    (tmp_path / "annotations").write_text("- annotations\n % (goes)\n")
    (tmp_path / "arrows-1").write_text("- leadsto\n + goes to (goes) - comes from (comes)\n")
    (tmp_path / "zz").write_text("- nothing\n")
    monkeypatch.setenv("PROCESSGRAPH_CONFIG", str(tmp_path))
    assert config_folder() == str(tmp_path) and [f.rpartition("/")[2] for f in config_files(str(tmp_path))] == ["arrows-1", "annotations", "zz"]
    r = Registry.standard()
    assert r.load(str(tmp_path)) == ["line 1: no such section: nothing"]
    assert r.by_name("goes to").short == "goes" and r.annotations == {"%": "goes"}
