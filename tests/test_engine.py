import json
from urllib.request import urlopen

import pytest
from processgraph import engine, server
from processgraph.graph import GraphBuilder
from processgraph.sources import notes, tables
from pyspark.sql import functions as F
from test_graph import graph, ids, registry


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark, [("a", "then", "b"), ("b", "then", "c"), ("a", "note", "remark")])


def test_extend_keeps_pointers(spark, g):
    with GraphBuilder(spark, g.registry) as b:
        b.vertex("new", "other")
        b.edge("c", "then", "new", ["x"], 2.0)
    v = spark.createDataFrame([("new", "other", False, 0), ("a", "ignored", False, 1)], "text string, chapter string, seq boolean, ord bigint")
    e = spark.createDataFrame([("c", "then", "new", ["x"], 2.0, 0), ("a", "then", "b", [], 1.0, 1)], "src string, arrow string, dst string, context array<string>, wgt float, ord bigint")
    more = g.extend(v, e)
    before, after = ids(g), ids(more)
    assert all(after[k] == n for k, n in before.items()) and len(after) == len(before) + 1
    assert more.nodes.where("text = 'a'").first().chapter == "test" and more.nodes.where("text = 'new'").first().cptr == 5
    assert more.links.count() == g.links.count() + 2


def test_json_and_stories(spark, g):
    i = ids(g)
    event = json.loads(engine.event_json(g, i["a"]).first().json)
    assert {o["text"] for o in event["orbits"]} == {"b", "c", "remark"}
    nested = json.loads(engine.node_json(g).where(F.col("nid") == i["b"]).first().json)
    assert set(nested["incidence"]) == {"3", "5"}
    s = engine.stories(g, [i["a"]], g.registry.by_name("then").ptr).orderBy("step").collect()
    assert [r.text for r in s] == ["b", "c"]


def test_provenance(spark, g):
    rows = spark.createDataFrame([("a", "file", 3, None, "me")], "text string, source string, line int, time string, author string")
    got = notes.provenance_of(engine.set_provenance(g, rows)).first()
    assert (got.src_text, got.source, got.line, got.author) == ("a", "file", "3", "me")


def test_server(spark, g):
    s = server.serve(g, 0)
    try:
        base = f"http://127.0.0.1:{s.server_port}"
        assert json.load(urlopen(f"{base}/health")) == {"status": "ok"}
        assert json.load(urlopen(f"{base}/api/stats"))[0]["nodes"] == 4
    finally:
        server.stop(s)
    a = g.by_name("a").first()
    at = f"{a['class']}/{a.cptr}"
    assert server.respond(g, f"/node/{at}", {})[0] == 200
    assert {r["text"] for r in server.respond(g, f"/api/cone/{at}", {})[1]} == {"b", "c", "remark"}
    assert len(server.respond(g, f"/links/{at}", {})[1]) == 2
    assert server.respond(g, "/search", {"name": "b"})[0] == 200
    assert server.respond(g, "/nothing", {})[0] == 404
    with pytest.raises(LookupError):
        server.respond(g, "/node/1/999", {})


def test_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    assert tables.text_documents(spark, str(tmp_path / "a.txt")).first().text == "one\n\ntwo"
    (tmp_path / "n.notes").write_text("-s\n a (then) b\n")
    assert notes.files_graph(tables.note_files(spark, str(tmp_path / "n.notes")), registry()).nodes.count() == 2
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert tables.parquet_tables(spark, str(tmp_path))["t"].count() == 3
