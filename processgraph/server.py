"""A small HTTP shell over the engine: each route is one DataFrame as JSON rows."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from processgraph import engine
from processgraph.graph import Graph
from processgraph.operators import paths

MOST = 1000


def rows(df: DataFrame) -> list[dict]:
    """At most MOST rows; a page of results is meant to be read."""
    return [json.loads(x) for x in df.limit(MOST).toJSON().collect()]


def respond(g: Graph, path: str, q: dict[str, str]) -> tuple[int, object]:
    """(status, body) of a request."""
    parts = [p for p in path.split("/") if p]

    def node() -> int:
        row = g.node(int(parts[-2]), int(parts[-1])).select("nid").first()
        if row is None:
            raise LookupError("no such node")
        return row["nid"]

    if path == "/health":
        return 200, {"status": "ok"}
    if path in ("/api/search", "/search"):
        return 200, rows(engine.query(g, q.get("name") or q.get("q") or ""))
    if path in ("/api/stats", "/graph"):
        return 200, rows(g.stats())
    if path == "/api/chapters":
        return 200, rows(g.chapters())
    if path == "/api/chapters/detailed":
        return 200, rows(g.nodes.groupBy("chapter").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chapter"))
    if path == "/api/chapter/nodes":
        return 200, rows(g.chapter_nodes(q.get("chapter", "")))
    if path == "/api/contexts":
        return 200, rows(g.contexts())
    if path == "/api/pagemap":
        from processgraph.operators.context import page

        return 200, rows(page(g.pagemap, q.get("chapter", ""), number=int(q.get("page", 0))))
    if path == "/api/paths":
        (a, b), (c, d) = (map(int, q[k].strip("()").split(",")) for k in ("from", "to"))
        ends = [g.node(*p).select("nid").first()["nid"] for p in ((a, b), (c, d))]
        return 200, rows(paths.find_paths(g.links, *ends, int(q.get("depth", 10))))
    if len(parts) >= 3 and parts[-3] == "node":
        return 200, rows(engine.node_json(g).where(F.col("nid") == node()))
    if len(parts) >= 3 and parts[-3] == "links":
        return 200, rows(g.named_links().where(F.col("src") == node()).orderBy("stindex", "ord"))
    if len(parts) >= 3 and parts[-3] == "orbit":
        return 200, rows(engine.event_json(g, node()))
    if len(parts) >= 3 and parts[-3] == "cone":
        found = paths.cone(g.links, q.get("dir", "fwd"), node(), int(q.get("depth", 5)), int(q.get("limit", 100)))
        return 200, rows(engine.web_paths(g, found))
    return 404, {"error": f"no such route: {path}"}


def serve(g: Graph, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Starts the server in a thread; stop() ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlparse(self.path)
            self.answer(url.path, {k: v[0] for k, v in parse_qs(url.query).items()})

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            self.answer(urlparse(self.path).path, {k: v[0] for k, v in parse_qs(body).items()})

        def answer(self, path: str, q: dict[str, str]) -> None:
            try:
                status, body = respond(g, path, q)
            except (LookupError, ValueError) as e:
                status, body = 400, {"error": str(e)}
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def stop(server: ThreadingHTTPServer) -> None:
    server.shutdown()
    server.server_close()
