"""Web calls, placement on a ring, zone splits, and displayed values."""

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from evergrove.functions import model
from evergrove.functions.display import display
from evergrove.functions.model import Unknown
from evergrove.operators import placement as P
from evergrove.plans.interpreter import Engine


class Handler(BaseHTTPRequestHandler):
    def _answer(self):
        size = int(self.headers.get("Content-Length") or 0)
        body = f"{self.command} {self.path} {self.headers.get('X-Own')} {self.rfile.read(size).decode()}".encode()
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/there")
        else:
            self.send_response(404 if self.path == "/missing" else 200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    do_GET = do_POST = do_PUT = do_PATCH = do_DELETE = _answer

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def address():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_outbound_calls(spark, address):
    engine = Engine(spark)
    call = lambda text: engine.execute(f"my.computer.network.web.{text}")
    found = call(f'get("{address}/a")')
    assert found["status"] == 200.0 and found["body"] == "GET /a None " and found["duration"] >= 0 and isinstance(found["time"], model.Time)
    assert call(f'get("{address}/h", {{headers: {{"X-Own": "own"}}}}).body') == "GET /h own "
    assert call(f'post("{address}/b", {{k: 1}}).body') == 'POST /b None {"k":1}' and call(f'put("{address}/b", "x").body') == "PUT /b None x"
    assert call(f'patch("{address}/b", "").body') == "PATCH /b None " and call(f'delete("{address}/b").body') == "DELETE /b None "
    assert call(f'get("{address}/missing").status') == 404.0
    assert call(f'get("{address}/moved").body').startswith("GET /there") and call(f'get("{address}/moved", {{follow_redirects: false}}).status') == 302.0


def test_failed_calls(spark, address):
    engine = Engine(spark)
    call = lambda text: engine.execute(f"my.computer.network.web.{text}")
    assert call('get("http://127.0.0.1:1/")') == Unknown("connection_refused")
    assert call('get("file:///etc/passwd")').reason.startswith("invalid_url") and call("get()").reason.startswith("get() expects")
    assert call('get("http://x", {headers: {a: 1}})') == Unknown("header values must be text")
    assert call('nope("x")') == Unknown("unknown function: my.computer.network.web.nope")


def test_answers_are_staged(spark):
    engine = Engine(spark)
    assert engine.execute('my.computer.network.web.ok({id: "7"}, "hi")') == "response_sent"
    assert engine.execute("my.computer.network.web.requests.7.response.status_code") == 200.0
    assert engine.execute('my.computer.network.web.ok({x: 1}, "hi")') == Unknown("request record missing 'id' field")
    assert engine.execute('my.computer.network.web.ok("r", "hi")') == Unknown("request argument must be a Record")
    assert engine.execute('my.computer.network.web.ok({id: "7"}, 5)') == Unknown("response body must be Text")
    closed = Engine(spark, may=lambda permission, path: permission == "read")
    assert "permission denied" in closed.execute('my.computer.network.web.not_found({id: "8"})').reason


def test_the_ring_is_the_brute_force(spark):
    import hashlib

    nodes = ["a", "b", "c", "d"]
    standing = sorted((int(hashlib.md5(f"{n}#{k}".encode()).hexdigest()[:8], 16), n) for n in nodes for k in range(64))
    rows = [(f"world.z{k}.x.y",) for k in range(300)] + [("world",), (None,)]
    found = P.placed(spark.createDataFrame(rows, "path string"), nodes).collect()
    for r in found:
        if r["path"] is None:
            assert r["zone"] is None and r["authority"] is None
            continue
        zone = ".".join(r["path"].split(".")[:2])
        place = int(hashlib.md5(zone.encode()).hexdigest()[:8], 16)
        after = [n for p, n in standing if p >= place] + [n for _, n in standing]
        assert (r["zone"], [r["authority"], *r["replicas"]]) == (zone, list(dict.fromkeys(after))[:3])
    spread = Counter(r["authority"] for r in found if r["path"])
    assert min(spread[n] for n in nodes) > 20
    moved = {r["path"]: r["authority"] for r in P.placed(spark.createDataFrame(rows, "path string"), nodes[:3]).collect()}
    assert all(moved[r["path"]] == r["authority"] for r in found if r["path"] and r["authority"] != "d")


def test_split_advice(spark):
    rows = [(10, 0.0, 0.0, 5, 0.0), (10, 2000.0, 0.0, 5, 0.0), (10, 0.0, 600.0, 5, 0.0), (10, 0.0, 0.0, 1001, 0.0), (2 << 30, 0.0, 0.0, 5, 30.0), (2 << 30, 0.0, 0.0, 5, 3.0)]
    found = P.split_advice(spark.createDataFrame(rows, "bytes long, queries double, writes double, children int, age_hours double")).collect()
    assert [r["split"] for r in found] == [None, "spatial", "spatial", "spatial", "temporal", "spatial"]


def test_display():
    assert display(None) == "" and display(True) == "true" and display(2.0) == "2" and display(Unknown("x")) == "unknown(x)" and display([]) == "[]" and display({}) == "{}"
    assert display({"a": 1.0, "b": {"c": "x", "d": None}}) == "a: 1\nb:\n  c: x\n  d:"
    assert display([{"k": 1.0, "v": "xy"}, {"k": 10.0, "v": "z"}]) == "k   v\n--  --\n1   xy\n10  z"
    assert display([1.0, [2.0, 3.0]]) == "- 1\n- [2, 3]" and display(model.Money(2.5, "USD")) == "2.50 USD" and display(model.parse_time("2024-03")) == "2024-03"


def test_status_and_compaction(spark, tmp_path):
    engine = Engine(spark)
    engine.execute("my.a = 1\nmy.b = 2")
    engine.execute("my.a = 3")
    assert {k: v for k, v in engine.status().items() if k in ("instances", "paths", "visible")} == {"instances": 3.0, "paths": 2.0, "visible": 3.0}
    assert engine.compact(str(tmp_path / "log")) == {"before": 3.0, "after": 3.0, "dropped": 0.0} and spark.read.parquet(str(tmp_path / "log")).count() == 3
