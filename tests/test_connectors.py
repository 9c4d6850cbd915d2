"""Sources by name against a server and files of this test."""

import json
import threading
import zipfile
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessera.sources import connectors

#: An order in the shape of a backend that knows nothing of ours.
ODD = {"orderState": "signed", "logistics": {"company": "JD", "stops": [{"city": "B"}, {"city": "S"}]}, "n": 3}


@pytest.fixture(scope="module")
def server():
    calls = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            key = self.path.partition("?")[0].rpartition("/")[2]
            calls[key] += 1
            status = {"gone": 404, "bad": 400, "down": 503}.get(key, 200)
            if key == "flaky" and calls[key] < 3:
                status = 500
            if key == "secret" and self.headers.get("X-Key") != "k" and "token=k" not in self.path:
                status = 401
            body = b"no json" if key == "text" else json.dumps({**ODD, "key": key}).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body if status == 200 else b"")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", calls
    server.shutdown()


FIELDS = (("state", "orderState"), ("carrier", "logistics.company"), ("second", "logistics.stops[1].city"), ("none", "logistics.stops[5].city"), ("n", "n"))


def test_records_by_name(spark, server):
    base, _ = server
    connectors.register(spark)
    read = spark.read.format("record_lookup").option("url", base + "/orders/{id}").option("fields", json.dumps(dict(FIELDS))).option("wait", "0.01")
    rows = {r.id: r for r in read.option("ids", json.dumps(["A1", "a/b c", "gone", "bad", "down", "flaky", "text"])).option("numPartitions", "3").load().collect()}
    assert (rows["A1"].state, rows["A1"].carrier, rows["A1"].second, rows["A1"].none, rows["A1"].n) == ("signed", "JD", "S", None, "3")
    assert json.loads(rows["a/b c"].body)["key"] == "a%2Fb%20c"
    got = {k: (r.outcome, r.status, r.attempts) for k, r in rows.items()}
    assert got == {
        "A1": ("found", 200, 1), "a/b c": ("found", 200, 1), "gone": ("not_found", 404, 1), "bad": ("refused", 400, 1),
        "down": ("unavailable", 503, 3), "flaky": ("found", 200, 3), "text": ("unavailable", None, 3),
    }
    assert rows["down"].error.startswith("HTTP 503") and rows["bad"].state is None
    assert read.option("ids", "[]").load().count() == 0


def test_each_key_of_a_table_is_called_once(spark, server):
    base, calls = server
    rows = [(i, f"k{i % 4}") for i in range(40)] + [(50, None), (51, ""), (52, "gone")]
    point = connectors.Endpoint(base + "/x/{id}", FIELDS, wait=0.01)
    before = Counter(calls)
    got = connectors.look_up(spark.createDataFrame(rows, "r int, order_id string"), "order_id", point, 3).collect()
    assert len(got) == 43 and {r.outcome for r in got if r.r < 40} == {"found"} and {r.state for r in got if r.r < 40} == {"signed"}
    assert {r.r: r.outcome for r in got if r.r >= 50} == {50: "not_asked", 51: "not_asked", 52: "not_found"}
    assert sum((calls - before).values()) == 5


@pytest.mark.parametrize(("auth", "name"), [("header", "X-Key"), ("query", "token")])
def test_secrets_go_where_the_backend_wants_them(server, auth, name):
    base, _ = server
    assert connectors.Endpoint(base + "/{id}", auth=auth, auth_name=name, secret="k").call("secret")["outcome"] == "found"
    assert connectors.Endpoint(base + "/{id}").call("secret")["outcome"] == "refused"
    assert connectors.Endpoint("http://127.0.0.1:1/{id}", retries=0).call("x")["outcome"] == "unavailable"


def test_folders_by_name(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.MD").write_text("# 一")
    (tmp_path / "a" / "b" / "two.v1.txt").write_bytes(b"x \xff y")
    (tmp_path / "a" / "skip.bin").write_text("no")
    (tmp_path / "a" / "bad.docx").write_text("no zip")
    with zipfile.ZipFile(tmp_path / "a" / "w.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>word</w:t></w:r></w:p></w:body></w:document>')
    connectors.register(spark)
    for part in ("1", "100000"):
        df = spark.read.format("document_folder").option("prefix", "p_").option("partBytes", part).load(f"{tmp_path}/a")
        rows = {r.doc_id: (r.path, r.text) for r in df.collect()}
        assert rows == {"p_one": ("one.MD", "# 一"), "p_b_two.v1": ("b/two.v1.txt", "x � y"), "p_bad": ("bad.docx", None), "p_w": ("w.docx", "word")}
        assert df.where("error IS NOT NULL").count() == 1
    (tmp_path / "none").mkdir()
    assert spark.read.format("document_folder").load(f"file://{tmp_path}/none").count() == 0
