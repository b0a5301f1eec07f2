import http.client
import json

import numpy as np
import pytest

from halyard import cli, server
from halyard.catalog import VectorCatalog
from halyard.errors import InvalidInput
from halyard.operators.collection import VectorCollection
from halyard.config import CollectionConfig
from halyard.sources import matrices
from halyard.sources.bodies import pack, unpack
from halyard.streaming.ingest import Ingest


def test_commands(spark, tmp_path, capsys):
    def run(*args):
        code = cli.main([str(a) for a in args], spark)
        return code, json.loads(capsys.readouterr().out or "null")

    base, queries, catalog = tmp_path / "base.npy", tmp_path / "q.fvecs", f"file://{tmp_path}/catalog"
    assert run("gen-data", "--out", base, "--dim", 8, "--count", 120, "--clusters", 5) == (0, {"rows": 120})
    assert run("gen-data", "--out", queries, "--dim", 8, "--count", 6, "--clusters", 5, "--seed", 2)[0] == 0
    assert run("ground-truth", "--base", base, "--queries", queries, "--out", tmp_path / "gt", "--k", 10)[1] == {"queries": 6, "k": 10}
    assert np.load(tmp_path / "gt.ids.npy").shape == (6, 10)
    assert run("build", "--base", base, "--catalog", catalog, "--name", "a", "--index", "hnsw", "--shards", 2)[1]["rows"] == 120
    code, out = run("search", "--catalog", catalog, "--name", "a", "--queries", queries, "--k", 10, "--ef-search", 120, "--gt", tmp_path / "gt")
    assert code == 0 and out["mean_recall"] == 1.0
    assert out["p50_ms"] <= out["p99_ms"]
    assert run("search", "--catalog", catalog, "--name", "a", "--queries", queries, "--k", 4, "--ef-search", 120, "--out", tmp_path / "found", "--single", 0)[0] == 0
    assert (np.load(tmp_path / "found.ids.npy") == np.load(tmp_path / "gt.ids.npy")[:, :4]).all()
    matrices.save_matrix(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.load(tmp_path / "gt.ids.npy"))], "row long, vector array<int>"), str(tmp_path / "truth.ivecs"))
    assert run("search", "--catalog", catalog, "--name", "a", "--queries", queries, "--k", 10, "--ef-search", 120, "--gt", tmp_path / "truth.ivecs", "--single", 2)[1]["id_overlap"] == 1.0
    for level in ("none", "metadata", "full"):
        assert run("verify", "--catalog", catalog, "--name", "a", "--level", level)[1]["ok"]
    assert cli.main(["verify", "--catalog", catalog, "--name", "a", "--level", "x"], spark) == 1
    assert run("build", "--base", base, "--catalog", catalog, "--name", "one", "--index", "hnsw", "--shards", 1)[0] == 0
    assert run("export", "--catalog", catalog, "--name", "one", "--out", tmp_path / "one.index")[1]["bytes"] > 120 * 32
    assert run("load", "--catalog", catalog, "--name", "two", "--file", tmp_path / "one.index")[1] == {"rows": 120, "live": 120, "generation": 1}
    assert run("search", "--catalog", catalog, "--name", "two", "--queries", queries, "--k", 10, "--ef-search", 120, "--gt", tmp_path / "gt", "--single", 0)[1]["mean_recall"] == 1.0
    assert run("info", "--catalog", catalog)[1]["a"]["rows"] == 120
    assert cli.main(["verify", "--catalog", catalog, "--name", "none"], spark) == 1


@pytest.fixture(scope="module")
def call(spark, tmp_path_factory):
    catalog = VectorCatalog(spark, f"file://{tmp_path_factory.mktemp('http')}")
    http_server, service = server.serve(catalog, token="secret")

    def call(method, path, body=None, kind="application/json", token="secret"):
        c = http.client.HTTPConnection("127.0.0.1", http_server.server_port, timeout=120)
        raw = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
        c.request(method, path, raw, {"Content-Type": kind, "Authorization": f"Bearer {token}", "X-Request-Id": "abc"})
        r = c.getresponse()
        text = r.read().decode()
        assert r.headers["X-Request-Id"] == "abc"
        c.close()
        return r.status, json.loads(text) if r.headers["Content-Type"] == "application/json" else text

    yield call
    http_server.shutdown()


def code(answer):
    return answer[0], answer[1]["error"]["code"]


def test_routes(call):
    assert call("GET", "/healthz", token="x") == (200, {"status": "ok"}) and call("GET", "/readyz")[0] == 200
    assert code(call("GET", "/v1/status", token="x")) == (401, "UNAUTHORIZED")
    assert call("POST", "/v1/collections", {"name": "a", "dim": 2, "metric": "l2", "index": {"type": "flat"}})[0] == 201
    assert code(call("POST", "/v1/collections", {"name": "a", "dim": 2})) == (409, "ALREADY_EXISTS")
    at = "/v1/collections/a"
    assert call("POST", at + "/vectors", {"vectors": [{"id": 1, "vector": [0, 0]}, {"id": 2, "vector": [1, 0]}]}) == (200, {"inserted": 2})
    assert code(call("POST", at + "/vectors", {"vectors": [{"id": 1, "vector": [0, 0]}]})) == (409, "ALREADY_EXISTS")
    assert call("POST", at + "/vectors:bulk?upsert=true", pack(np.array([2, 3]), np.array([[2, 0], [3, 0]])), "application/octet-stream") == (200, {"inserted": 2})
    status, got = call("POST", at + "/search", {"vector": [0, 0], "k": 2})
    assert status == 200 and got["results"] == [{"id": 1, "distance": 0.0}, {"id": 2, "distance": 4.0}]
    assert [len(x) for x in call("POST", at + "/search:batch", {"vectors": [[0, 0], [9, 9]], "k": 5})[1]["results"]] == [3, 3]
    assert call("GET", at + "/vectors/3") == (200, {"id": 3, "vector": [3.0, 0.0]})
    assert call("DELETE", at + "/vectors/3") == (200, {"deleted": 3})
    assert code(call("GET", at + "/vectors/3")) == (404, "NOT_FOUND")
    assert call("GET", at + "/stats")[1]["live"] == 2
    assert call("POST", at + "/compact")[1]["rows_after"] == 2
    assert call("POST", at + "/snapshot")[1]["generation"] == 1
    assert call("GET", at)[1]["count"] == 2 and len(call("GET", "/v1/collections")[1]["collections"]) == 1
    told = call("GET", "/metrics")[1]
    assert 'route="get",status="4xx"' in told and 'le="0.00005"' in told.replace("5e-05", "0.00005") and "http_request_seconds_sum" in told and told.count("_bucket") == 18
    assert code(call("POST", at + "/vectors", {"upsert": "yes", "vectors": []})) == (400, "INVALID_ARGUMENT")
    assert code(call("POST", at + "/vectors", {"vectors": [{"id": 1 << 63, "vector": [0, 0]}]})) == (400, "INVALID_ARGUMENT")
    assert code(call("POST", at + "/vectors", {"vectors": [{"id": 77, "vector": [0, 0]}] * 2})) == (400, "INVALID_ARGUMENT")
    assert call("GET", at + "/stats")[1] | {"vector_bytes": 0} == {"live": 2, "deleted": 0, "rows": 2, "dim": 2, "metric": "l2", "index": "flat", "normalize": False, "vector_bytes": 0, "deleted_ratio": 0.0}
    assert call("DELETE", at) == (200, {"dropped": "a"})
    assert code(call("GET", at)) == (404, "NOT_FOUND")


def test_refusals(call):
    call("POST", "/v1/collections", {"name": "b", "dim": 2, "index": {"type": "flat"}})
    at = "/v1/collections/b/search"
    assert code(call("POST", at, {"vector": [1]})) == (400, "DIMENSION_MISMATCH")
    assert code(call("POST", at, {"vector": [1, 2], "k": 1001})) == (422, "LIMIT_EXCEEDED")
    assert code(call("POST", at, {"vector": [1, 2], "x": 1})) == (400, "INVALID_ARGUMENT")
    assert code(call("POST", at, b"{")) == (400, "MALFORMED_JSON")
    assert code(call("POST", at, b'{"vector":' + b"[" * 20 + b"]" * 20 + b"}")) == (400, "MALFORMED_JSON")
    assert code(call("POST", at, {"vector": [1, 2]}, "text/plain")) == (415, "UNSUPPORTED_MEDIA_TYPE")
    assert code(call("PUT", at, {})) == (404, "NOT_FOUND")
    assert code(call("POST", "/v1/collections", {"name": "b/", "dim": 2})) == (400, "INVALID_ARGUMENT")


def test_log_lines_and_stopping():
    line = server.logfmt("info", "request", route="get", text='a "b"', empty="")
    assert line.startswith("time=") and line.endswith('level=info event=request route=get text="a \\"b\\"" empty=""')
    service = server.Service.__new__(server.Service)
    service.guard, service.running, service.ready = server.threading.Condition(), 1, True
    assert not service.stop(0.05) and not service.ready
    service.running = 0
    assert service.stop(0.05)


def test_packed_ids_beyond_signed_ones_are_refused():
    assert unpack(pack(np.array([5]), np.ones((1, 2))))[0].tolist() == [5]
    for id_ in ((1 << 64) - 1, 1 << 63):
        with pytest.raises(InvalidInput):
            unpack(pack(np.array([id_], np.uint64), np.ones((1, 2))))


def test_a_batch_counts_once_after_a_restart(spark, tmp_path):
    """The number of the last batch is saved with the rows, so a replay by a new driver changes nothing."""
    catalog = VectorCatalog(spark, f"file://{tmp_path}/c")
    catalog.create("a", CollectionConfig(1))
    batch = lambda *ids: spark.createDataFrame([(i, [float(i)]) for i in ids], "id long, vector array<float>")
    Ingest("a", upsert=False, stream="s", catalog=catalog)(batch(1, 2), 0)
    again = VectorCatalog(spark, f"file://{tmp_path}/c")
    ingest = Ingest("a", upsert=False, stream="s", catalog=again)
    assert ingest.done == 0
    ingest(batch(1, 2), 0)
    ingest(batch(3), 1)
    assert again.get("a").size() == 3 and VectorCatalog(spark, f"file://{tmp_path}/c").get("a").applied == {"s": 1}


def test_capacity(spark, monkeypatch):
    from halyard.errors import CapacityExceeded
    from halyard.operators import validation

    monkeypatch.setattr(validation, "MAX_ROWS", 2)
    c = VectorCollection(spark, CollectionConfig(1))
    c.add_batch(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id long, vector array<float>"))
    with pytest.raises(CapacityExceeded):
        c.add(3, [1.0])
    assert c.size() == 2
