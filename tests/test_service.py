"""Incremental writes, migration end to end, providers, settings and start-up."""

import asyncio
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import providers as pv
from nearfield.operators import requests as rq
from nearfield.operators.backfill import migrate
from nearfield.operators.service import VectorIndex
from nearfield.schema import OPS
from nearfield.settings import Settings
from nearfield.sources.store import SnapshotStore
from nearfield.streaming.ingest import ingest

ROWS = "namespace string, item_id string, vector array<float>"


def test_a_write_replaces_the_cells_of_its_keys_alone(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    assert index.upsert_vectors(spark.createDataFrame([(f"n{i % 9}", f"i{i}", [float(i)]) for i in range(300)], ROWS)) == 300
    before = index.store.manifest()
    assert index.upsert_vectors(spark.createDataFrame([("n1", "i1", [-1.0]), ("n1", "new", [7.0]), ("n1", "new", [8.0])], ROWS).coalesce(1)) == 3
    after = index.store.manifest()
    changed = {c for c in before["cells"] | after["cells"] if before["cells"].get(c) != after["cells"].get(c)}
    assert 1 <= len(changed) <= 2 and after["top"] > before["top"]
    rows = {r.item_id: r for r in index.load().collect()}
    # the last vector of a repeated key, at the position of its first row; an old key keeps its position
    assert len(rows) == 301 and list(rows["i1"].vector) == [-1.0] and list(rows["new"].vector) == [8.0]
    assert rows["new"].seq > max(r.seq for k, r in rows.items() if k != "new") and rows["i1"].seq < rows["i299"].seq
    assert index.remove("n1", ["i1", "absent"]) == 1 and index.load().count() == 300
    assert index.purge("n2") == 34 and index.count("n2") == 0 and index.load().count() == 266
    assert index.store.vacuum(1) == 3 and index.load().count() == 266
    with pytest.raises(RuntimeError):
        index.store.replace([0], index.load().limit(0), expected=1)


def test_a_stream_folds_what_its_batches_touch(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", 4, 2)
    batches = [
        [(11, "upsert", "a", "x", [1.0]), (12, "upsert", "a", "y", [2.0]), (13, "upsert", "b", "x", [3.0])],
        [(14, "upsert", "a", "x", [4.0]), (15, "remove", "a", "y", None), (16, "upsert", "c", "z", [6.0])],
        [(17, "purge", "b", None, None), (18, "upsert", "a", "y", [8.0])],
        [(5, "upsert", "d", "late", [9.0]), (19, "remove", "d", "late", None)],  # older than what was applied
        [(4, "upsert", "d", "later", [9.5])],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, OPS).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        ingest(spark, f"file://{tmp_path}/in/*", f"file://{tmp_path}/log", store, f"file://{tmp_path}/cp").awaitTermination()
    got = {(r.namespace, r.item_id): (list(r.vector), r.seq) for r in store.read().collect()}
    assert got == {("a", "x"): ([4.0], 11), ("a", "y"): ([8.0], 18), ("c", "z"): ([6.0], 16), ("d", "later"): ([9.5], 4)}
    assert store.version() == 5


def test_migration(spark, tmp_path):
    blob = lambda *x: np.array(x, "<f4").tobytes()
    store = "id long, agent_id string, embedding binary"
    memories = spark.createDataFrame([(1, "p", blob(1, 2)), (2, None, blob(3, 4)), (3, "p", b""), (4, "p", b"abc"), (5, "p", blob(1, 2, 3)), (6, "p", None)], store)
    episodes = spark.createDataFrame([(1, "q", blob(5, 6))], store)
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    assert migrate(index, memories.drop("embedding"), episodes).code == 1
    dry = migrate(index, memories, episodes, expect_dim=2, dry_run=True)
    assert (dry.code, dry.n_rows, dry.n_migrated, dry.n_skipped, dry.n_total) == (0, 4, 3, 1, None) and index.store.version() == 0
    assert migrate(index, memories, episodes, agent_id="nobody").message == "nothing to migrate" and index.store.version() == 0
    done = migrate(index, memories, episodes, expect_dim=2)
    assert (done.code, done.n_migrated, done.n_total, done.n_namespaces) == (0, 3, 3, 3)
    again = migrate(index, memories, episodes)
    assert (again.n_migrated, again.n_total) == (4, 4)
    assert {(r.namespace, r.item_id) for r in index.load().collect()} == {("cpersona:p", "mem:1"), ("cpersona:None", "mem:2"), ("cpersona:p", "mem:5"), ("cpersona:q", "ep:1")}


@pytest.fixture
def service():
    class Handler(BaseHTTPRequestHandler):
        fail = 0

        def log_message(self, *_):
            pass

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            Handler.seen = dict(self.headers), body
            if Handler.fail:
                Handler.fail -= 1
                self.send_response(503)
                self.end_headers()
                return
            out = json.dumps({"data": [{"embedding": [3.0, 4.0 * len(t), 0.0]} for t in body["input"]]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", Handler
    server.shutdown()


def test_remote_provider(spark, service):
    url, handler = service
    p = pv.RemoteProvider("key", url, retries=1)
    with pytest.raises(RuntimeError):
        p.embed(["a"])
    p.initialize()
    assert p.dimensions() == 1536
    assert np.allclose(p.embed(["a"]), [[0.6, 0.8, 0.0]]) and p.dimensions() == 3
    headers, body = handler.seen
    assert headers["Authorization"] == "Bearer key" and body == {"model": "text-embedding-3-small", "input": ["a"]}
    handler.fail = 1
    assert p.embed(["a"]).shape == (1, 3)
    handler.fail = 2
    with pytest.raises(OSError):
        p.embed(["a"])
    with pytest.raises(ValueError):
        pv.RemoteProvider("", url).initialize()
    df = spark.createDataFrame([("a",), (None,), ("bb",)], "text string")
    got = [r[0] for r in df.select(pv.embed(F.col("text"), provider=pv.RemoteProvider("key", url))).collect()]
    assert got[1] is None and np.allclose(got[0], [0.6, 0.8, 0.0]) and len(got[2]) == 3


def test_provider_of_settings(tmp_path):
    s = Settings.read({"EMBEDDING_PROVIDER": "onnx_bge_m3", "ONNX_MODEL_DIR": str(tmp_path)})
    p = pv.provider_of(s)
    assert p.dimensions() == 1024 and p.folder == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        p.initialize()
    assert isinstance(pv.provider_of(Settings.read({})), pv.RemoteProvider)


def test_accelerators_are_found():
    have = ["CPUExecutionProvider", "CUDAExecutionProvider", "CoreMLExecutionProvider"]
    assert pv.execution_providers(None, have) == ["CoreMLExecutionProvider", "CUDAExecutionProvider", "CPUExecutionProvider"]
    assert pv.execution_providers(" CUDAExecutionProvider ", have) == ["CUDAExecutionProvider", "CPUExecutionProvider"]
    assert pv.execution_providers("Absent", have) == ["CPUExecutionProvider"] and pv.execution_providers(None)[-1] == "CPUExecutionProvider"


def test_settings():
    s = Settings.read({})
    assert (s.provider, s.http_port, s.timeout, s.index_enabled, s.max_seq_len) == ("api_openai", 8401, 30, True, 2048)
    s = Settings.read({"EMBEDDING_INDEX_ENABLED": "no", "EMBEDDING_SEARCH_BACKEND": "NumPy", "NEARFIELD_AUTH_TOKEN": " t "})
    assert not s.index_enabled and s.search_backend == "numpy" and s.auth_token == "t"
    for bad in ({"EMBEDDING_HTTP_PORT": "0"}, {"EMBEDDING_HTTP_PORT": "x"}, {"ONNX_MAX_SEQ_LEN": "9000"}, {"EMBEDDING_SEARCH_BACKEND": "other"}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            Settings.read(bad)


def test_startup_and_guard():
    assert "enabled" in rq.check_startup("api", "127.0.0.1", {"NEARFIELD_AUTH_TOKEN": "t"})
    assert "UNAUTHENTICATED" in rq.check_startup("api", "127.0.0.1", {"NEARFIELD_AUTH_TOKEN": "  "})
    with pytest.raises(ValueError):
        rq.check_startup("api", "127.0.0.1", {"NEARFIELD_REQUIRE_AUTH": "yes"})

    def status(token, scope):
        sent = []

        async def app(scope, receive, send):
            sent.append({"status": 200})

        async def send(m):
            sent.append(m)

        asyncio.run(rq.BearerGuard(app, token)(scope, None, send))
        return sent[0].get("status")

    ask = lambda *h, method="GET", kind="http": {"type": kind, "method": method, "headers": list(h)}
    assert status("t", ask()) == 401 and status("t", ask((b"Authorization", b"Bearer t"))) == 200
    assert status("t", ask((b"authorization", b"Basic t"))) == 401 and status("t", ask(method="OPTIONS")) == 200
    assert status("", ask()) == 200 and status("t", {"type": "lifespan"}) == 200
