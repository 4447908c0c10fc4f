"""Vector arithmetic, tokens, providers, requests and tree aggregation on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import tokens as tok
from nearfield.functions import vector as vec
from nearfield.operators import providers as pv
from nearfield.operators import requests as rq
from nearfield.operators.skew import heavy_keys, key_counts, namespace_profiles

V = "id int, a array<float>, b array<float>"


def test_dot_and_norms(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0]), (2, [1.0], [1.0, 2.0]), (3, [float("nan")], [1.0]), (4, None, [1.0]), (5, [], [])], V)
    assert [r[0] for r in df.orderBy("id").select(vec.dot(F.col("a"), F.col("b"))).collect()] == [11.0, None, None, None, 0.0]
    z = spark.createDataFrame([(1, [0.0, 0.0], [3.0, 4.0])], V)
    g, c, u = z.select(vec.l2_guard(F.col("a")), vec.l2_clip(F.col("a")), vec.l2_clip(F.col("b"))).first()
    assert g == c == [0.0, 0.0] and u == pytest.approx([0.6, 0.8])


def test_pooling_ignores_padding(spark):
    rng = np.random.default_rng(7)
    t = rng.normal(size=(3, 4, 5)).astype(np.float32)
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]])
    longer, wide = np.concatenate([t, np.ones((3, 6, 5), np.float32)], 1), np.concatenate([mask, np.zeros((3, 6), int)], 1)
    for how in ("mean", "cls", "last"):
        np.testing.assert_allclose(pv.pooled(t, mask, how), pv.pooled(longer, wide, how), atol=1e-6)
    df = spark.createDataFrame([(i, t[i].tolist(), int(mask[i].sum())) for i in range(3)], "id int, t array<array<float>>, n int").orderBy("id")
    got = np.array([r[0] for r in df.select(vec.pool_mean(F.col("t"), F.col("n"))).collect()])
    np.testing.assert_allclose(got, pv.pooled(t, mask, "mean"), atol=1e-6)
    assert np.allclose([r[0] for r in df.select(vec.pool_last(F.col("t"), F.col("n"))).collect()], pv.pooled(t, mask, "last"))


def test_pad_longest(spark):
    df = spark.createDataFrame([(1, "x", [5, 6, 7, 8]), (2, "x", [9]), (3, None, [1, 2]), (4, "x", [])], "id int, batch string, ids array<bigint>")
    got = {r.id: (r.input_ids, r.attention_mask, r.token_type_ids) for r in tok.pad_longest(df, "ids", "batch", 1, 3).collect()}
    assert got == {1: ([5, 6, 7], [1, 1, 1], [0] * 3), 2: ([9, 1, 1], [1, 0, 0], [0] * 3), 3: ([1, 2], [1, 1], [0, 0]), 4: ([1, 1, 1], [0, 0, 0], [0] * 3)}


def test_hash_embedding(spark):
    df = spark.createDataFrame([("red red apple",), ("",), (None,)], "t string").select(tok.hash_embedding(F.col("t")).alias("v"))
    a, empty, none = (r.v for r in df.collect())
    assert np.linalg.norm(a) == pytest.approx(1, abs=1e-6) and not any(empty) and none is None


def test_providers(spark):
    assert pv.resolve("auto_bge_m3").dims == 1024
    for key in ("mlx_bge_m3", "nothing"):
        with pytest.raises(ValueError):
            pv.resolve(key)
    df = spark.createDataFrame([(i, "x" * i if i % 5 else None) for i in range(23)], "id int, t string").coalesce(1)
    got = {r.id: r.v for r in df.select("id", pv.embed(F.col("t"), "api_openai", call_api=lambda ts: [[3.0 * len(t), 4.0 * len(t)] for t in ts], size=4).alias("v")).collect()}
    assert all((v is None) == (i % 5 == 0) for i, v in got.items()) and got[3] == pytest.approx([0.6, 0.8])


def test_provider_settings():
    assert pv.execution_providers("X, CUDAExecutionProvider,CPUExecutionProvider", ["CPUExecutionProvider", "CUDAExecutionProvider"]) == ["CUDAExecutionProvider", "CPUExecutionProvider"]
    assert pv.execution_providers(None, []) == ["CPUExecutionProvider"]
    assert pv.model_dir("auto_bge_m3", {}) == "models/onnx_bge_m3" and pv.model_dir("onnx_miniml", {"NEARFIELD_MODEL_DIR": "/m"}) == "/m"


def test_encode_batch_pads_to_the_longest_text():
    class Tok:
        def encode_batch(self, texts):
            return [type("E", (), {"ids": list(range(1, len(t) + 1))}) for t in texts]

    class Session:
        def get_inputs(self):
            return [type("I", (), {"name": "token_type_ids"})]

        def run(self, _, feed):
            self.shape = feed["input_ids"].shape
            assert feed["token_type_ids"].sum() == 0
            return [np.ones((*self.shape, 4), np.float32)]

    s = Session()
    out = pv.encode_batch(["ab", "abcd"], Tok(), s, pv.resolve("onnx_miniml"))
    assert s.shape == (2, 4) and out.shape == (2, 4) and np.allclose(np.linalg.norm(out, axis=1), 1)


def test_auth():
    assert rq.token_matches("a", "a") and not rq.token_matches("", "") and not rq.token_matches("é", "e")
    assert rq.auth_required(" TRUE ") and rq.auth_required("on") and not rq.auth_required("maybe") and not rq.auth_required(None)
    assert rq.startup_posture("t", True) == "enabled" and rq.startup_posture(" ", False) == "open"
    with pytest.raises(ValueError):
        rq.startup_posture("", True)
    assert rq.strict(True, int, 3) == 3 and rq.strict(4, float, 0.0) == 4.0 and rq.strict("x", str, "") == "x" and rq.strict([], dict, None) is None


def test_auth_status(spark):
    df = spark.createDataFrame([("Bearer t", "GET"), ("bearer  t ", "GET"), ("Basic t", "OPTIONS"), (None, "GET")], "h string, m string")
    assert [r[0] for r in df.select(rq.auth_status(F.col("h"), "t", F.col("m"))).collect()] == [200, 200, 200, 401]


def test_not_ready(spark):
    df = spark.createDataFrame([("{}",)], "b string")
    assert df.select(rq.verdict("purge", F.col("b"), ready=False).alias("v")).first().v.status == 503


def test_blank_of_any_script(spark):
    df = spark.createDataFrame([('{"query": "　 "}',)], "b string")
    assert df.select(rq.verdict("search", F.col("b")).alias("v")).first().v.status == 400


def test_tree_aggregation(spark):
    rows = [(("hot" if i % 3 else None if i % 2 else f"k{i % 50}"), f"i{i % 40}", [float(i), 1.0] if i % 11 else [0.0, 0.0] if i % 2 else [], None, i) for i in range(600)]
    df = spark.createDataFrame(rows, "namespace string, item_id string, vector array<float>, created_at timestamp, seq long").repartition(7)
    from collections import Counter

    for kw in ({"fan_in": 2, "leaves": 30}, {"max_states": 3}, {}):
        assert {r.namespace: r.n for r in key_counts(df, "namespace", **kw).collect()} == Counter(r[0] for r in rows)
        live = {}
        for r in rows:
            live[r[0], r[1]] = r
        n = Counter((r[0], len(r[2])) for r in live.values())
        got = {(p.namespace, p.dim): p for p in namespace_profiles(df, **kw).collect()}
        assert {k: p.n_live for k, p in got.items()} == n
        assert sum(p.n_rows for p in got.values()) == 600
        for (ns, d), p in got.items():
            mine = [r for r in live.values() if (r[0], len(r[2])) == (ns, d)]
            ok = [r[2] for r in mine if any(r[2])]
            assert p.n_usable == len(ok) and p.last_seq == max(r[4] for r in mine)
            assert (p["mean"] is None) == (not ok) and (not ok or np.allclose(p["mean"], np.mean(ok, 0)))
    assert {r.namespace for r in heavy_keys(df, "namespace", 0.1).collect()} == {"hot", None}
    empty = df.limit(0)
    assert namespace_profiles(empty).count() == heavy_keys(empty, "namespace", 0.1).count() == 0
