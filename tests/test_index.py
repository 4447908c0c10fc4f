"""The index against a plain model, and its edge cases."""

import struct

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions.codec import decode_blob, encode_vector
from nearfield.operators import index as ix
from nearfield.operators.backfill import backfill, summary
from nearfield.operators import live
from nearfield.operators import search as search_operators
from nearfield.operators.live import live_rows
from nearfield.operators.search import clamp, matrix_blocks, search, search_batch, search_blocks, search_resident
from nearfield.operators.service import VectorIndex
from nearfield.schema import OPS
from nearfield.sources.store import SnapshotStore
from nearfield.streaming.ingest import ingest

LOG = "namespace string, item_id string, vector array<float>, seq long"


def model(ops):
    state, removed = {}, {}
    for seq, op, ns, item, v in ops:
        if op == "upsert":
            old = state.get((ns, item))
            state[ns, item] = (v, old[1] if old else seq)
        elif op == "remove":
            removed[seq] = int(state.pop((ns, item), None) is not None)
        else:
            gone = [k for k in state if k[0] == ns]
            removed[seq] = len(gone)
            for k in gone:
                del state[k]
    return state, removed


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["upsert", "upsert", "upsert", "remove", "purge"]), st.sampled_from(["a", "", "1"]), st.sampled_from(["x", "y", "z"])), min_size=1, max_size=40))
def test_fold_equals_model(spark, steps):
    ops = [(i, op, ns, item, [float(i)] if op == "upsert" else None) for i, (op, ns, item) in enumerate(steps)]
    df = spark.createDataFrame(ops, OPS)
    state, removed = model(ops)
    got = {(r.namespace, r.item_id): (list(r.vector), r.seq) for r in ix.fold(df).collect()}
    assert got == {k: (v, s) for k, (v, s) in state.items()}
    assert {r.op_seq: r.n_removed for r in ix.removed_counts(df).collect()} == removed


def test_live_rows(spark, monkeypatch):
    rows = [("n", "a", [1.0], 1), ("n", "a", [2.0], 5), ("n", "b", None, 2), (None, None, [3.0], 3), (None, None, [4.0], 4), ("n", "c", [1.0], None)]
    got = {(r.namespace, r.item_id, r.seq) for r in live_rows(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {("n", "a", 5), ("n", "b", 2), (None, None, 4)}
    assert {(r.seq, r.n_versions) for r in live_rows(spark.createDataFrame(rows, LOG), versions=True).collect()} == {(5, 2), (2, 1), (4, 2)}
    # a bitmap with room for all keys, for few, and for none to speak of
    many = [(f"n{i % 7}", f"i{i}", [float(i)], i) for i in range(3000)] + [(f"n{i % 7}", f"i{i}", [float(i)], 10_000 + i) for i in range(0, 3000, 3)]
    want = {10_000 + i if i % 3 == 0 else i for i in range(3000)}
    for bits in (1 << 29, 1 << 15, 1 << 10, 2):
        monkeypatch.setattr(live, "MOST_BITS", bits)
        got = live_rows(spark.createDataFrame(many, LOG).withColumn("_bucket2", F.lit(1)))
        assert sorted(r.seq for r in got.collect()) == sorted(want) and got.columns[-1] == "_bucket2"
    assert live_rows(spark.createDataFrame([], LOG)).count() == 0


def brute(rows, queries, k, least):
    out = set()
    for qid, ns, q in queries:
        hits = [(-float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(q)))), seq, item) for n, item, v, seq in rows if n == ns and v and len(v) == len(q)]
        hits = sorted(h for h in hits if -h[0] >= least)[:k]
        out |= {(qid, r + 1, item, round(-s, 4) + 0.0) for r, (s, _, item) in enumerate(hits)}
    return out


@pytest.mark.parametrize("kernel", [search_batch, search_blocks, lambda i, q, k, s: search_resident(matrix_blocks(i, 16), q, k, s)])
def test_search_matches_brute_force(spark, kernel):
    rng = np.random.default_rng(3)
    rows = [(f"n{i % 3}", f"i{i}", rng.normal(size=4 if i % 7 else 2).astype(np.float32).tolist(), i) for i in range(120)]
    rows += [(ns, item + "+", v, seq + 1000) for ns, item, v, seq in rows[:40]]  # ties
    rows += [("n0", "nan", [float("nan")] * 4, 5000), ("n0", "null", None, 5001), ("n0", "none", [], 5002)]
    queries = [(i, f"n{i % 4}", rng.normal(size=4).astype(np.float32).tolist()) for i in range(8)]
    df = spark.createDataFrame(rows, LOG).withColumn("qid", F.lit(7))  # a clashing extra column
    got = {(r.qid, r["rank"], r.item_id, r.score) for r in kernel(df, spark.createDataFrame(queries, "qid long, namespace string, vector array<float>"), 5, 0.0).collect()}
    finite = [r for r in rows if r[2] and not any(x != x for x in r[2])]
    assert got == brute(finite, queries, 5, 0.0)
    assert kernel(df, spark.createDataFrame([], "qid long, namespace string, vector array<float>"), 5, 0.0).count() == 0


def test_search_orders_equal_vectors_by_position(spark):
    """Copies in different blocks, and at the k-th place, among rows whose products round differently."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 37)).astype(np.float32)
    v[[150, 20, 90]] = v[10]
    rows = [("a", f"i{s}", v[s].tolist(), s) for s in range(200)] + [("a", "nan", [float("nan")] * 37, 900), ("a", "inf", [float("inf")] * 37, 901)]
    index = spark.createDataFrame(rows, LOG)
    queries = spark.createDataFrame([(i, "a", (v[10] * (1 + i)).tolist()) for i in range(9)], "qid long, namespace string, vector array<float>")
    for k in (2, 3, 4, 7):
        for parts in (1, 3, 7):
            part = index.repartition(parts, "seq")
            for got in (search_blocks(part, queries, k, 0.0), search_resident(matrix_blocks(part, 16), queries, k, 0.0)):
                by = {}
                for r in got.orderBy("qid", "rank").collect():
                    by.setdefault(r.qid, []).append(r.item_id)
                tied = ["i10", "i20", "i90", "i150"]
                assert all([x for x in y if x in tied] == tied[: k - ("inf" in y)] for y in by.values()) and len(by) == 9


def test_search_cells(spark, monkeypatch):
    """More queries than are sent to all tasks meet the index in cells: no join of rows, whatever the sizes of cells and lookups."""
    rng = np.random.default_rng(4)
    names = ["large", "large", "large", "", None, "other"]
    rows = [(names[i % 6], f"i{i}", rng.normal(size=4 if i % 7 else 2).astype(np.float32).tolist(), i) for i in range(300)]
    rows += [("large", f"copy{i}", rows[1][2], 1000 + i) for i in range(60)]  # one vector, in all slices
    rows += [("large", "nan", [float("nan")] * 4, 5000), ("large", "null", None, 5001), ("large", "none", [], 5002)]
    queries = [(i, names[i % 6], rng.normal(size=4 if i % 5 else 2).astype(np.float32).tolist()) for i in range(90)]
    queries += [(90, "large", rows[1][2]), (91, "nowhere", [1.0, 0.0]), (92, "large", []), (93, "large", None), (94, "large", [1.0])]
    index, asked = spark.createDataFrame(rows, LOG).repartition(3), spark.createDataFrame(queries, "qid long, namespace string, vector array<float>")
    want = brute([r for r in rows if r[2] and not any(x != x for x in r[2])], [x for x in queries if x[2]], 5, 0.0)
    monkeypatch.setattr(search_operators, "MAX_BROADCAST_QUERIES", 10)
    monkeypatch.setattr(search_operators, "search_batch", None)
    for queries_a_cell, rows_a_cell, groups in ((8192, 32768, 10_000), (7, 20, 10_000), (40, 9, 0)):
        for n, v in (("CELL_QUERIES", queries_a_cell), ("CELL_ROWS", rows_a_cell), ("MAX_BROADCAST_GROUPS", groups)):
            monkeypatch.setattr(search_operators, n, v)
        got = search_blocks(index, asked, 5, 0.0).collect()
        assert {(r.qid, r["rank"], r.item_id, r.score) for r in got} == want and len(got) == len(want)
    assert search_blocks(index, asked, 0, 0.0).count() == 0
    q, m = (rng.normal(size=(n, 37)).astype(np.float32) for n in (20, 90))
    total = 0
    for x, y in zip(q[0].tolist(), m[0].tolist(), strict=True):
        total += x * y
    assert search_operators._dots(q[:1], m[:1]).tolist() == [total]
    whole = search_operators._best(q, m, 5, 0.0)
    monkeypatch.setattr(search_operators, "TILE", 300)
    assert len(list(search_operators._best_tiles(q, m, 5, 0.0))) == 7 and all((x == y).all() for x, y in zip(whole, search_operators._best(q, m, 5, 0.0), strict=True))


def test_search_limits(spark):
    df = spark.createDataFrame([("n", f"i{i}", [1.0, 0.0], i) for i in range(20)], LOG)
    assert [r.item_id for r in search(df, "n", [1.0, 0.0], 5, 0.0).collect()] == [f"i{i}" for i in range(5)]
    assert search(df, "n", [1.0, 0.0], 0, 0.0).count() == search(df, "n", [1.0, 0.0], -1, 0.0).count() == 0
    assert search(df, "no", [1.0, 0.0]).count() == search(df, "n", []).count() == search(df, "n", [1.0]).count() == 0
    assert (clamp(None), clamp(0), clamp(-3), clamp(501)) == (10, 0, 0, 500)


def test_blob_roundtrip(spark):
    good = struct.pack("<3f", 1.5, -2.0, 0.25)
    got = [r[0] for r in spark.createDataFrame([(good,), (good[:-1],), (b"",), (None,)], "b binary").select(decode_blob("b")).collect()]
    assert got == [[1.5, -2.0, 0.25], None, None, None]
    assert bytes(spark.createDataFrame([([1.5, -2.0, 0.25],)], "v array<float>").select(encode_vector("v")).first()[0]) == good


def test_backfill(spark):
    blob = struct.pack("<2f", 1, 2)
    mem = spark.createDataFrame([(1, "a", blob), (1, "a", blob), (2, None, blob), (3, "a", None), (4, "a", b""), (5, "a", blob[:5]), (6, "b", blob + blob)], "id long, agent_id string, embedding binary")
    ep = spark.createDataFrame([(1, "a", blob)], "id long, agent_id string, embedding binary")
    got = {(r.namespace, r.item_id, r.dim) for r in backfill(mem, ep).collect()}
    assert got == {("cpersona:a", "mem:1", 2), ("cpersona:None", "mem:2", 2), ("cpersona:b", "mem:6", 4), ("cpersona:a", "ep:1", 2)}
    assert {r.item_id for r in backfill(mem, ep, agent_id="a").collect()} == {"mem:1", "ep:1"}
    assert tuple(summary(mem, ep, expect_dim=2).first()) == (5, 4, 1, 3, 2)
    assert tuple(summary(mem.limit(0), None).first()) == (0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        backfill(mem.drop("embedding"), ep)


def test_service_lifecycle(spark, tmp_path):
    i = VectorIndex(spark, f"file://{tmp_path}/index")
    assert i.count("n") == 0 and i.search("n", "red apple").count() == 0
    items = spark.createDataFrame([("a", "red apple", 0), ("b", "green pear", 1), ("a", "blue plum", 2)], "id string, text string, pos long")
    assert i.index("n", items) == 3 and i.count("n") == 2
    assert i.index("m", items) == 3
    assert [r.item_id for r in i.search("n", "blue plum").collect()][0] == "a"
    assert i.search("n", "blue plum", 1).first().score == pytest.approx(1.0)
    asked = spark.createDataFrame([(1, "n", "green pear"), (2, "m", "blue plum"), (3, "no", "x")], "qid long, namespace string, text string")
    assert {(r.qid, r.item_id) for r in i.search_many(asked, 1).collect()} == {(1, "b"), (2, "a")}
    assert i.remove("n", ["a", "a", "no"]) == 1 and i.count("n") == 1 and i.count("m") == 2
    assert i.purge("m") == 2 and i.purge("m") == 0
    again = VectorIndex(spark, f"file://{tmp_path}/index")
    assert [r.item_id for r in again.search("n", "green pear").collect()] == ["b"]
    assert again.upsert_vectors(spark.createDataFrame([("z", "v", [1.0, 0.0])], "namespace string, item_id string, vector array<float>")) == 1
    assert again.count("z") == 1 and again.store.vacuum(1) > 0 and again.count("z") == 1
    i.shutdown()
    again.shutdown()


def test_store_refuses_a_lost_race(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", 4)
    df = spark.createDataFrame([("", "1", [1.0], 1, None, 0)], "namespace string, item_id string, vector array<float>, dim int, created_at timestamp, seq long")
    assert store.publish(df, 0) == 1
    with pytest.raises(RuntimeError):
        store.publish(df, 0)
    assert store.read("").count() == 1 and store.read("x").count() == 0


def test_streaming_ingest(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", 4)
    args = (spark, f"{tmp_path}/in", f"{tmp_path}/log", store, f"{tmp_path}/ck")
    for ops in ([(1, "upsert", "n", "a", [1.0]), (2, "upsert", "n", "b", [2.0])], [(3, "remove", "n", "a", None), (4, "upsert", "n", "b", [3.0])]):
        spark.createDataFrame(ops, OPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest(*args).awaitTermination()
    assert [(r.item_id, list(r.vector), r.seq) for r in store.read().collect()] == [("b", [3.0], 2)]
