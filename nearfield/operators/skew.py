"""Per-key results when a few keys hold most rows: multi-level tree aggregation.

Fixed-size chunks of the input are combined where they are read; the partial states of a key then meet in rounds of
bounded fan-in, so no task receives more than `fan_in` times the states one task wrote, whatever share of the rows a key has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.arrays import column, usable_by_dim
from nearfield.operators.live import live_rows

Combine = Callable[[pa.Table], pa.Table]


def reading_tasks(df: DataFrame) -> int:
    """About how many tasks read df: the bytes of its sources by the size of a split, and no fewer than a shuffle has."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(plan.apply(i).stats().sizeInBytes())) for i in range(plan.size()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    # a source without statistics claims the largest possible size
    tasks = -(-size // split) if size < 1 << 60 else 0
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)


def tree_aggregate(df: DataFrame, keys: list[str], local: Combine, merge: Combine, schema: str, fan_in: int = 8, leaves: int | None = None, max_states: int = 16_384) -> DataFrame:
    """One row per key. local maps a chunk of df to states (columns of `schema`, keys first), merge makes one state of all
    states of each key; both see Arrow tables. A task keeps max_states states at most and passes on full sets of them.

    leaves: about how many tasks read df; it sets the number of rounds, log(leaves) to the base fan_in. By default it is
    estimated from the bytes that df's sources hold.
    """
    leaves = leaves or reading_tasks(df)
    rounds = max(1, math.ceil(math.log(max(leaves, 2)) / math.log(fan_in)))

    def emit(t: pa.Table, node: int) -> Iterator[pa.RecordBatch]:
        t = t.append_column("_node", pa.array(np.full(t.num_rows, node, np.int64)))
        yield from t.combine_chunks().to_batches(max_chunksize=4096)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, kept = TaskContext.get().partitionId() % fan_in**rounds, None
        for b in batches:
            t = local(pa.Table.from_batches([b]))
            kept = t if kept is None else merge(pa.concat_tables([kept, t]))
            if kept.num_rows > max_states:
                yield from emit(kept, node)
                kept = None
        if kept is not None:
            yield from emit(kept, node)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        done: pa.Table | None = None
        for b in batches:
            waiting.append(b)
            if sum(x.num_rows for x in waiting) > max_states:
                t = pa.Table.from_batches(waiting)
                done, waiting = (_per_node(t if done is None else pa.concat_tables([done, t]), merge)), []
        if waiting:
            t = pa.Table.from_batches(waiting)
            done = _per_node(t if done is None else pa.concat_tables([done, t]), merge)
        if done is not None:
            yield from done.combine_chunks().to_batches(max_chunksize=4096)

    states = df.mapInArrow(first, schema + ", _node long")
    for _ in range(rounds):
        states = states.withColumn("_node", F.floor(F.col("_node") / fan_in)).repartition(*keys, "_node").mapInArrow(again, schema + ", _node long")
    return states.drop("_node")


def _per_node(t: pa.Table, merge: Combine) -> pa.Table:
    """Merge within each node; a task may hold several."""
    node, out = t["_node"].to_numpy(), []
    for x in np.unique(node):
        part = merge(t.filter(pa.array(node == x)).drop_columns(["_node"]))
        out.append(part.append_column("_node", pa.array(np.full(part.num_rows, x, np.int64))))
    return pa.concat_tables(out)


def _summed(t: pa.Table, key: str) -> pa.Table:
    return t.select([key, "n"]).group_by(key).aggregate([("n", "sum")]).rename_columns([key, "n"])


def key_counts(df: DataFrame, key: str, **kw: int) -> DataFrame:
    """(key, n): rows of each value of a string column, nulls as a value of their own."""

    def local(t: pa.Table) -> pa.Table:
        return _summed(pa.table({key: t[key], "n": np.ones(t.num_rows, np.int64)}), key)

    return tree_aggregate(df.select(key), [key], local, lambda t: _summed(t, key), f"{key} string, n long", **kw)


def heavy_keys(df: DataFrame, key: str, share: float, **kw: int) -> DataFrame:
    """(key, n, total) of the values that hold more than `share` of all rows; fewer than 1 / share of them can."""
    counts = key_counts(df, key, **kw).persist()  # a row a value
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.withColumn("total", F.lit(total)).filter(F.col("n") > total * share)


PROFILE = "namespace string, dim int, n_rows long, n_live long, n_usable long, total binary, last_seq long, last_item_id string, last_created_at timestamp"


def _codes(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row by namespace and dim, first row of each group)."""
    ns = pc.fill_null(t["namespace"].combine_chunks().dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    _, first, group = np.unique(ns * 2**31 + t["dim"].to_numpy(), return_index=True, return_inverse=True)
    return group, first


def _merge_profiles(t: pa.Table) -> pa.Table:
    if not t.num_rows:
        return t
    t = t.combine_chunks()
    group, first = _codes(t)
    out = {c: t[c].take(pa.array(first)) for c in ("namespace", "dim")}
    for c in ("n_rows", "n_live", "n_usable"):
        s = np.zeros(len(first), np.int64)
        np.add.at(s, group, t[c].to_numpy())
        out[c] = pa.array(s)
    sums: list[np.ndarray | None] = [None] * len(first)
    for g, v in zip(group, t["total"].to_pylist(), strict=True):
        if v:
            x = np.frombuffer(v)
            sums[g] = x if sums[g] is None else sums[g] + x
    out["total"] = pa.array([None if v is None else v.tobytes() for v in sums], pa.binary())
    by = np.lexsort((t["last_seq"].to_numpy(), group))
    last = by[np.append(np.diff(group[by]) != 0, True)]
    for c in ("last_seq", "last_item_id", "last_created_at"):
        out[c] = t[c].take(pa.array(last))
    return pa.table(out)


def _chunk_profiles(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    b = t.to_batches()[0] if t.num_rows else None
    if b is None:
        return pa.table({"namespace": pa.array([], pa.string()), "dim": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in ("n_rows", "n_live", "n_usable")}, "total": pa.array([], pa.binary()), "last_seq": pa.array([], pa.int64()), "last_item_id": pa.array([], pa.string()), "last_created_at": t["created_at"]})
    dim = pc.fill_null(pc.list_value_length(column(b, "vector")), 0).to_numpy(zero_copy_only=False).astype(np.int32)
    rows = pa.table({"namespace": t["namespace"], "dim": pa.array(dim)}).combine_chunks()
    group, first = _codes(rows)
    k = len(first)
    usable, sums = np.zeros(k, np.int64), [None] * k
    for d, at, m in usable_by_dim(column(b, "vector")):
        g = group[at]
        np.add.at(usable, g, 1)
        order = np.argsort(g, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(g[order]) != 0)) if len(g) else []
        if len(g):
            part = np.add.reduceat(m[order].astype(np.float64), starts, axis=0)
            for x, v in zip(g[order][starts], part, strict=True):
                sums[x] = v.tobytes()
    seq = t["seq"].to_numpy()
    by = np.lexsort((seq, group))
    last = by[np.append(np.diff(group[by]) != 0, True)]
    return pa.table({
        "namespace": rows["namespace"].take(pa.array(first)), "dim": rows["dim"].take(pa.array(first)),
        "n_rows": np.bincount(group, t["n_versions"].to_numpy(), k).astype(np.int64), "n_live": np.bincount(group, minlength=k), "n_usable": usable,
        "total": pa.array(sums, pa.binary()), "last_seq": seq[last], "last_item_id": t["item_id"].take(pa.array(last)), "last_created_at": t["created_at"].take(pa.array(last)),
    })


def namespace_profiles(log: DataFrame, **kw: int) -> DataFrame:
    """Per namespace and dimension of the live vector (0: null or empty): rows of the log, dead ones included (n_rows), live
    rows, usable live rows, their mean vector (null if there is none) and the latest live row.

    log: namespace, item_id, vector, created_at, seq; other columns are ignored. Null namespaces form a namespace. Rows
    with a null seq are left out. An empty log gives no row.
    """
    live = live_rows(log.select("namespace", "item_id", "vector", "created_at", "seq"), versions=True)
    found = tree_aggregate(live, ["namespace", "dim"], _chunk_profiles, _merge_profiles, PROFILE, **kw)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = column(b, "n_usable").to_numpy()
            mean = pa.array([None if v is None else np.frombuffer(v) / c for v, c in zip(column(b, "total").to_pylist(), n, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([mean if c == "total" else column(b, c) for c in b.schema.names], ["mean" if c == "total" else c for c in b.schema.names])

    return found.mapInArrow(means, PROFILE.replace("total binary", "mean array<double>"))
