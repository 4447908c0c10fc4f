"""Exact top-k similarity search: the plain dot product, threshold inclusive, ties by insertion order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.arrays import column, ragged
from nearfield.functions.vector import dot, score
from nearfield.schema import LIMITS
from nearfield.session import persist_table

#: So many query vectors at most are sent to all tasks; beyond it queries and index are joined by namespace and dimension.
MAX_BROADCAST_QUERIES = 20_000
#: And so many bytes of them.
MAX_BROADCAST_BYTES = 32 << 20
#: So many namespaces and dimensions at most are looked up in a broadcast table; beyond it they are joined by shuffle.
MAX_BROADCAST_GROUPS = 10_000
#: A cell of search_cells holds about so many queries and index rows, and fewer if the rows have more bytes than this.
CELL_QUERIES, CELL_ROWS, CELL_BYTES = 8_192, 32_768, 16 << 20
#: Products that are held at once.
TILE = 1 << 22
RESULT = ["qid", "rank", "item_id", "score"]


def clamp(k: int | None) -> int:
    """The number of results allowed: no more than the cap, none below 0."""
    return max(0, min(LIMITS.default_results if k is None else k, LIMITS.results))


def search(index: DataFrame, namespace: str, query: list[float], k: int | None = None, min_similarity: float = LIMITS.default_similarity) -> DataFrame:
    """(rank, item_id, score) for one query vector; a TakeOrderedAndProject over the namespace's rows of equal dimension.

    Null and NaN similarities are dropped; an empty query, an unknown namespace and k <= 0 give no row.
    """
    raw = dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]).cast("array<float>")) if query else F.lit(None).cast("double")
    rows = index.filter(F.col("namespace").eqNullSafe(namespace) & (F.size("vector") == len(query)))
    top = rows.select("item_id", "seq", raw.alias("raw")).orderBy(F.desc_nulls_last("raw"), "seq").limit(clamp(k)).filter(F.col("raw") >= min_similarity)
    w = Window.orderBy(F.desc("raw"), "seq")  # at most 500 rows
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "item_id", score(F.col("raw")).alias("score"))


def ranked(scored: DataFrame, k: int, min_similarity: float) -> DataFrame:
    """The k best of each qid by raw score, ties by seq, of those that reach the threshold."""
    w = Window.partitionBy("qid").orderBy(F.desc("raw"), "seq")
    top = scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    # the threshold commutes with the ranking on the same key; applied after it the score is computed once
    return top.filter(F.col("raw") >= min_similarity).select("qid", "rank", "item_id", score(F.col("raw")).alias("score"))


def search_batch(index: DataFrame, queries: DataFrame, k: int | None = None, min_similarity: float = LIMITS.default_similarity) -> DataFrame:
    """(qid, rank, item_id, score) for queries (qid, namespace, vector), by joining them to the rows of their namespace and
    dimension and keeping k a task before the exchange."""
    q = queries.select("qid", F.col("namespace").alias("_ns"), F.col("vector").alias("_q"), F.size("vector").alias("_dim"))
    n = queries.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(0))), F.lit(0)).alias("floats")).first()
    if n.rows <= MAX_BROADCAST_QUERIES and 4 * n.floats <= MAX_BROADCAST_BYTES:
        q = F.broadcast(q)
    rows = index.select("namespace", "item_id", "seq", "vector", F.size("vector").alias("dim"))
    scored = rows.join(q, F.col("namespace").eqNullSafe(F.col("_ns")) & (F.col("dim") == F.col("_dim"))).select("qid", "item_id", "seq", dot(F.col("vector"), F.col("_q")).alias("raw")).filter("raw IS NOT NULL")
    return ranked(scored, clamp(k), min_similarity)


def _asked(queries: DataFrame) -> dict[tuple, tuple[np.ndarray, np.ndarray]] | None:
    """Query numbers and double vectors by namespace and dimension; None if there are too many to send to all tasks."""
    got = queries.select("qid", "namespace", "vector").limit(MAX_BROADCAST_QUERIES + 1).toArrow().combine_chunks()
    if got.num_rows > MAX_BROADCAST_QUERIES or got.nbytes > MAX_BROADCAST_BYTES:
        return None
    by: dict[tuple, list[int]] = {}
    if not got.num_rows:
        return {}
    b = got.to_batches()[0]
    start, n, val = ragged(column(b, "vector"))
    for i, (ns, d) in enumerate(zip(column(b, "namespace").to_pylist(), n, strict=True)):
        if d:
            by.setdefault((ns, int(d)), []).append(i)
    qid = column(b, "qid").to_numpy()
    return {key: (qid[v], val[start[np.array(v)][:, None] + np.arange(key[1])]) for key, v in by.items()}


def _best(q: np.ndarray, m: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, dot product) of all that can be among the k best of the queries, and reach `least`.

    A single-precision product preselects, by a margin above its error, so that no row tied at the k-th place is lost; each
    pair left is then computed on its own in double precision, so that equal vectors score alike wherever they stand.
    """
    tiles = list(_best_tiles(q, m, k, least))
    return tuple(np.concatenate(x) for x in zip(*tiles, strict=True)) if tiles else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products in double precision, summed from the first component to the last as `dot` and SQL do."""
    total = np.zeros(len(a))
    for x, y in zip(a.T.astype(np.float64), b.T.astype(np.float64), strict=True):
        total += x * y
    return total


def _best_tiles(q: np.ndarray, m: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The parts of _best by ascending queries, so many at a time as TILE allows."""
    with np.errstate(invalid="ignore", over="ignore"):
        # the rounding error of a product is bounded by the lengths of its two vectors
        lengths = [np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)) for x in (q, m)]
    slacks = 1e-6 * q.shape[1] * lengths[0] * np.where(np.isfinite(lengths[1]), lengths[1], 0).max(initial=0)
    slacks = np.where(np.isfinite(slacks), slacks, np.inf)
    step = max(1, TILE // max(len(m), 1))
    for t in range(0, len(q), step):
        part, slack = q[t : t + step], slacks[t : t + step]
        with np.errstate(invalid="ignore", over="ignore"):
            sims = part @ m.T
        odd = ~np.isfinite(sims)
        sims[odd] = np.inf  # decided in double precision
        floor = np.full(len(part), -np.inf)
        if len(m) > k:
            finite = np.where(odd, -np.inf, sims)
            floor = np.partition(finite, -k, axis=1)[:, -k] - slack
        a, c = np.nonzero(sims >= np.maximum(floor, least - slack)[:, None])
        with np.errstate(invalid="ignore", over="ignore"):
            raw = np.concatenate([_dots(part[a[s : s + 16_384]], m[c[s : s + 16_384]]) for s in range(0, len(a), 16_384)] or [np.empty(0)])
        ok = ~np.isnan(raw)
        yield t + a[ok], c[ok], raw[ok]


BLOCKS = "namespace string, dim int, item_ids array<string>, seqs binary, matrix binary"


def matrix_blocks(index: DataFrame, block_rows: int = 8192) -> DataFrame:
    """The index as dense matrices, a row for each namespace, dimension and at most block_rows vectors; persist it to keep
    the matrices resident. Built where the rows lie, without an exchange."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, list] = {}
        waiting = 0

        def close(key: tuple) -> pa.RecordBatch:
            ids, seqs, mats = zip(*open_.pop(key), strict=True)
            ids = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), lists, pa.array([np.concatenate(seqs).tobytes()], pa.binary()), pa.array([np.concatenate(mats).astype("<f4").tobytes()], pa.binary())], ["namespace", "dim", "item_ids", "seqs", "matrix"])

        for b in batches:
            start, n, val = ragged(column(b, "vector"))
            ns = column(b, "namespace").dictionary_encode(null_encoding="encode")
            names, seq = ns.dictionary.to_pylist(), column(b, "seq").to_numpy().astype(np.int64)
            group = ns.indices.to_numpy().astype(np.int64) << 32 | n
            for g in np.unique(group[n > 0]):
                rows = np.flatnonzero(group == g)
                key = (names[g >> 32], int(n[rows[0]]))
                for s in range(0, len(rows), block_rows):
                    r = rows[s : s + block_rows]
                    open_.setdefault(key, []).append((column(b, "item_id").take(pa.array(r)), seq[r], val[start[r][:, None] + np.arange(key[1])]))
                    waiting += len(r)
                    if sum(len(x[1]) for x in open_[key]) >= block_rows:
                        waiting -= sum(len(x[1]) for x in open_[key])
                        yield close(key)
            if waiting > 8 * block_rows:
                # many namespaces in one task: their blocks stay smaller rather than all open
                for key in list(open_):
                    yield close(key)
                waiting = 0
        for key in list(open_):
            yield close(key)

    return index.select("namespace", "item_id", "seq", "vector").mapInArrow(build, BLOCKS)


def search_resident(blocks: DataFrame, queries: DataFrame, k: int | None = None, min_similarity: float = LIMITS.default_similarity) -> DataFrame:
    """(qid, rank, item_id, score) over matrix_blocks: a single-precision product finds what can be among the k best of a block,
    double precision decides. At most MAX_BROADCAST_QUERIES queries."""
    k, asked = clamp(k), _asked(queries)
    if asked is None:
        raise ValueError(f"more than {MAX_BROADCAST_QUERIES} queries at once: use search_batch")
    namespaces = sorted({ns for ns, _ in asked if ns is not None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(column(b, "namespace").to_pylist(), column(b, "dim").to_pylist(), strict=True)
            for i, key in enumerate(keys):
                if key not in asked or not k:
                    continue
                ids, q = asked[key]
                m = np.frombuffer(column(b, "matrix")[i].as_buffer(), "<f4").reshape(-1, key[1])
                seq = np.frombuffer(column(b, "seqs")[i].as_buffer(), np.int64)
                a, c, raw = _best(q, m, k, min_similarity)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), column(b, "item_ids")[i].values.take(pa.array(c)), pa.array(seq[c]), pa.array(raw)], ["qid", "item_id", "seq", "raw"])

    rows = blocks.filter(F.col("namespace").isin(namespaces) | F.col("namespace").isNull()) if len(namespaces) <= 1000 else blocks
    return ranked(rows.mapInArrow(run, "qid long, item_id string, seq long, raw double"), k, min_similarity)


def search_blocks(index: DataFrame, queries: DataFrame, k: int | None = None, min_similarity: float = LIMITS.default_similarity) -> DataFrame:
    """The same result by one matrix product for each block of index rows, namespace and dimension; for many queries.

    Queries are sent to all tasks if there are MAX_BROADCAST_QUERIES at most, else they meet the rows in cells.
    """
    k = clamp(k)
    asked = _asked(queries)
    if asked is None:
        return search_cells(index, queries, k, min_similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, n, val = ragged(column(b, "vector"))
            ns = column(b, "namespace").dictionary_encode(null_encoding="encode")
            names, code, seq = ns.dictionary.to_pylist(), ns.indices.to_numpy(), column(b, "seq").to_numpy()
            group = code.astype(np.int64) << 32 | n
            for g in np.unique(group):
                rows = np.flatnonzero(group == g)
                d = int(n[rows[0]])
                if (key := (names[code[rows[0]]], d)) not in asked:
                    continue
                ids, q = asked[key]
                a, c, raw = _best(q, val[start[rows][:, None] + np.arange(d)], k, min_similarity) if k else (np.empty(0, int),) * 2 + (np.empty(0),)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), column(b, "item_id").take(pa.array(rows[c])), pa.array(seq[rows[c]]), pa.array(raw)], ["qid", "item_id", "seq", "raw"])

    return ranked(index.select("namespace", "item_id", "seq", "vector").mapInArrow(run, "qid long, item_id string, seq long, raw double"), k, min_similarity)


def search_cells(index: DataFrame, queries: DataFrame, k: int | None = None, min_similarity: float = LIMITS.default_similarity) -> DataFrame:
    """The same result for any number of queries: the queries and the rows of a namespace and dimension are cut into slices, and
    each pair of slices, a cell, is one matrix product that keeps k rows a query.

    A cell has a bounded size, so that a large namespace is spread over many tasks; its rows are copied once for each slice
    of its queries and the other way round. Rows that no query can match are left out before anything is moved.
    """
    k = clamp(k)
    group = [F.col("namespace").eqNullSafe(F.col("_ns")), F.col("dim") == F.col("_dim")]
    dim = F.size("vector").alias("dim")
    asked = persist_table(queries.select("qid", "namespace", "vector", dim).filter("dim > 0"), "search-queries")

    def groups(rows: DataFrame, n: str) -> DataFrame:
        return rows.groupBy(F.col("namespace").alias("_ns"), F.col("dim").alias("_dim")).agg(F.count(F.lit(1)).alias(n))

    def small(lookup: DataFrame) -> DataFrame:
        return F.broadcast(lookup) if lookup.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS else lookup

    rows = index.select("namespace", "item_id", "seq", "vector", dim).filter("dim > 0")
    rows = persist_table(rows.join(small(groups(asked, "n_queries")), group, "left_semi"), "search-rows")
    n_queries, n_rows = groups(asked, "n_queries"), groups(rows, "n_rows").withColumnsRenamed({"_ns": "namespace", "_dim": "dim"})

    def slices(n: str, most: int) -> Column:
        return F.ceil(F.col(n) / F.greatest(F.least(F.lit(most), F.floor(F.lit(CELL_BYTES) / (F.col("_dim") * 4))), F.lit(1))).cast("int")

    layout = n_queries.join(n_rows, group).select("_ns", "_dim", slices("n_queries", CELL_QUERIES).alias("_q"), slices("n_rows", CELL_ROWS).alias("_r"))
    layout = small(persist_table(layout, "search-layout"))
    cell = ["namespace", "dim", "q_slice", "r_slice"]

    def spread(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine, theirs = ("q_slice", "r_slice") if own == "_q" else ("r_slice", "q_slice")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs)
        return df.join(layout, group).select(*df.columns, F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(mine), each)

    def matrix(t: pa.Table, d: int) -> np.ndarray:
        parts = []
        for b in t.to_batches():
            start, _, val = ragged(column(b, "vector"))
            parts.append(val[start[:, None] + np.arange(d)])
        return np.concatenate(parts) if parts else np.empty((0, d), np.float32)

    def compare(key: tuple, q: pa.Table, r: pa.Table) -> pa.Table:
        found = []
        if q.num_rows and r.num_rows and k:
            d = key[1].as_py()
            seq = r["seq"].to_numpy()
            for a, c, raw in _best_tiles(matrix(q, d), matrix(r, d), k, min_similarity):
                # rows tied at the k-th place are cut by position here, however many copies of a vector there are
                order = np.lexsort((seq[c], -raw, a))
                a, c, raw = a[order], c[order], raw[order]
                start = np.flatnonzero(np.append(True, np.diff(a) != 0)) if len(a) else np.empty(0, int)
                keep = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < k
                found.append((a[keep], c[keep], raw[keep]))
        a, c, raw = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table({"qid": q["qid"].take(pa.array(a)), "item_id": r["item_id"].take(pa.array(c)), "seq": r["seq"].take(pa.array(c)), "raw": pa.array(raw)})

    met = spread(asked, "qid", "_q", "_r").groupBy(*cell).cogroup(spread(rows, "seq", "_r", "_q").groupBy(*cell))
    return ranked(met.applyInArrow(compare, "qid long, item_id string, seq long, raw double"), k, min_similarity)
