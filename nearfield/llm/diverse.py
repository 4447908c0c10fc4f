"""Choosing a varied subset: greedy maximisation of a kernel determinant.

The kernel of two items is a mix of their vectors' similarity, exp(sharpness * (cosine - 1)), and of sharing a namespace,
scaled by both items' quality, which is lower for vectors that have nothing near them in the collection. The determinant
grows by the part of an item that the chosen ones don't explain: near copies add nothing, further members of a large topic
or namespace little. Chunks are reduced to core-sets of the wanted size where they are read, these meet in rounds of
bounded fan-in, and the last pass chooses from their union.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.arrays import bytes_rows, column, row_bytes, unit, usable_by_dim
from nearfield.llm.mixture import density_seeds, sum_by
from nearfield.llm.probes import Probes
from nearfield.operators.live import live_rows
from nearfield.session import persist_table, persist_tables

VECTORS = "namespace string, item_id string, seq long, dim int, raw binary"
#: Rows with a cosine of NEAR are neighbours; an item with ENOUGH of them isn't lonely.
NEAR, ENOUGH = 0.5, 3
ROWS = "namespace string, item_id string, seq long, dim int, raw binary, quality float, gain double, place int, node long"


def greedy_determinant(kernel_row, diag: np.ndarray, size: int, least: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(rows chosen, gains): up to `size` rows, each with the largest growth of the determinant; kernel_row(i) gives row i of the kernel.

    Keeps a Cholesky factor of the chosen rows against all rows and extends it by one column a step. Stops when no
    row adds more than `least`; ties go to the first row.
    """
    n = len(diag)
    gain, factor = diag.astype(np.float64).copy(), np.zeros((min(size, n), n), np.float32)
    chosen, gains = [], []
    for step in range(min(size, n)):
        i = int(np.argmax(gain))
        if gain[i] <= least:
            break
        chosen.append(i)
        gains.append(gain[i])
        col = (kernel_row(i) - factor[:step, i] @ factor[:step]) / math.sqrt(gain[i])
        factor[step] = col
        gain -= col.astype(np.float64) ** 2
        gain[i] = -1
    return np.array(chosen, int), np.array(gains)


def _choose(t: pa.Table, size: int, sharpness: Callable[[int], float], same_namespace: float) -> pa.Table:
    """The core-set of a table of ROWS, in the order of choice; rows repeated in seq count once."""
    t = t.take(pa.array(np.unique(t["seq"].to_numpy(), return_index=True)[1])).combine_chunks()
    dim, q = t["dim"].to_numpy(), t["quality"].to_numpy()
    ns = t["namespace"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    raw = t["raw"].combine_chunks()
    mats = {int(d): (np.flatnonzero(dim == d), unit(bytes_rows(raw.take(pa.array(np.flatnonzero(dim == d))), int(d)))) for d in np.unique(dim)}
    where = np.zeros(len(dim), int)
    for at, _ in mats.values():
        where[at] = np.arange(len(at))

    def kernel_row(i: int) -> np.ndarray:
        at, x = mats[int(dim[i])]
        k = np.where(ns == ns[i], np.float32(same_namespace), np.float32(0))
        k[at] += (1 - same_namespace) * np.exp(sharpness(int(dim[i])) * (x @ x[where[i]] - 1))
        return k * q * q[i]

    rows, gains = greedy_determinant(kernel_row, q.astype(np.float64) ** 2, size)
    t = t.take(pa.array(rows))
    return t.set_column(t.schema.get_field_index("gain"), "gain", pa.array(gains)).set_column(t.schema.get_field_index("place"), "place", pa.array(np.arange(1, len(rows) + 1, dtype=np.int32)))


def _sharpness(vectors: DataFrame) -> dict[int, float]:
    """For each dimension the sharpness at which a pair of mean cosine has a kernel of exp(-4), from sums over all rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            weight = column(b, "weight").to_numpy().astype(np.float64)
            for d, rows, x in _by_dim(b):
                w = weight[rows]
                total[d] = total.get(d, 0) + np.append(w @ unit(x).astype(np.float64), w.sum())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "vals"])

    # what a redelivered row adds beyond once is taken off again
    repeated = persist_table(vectors.groupBy("seq").agg((1 - F.count(F.lit(1))).alias("weight")).filter("weight < 0"), "varied-repeated")
    once = vectors.select("seq", "dim", "raw")
    weighed = once.withColumn("weight", F.lit(1).cast("long")).unionByName(once.join(repeated, "seq").dropDuplicates(["seq"]))
    sharp = {}
    for d, v in sum_by(weighed.mapInArrow(sums, "k long, vals binary")).items():
        n = v[-1]
        sharp[d] = float(4 / max(1 - (v[:-1] @ v[:-1] - n) / (n * (n - 1)), 0.05)) if n >= 20 else 4.0
    return sharp


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, row numbers, float32 matrix) for each dimension of a batch with dim and raw."""
    dim = column(b, "dim").to_numpy()
    for d in np.unique(dim).tolist():
        rows = np.flatnonzero(dim == d)
        yield d, rows, bytes_rows(column(b, "raw").take(pa.array(rows)), d)


class _Asked:
    """Rows whose neighbours are looked for until each has ENOUGH; a neighbour counts once however often it is delivered."""

    def __init__(self, seq: np.ndarray, x: np.ndarray, centres: np.ndarray | None):
        self.seq, self.x, self.centres = seq, x, centres
        self.near, self.found = np.zeros(len(seq), int), (np.empty(0, int), np.empty(0, np.int64))
        self._reopen()

    def _reopen(self) -> None:
        self.open = np.flatnonzero(self.near < ENOUGH)
        self.probes = Probes(self.x[self.open], NEAR, self.centres)

    def _fold(self, new: list[tuple[np.ndarray, np.ndarray]]) -> None:
        j, s = (np.concatenate(e) for e in zip(self.found, *new, strict=True))
        order = np.lexsort((s, j))
        j, s = j[order], s[order]
        once = np.append(True, (j[1:] != j[:-1]) | (s[1:] != s[:-1]))[: len(j)]
        j, s = j[once], s[once]
        kept = np.arange(len(j)) - np.searchsorted(j, j) < ENOUGH
        self.found = j[kept], s[kept]
        self.near = np.bincount(self.found[0], minlength=len(self.seq))

    def meet(self, seq: np.ndarray, x: np.ndarray) -> None:
        new: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in self.probes.hits(x):
            j = self.open[j]
            other = (seq[i] != self.seq[j]) & (self.near[j] < ENOUGH)
            new.append((j[other], seq[i[other]]))
            if sum(len(e[0]) for e in new) > 1 << 20:
                self._fold(new)
                new.clear()
        if new:
            self._fold(new)
            if 2 * (self.near[self.open] >= ENOUGH).sum() > len(self.open):
                self._reopen()


def _neighbour_counts(asked: DataFrame, vectors: DataFrame, centres: dict[int, np.ndarray], chunk: int) -> DataFrame:
    """(seq, near) of the rows asked that have neighbours among all vectors: their number, ENOUGH at most."""

    def compare(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_rows = {d: _Asked(np.frombuffer(at, np.int64), unit(np.frombuffer(raw, "<f4").reshape(-1, d)), centres.get(d)) for d, (at, raw) in sent.value.items()}
            # many rows at a time, so that each centre has enough of them
            waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {d: [] for d in open_rows}

            def meet() -> None:
                for d, w in waiting.items():
                    if w:
                        open_rows[d].meet(*(np.concatenate(c) for c in zip(*w, strict=True)))
                        w.clear()

            for b in batches:
                seq = column(b, "seq").to_numpy()
                for d, rows, x in _by_dim(b):
                    if d in open_rows:
                        waiting[d].append((seq[rows], unit(x)))
                if sum(len(seqs) for w in waiting.values() for seqs, _ in w) >= 65_536:
                    meet()
            meet()
            for a in open_rows.values():
                yield pa.RecordBatch.from_arrays([pa.array(a.seq[a.found[0]]), pa.array(a.found[1])], ["seq", "other"])

        return run

    parts = max(1, -(-asked.count() // chunk))

    def found() -> Iterator[DataFrame]:
        for k in range(parts):
            t = asked.select("seq", "dim", "raw").filter(F.pmod(F.xxhash64("seq"), F.lit(parts)) == k).toArrow()
            by_dim = {d: t.filter(pc.equal(t["dim"], d)) for d in pc.unique(t["dim"]).to_pylist()}
            sent = asked.sparkSession.sparkContext.broadcast({d: (x["seq"].to_numpy().tobytes(), b"".join(v.as_buffer().to_pybytes() for v in x["raw"])) for d, x in by_dim.items()})
            yield vectors.select("seq", "dim", "raw").mapInArrow(compare(sent), "seq long, other long")
            sent.destroy()

    return persist_tables(found(), "varied-near").distinct().groupBy("seq").agg(F.least(F.count(F.lit(1)), F.lit(ENOUGH)).alias("near"))


def varied_subset(log: DataFrame, size: int, sharpness: float | None = None, same_namespace: float = 0.3, lonely: float = 0.7, chunk: int = 4096, fan_in: int = 8, sample: int = 4096, probes: int = 49_152) -> DataFrame:
    """(place, namespace, item_id, seq, gain): `size` live usable items in the order of choice, all dimensions together.

    gain is the factor by which the item enlarges the determinant. Fewer than `size` come out if what is left are exact
    copies of chosen items or there are too few rows. Null, empty, non-finite and zero vectors and rows without seq take no part; null
    namespaces count as one namespace; a row delivered several times counts once. An item with three or more neighbours at a
    cosine of 0.5 among all rows has quality 1, one with none `lonely`; it excludes nothing. `sample` bounds the reference
    rows, which only decide what is compared: an item near three of them has three neighbours, and all other items are
    compared with all rows. This work grows with the items that few references explain times all rows, `probes` of
    them at a time. Vectors of different dimensions aren't comparable; sharpness is by default 4 / (1 - the mean cosine of all
    pairs of a dimension), so that no dimension counts as more varied for its wider spread (4 below 20 rows).

    A task holds a factor of `size` times about three times the larger of `size` and `chunk` floats: 12 MB for 256 items,
    1.2 GB for 10,000. A size above 16,384 is refused.
    """
    if size > 16_384:
        raise ValueError("at most 16,384 items: a task couldn't hold the factor of more")
    log = log.filter("seq IS NOT NULL")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, m in usable_by_dim(column(b, "vector")):
                yield pa.RecordBatch.from_arrays([*(column(b, c).take(pa.array(at)) for c in ("namespace", "item_id", "seq")), pa.array(np.full(len(at), d, np.int32)), row_bytes(m)], ["namespace", "item_id", "seq", "dim", "raw"])

    vectors = persist_table(live_rows(log.select("namespace", "item_id", "seq", "vector")).mapInArrow(prepare, VECTORS), "varied-vectors")
    n = vectors.count()
    ref = vectors.filter(F.pmod(F.xxhash64("seq", F.lit(3)), F.lit(max(n, 1))) < sample).select("seq", "dim", "raw").limit(2 * sample).toArrow().combine_chunks()
    refs, ref_seq, centres = {}, {}, {}
    for d, at, m in _by_dim(ref.to_batches()[0]) if ref.num_rows else []:
        ref_seq[d], first = np.unique(ref["seq"].to_numpy()[at], return_index=True)
        refs[d] = unit(m[first])
        seeds = density_seeds(refs[d], NEAR, ENOUGH)
        if len(seeds):
            centres[d] = unit(np.stack([refs[d][refs[d] @ refs[d][i] >= NEAR].mean(0) for i in seeds]))
    by_dim = {} if sharpness else _sharpness(vectors)

    def sharp(d: int) -> float:
        return sharpness or by_dim[d]

    rounds = max(1, math.ceil(math.log(max(n / chunk, 2)) / math.log(fan_in)))

    def core_sets(batches: Iterator[pa.RecordBatch], prepare: Callable[[pa.RecordBatch], Iterator[tuple[pa.Table, pa.Table | None]]]) -> Iterator[pa.RecordBatch]:
        kept, waiting = None, []

        def reduce(kept: pa.Table | None) -> pa.Table:
            return _choose(pa.concat_tables([*([kept] if kept is not None else []), *waiting]), size, sharp, same_namespace)

        for b in batches:
            for t, aside in prepare(b):
                if aside is not None and aside.num_rows:
                    yield from aside.combine_chunks().to_batches()
                waiting.append(t)
                if sum(t.num_rows for t in waiting) >= chunk:
                    kept = reduce(kept)
                    waiting.clear()
        if sum(t.num_rows for t in waiting):
            kept = reduce(kept)
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    def node() -> int:
        return TaskContext.get().partitionId() % fan_in**rounds

    def read(b: pa.RecordBatch) -> Iterator[tuple[pa.Table, pa.Table]]:
        """Settled rows, and aside those that few references are near to."""
        for d, at, m in _by_dim(b):
            for s in range(0, len(at), chunk):
                a, x = at[s : s + chunk], m[s : s + chunk]
                seq, u, near = column(b, "seq").to_numpy()[a], unit(x), np.zeros(len(a), np.int64)
                for r in range(0, len(refs.get(d, ())), 512):
                    close = u @ refs[d][r : r + 512].T >= NEAR
                    near += close.sum(1)
                if d in refs:
                    near -= np.isin(seq, ref_seq[d])
                t = pa.table({**{c: column(b, c).take(pa.array(a)) for c in ("namespace", "item_id", "seq")}, "dim": np.full(len(a), d, np.int32), "raw": row_bytes(x), "quality": np.ones(len(a), np.float32), "gain": np.zeros(len(a)), "place": np.where(near < ENOUGH, -1, 0).astype(np.int32), "node": np.full(len(a), node())})
                yield t.filter(pa.array(near >= ENOUGH)), t.filter(pa.array(near < ENOUGH))

    def settle(b: pa.RecordBatch) -> Iterator[tuple[pa.Table, None]]:
        """Rows with all their neighbours counted."""
        near = column(b, "near").to_numpy()
        t = pa.Table.from_batches([b]).drop_columns(["near"])
        new = {"quality": pa.array((lonely + (1 - lonely) * near / ENOUGH).astype(np.float32)), "gain": pa.array(np.zeros(len(near))), "place": pa.array(np.zeros(len(near), np.int32)), "node": pa.array(np.full(len(near), node()))}
        for c, v in new.items():
            t = t.set_column(t.schema.get_field_index(c), c, v)
        for s in range(0, t.num_rows, chunk):
            yield t.slice(s, chunk), None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, pa.Table] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            of = t["node"].to_numpy()
            for x in np.unique(of):
                part = t.filter(pa.array(of == x))
                nodes[x] = part if x not in nodes else pa.concat_tables([nodes[x], part])
                if nodes[x].num_rows > 2 * max(size, chunk):
                    nodes[x] = _choose(nodes[x], size, sharp, same_namespace)
        for t in nodes.values():
            yield from _choose(t, size, sharp, same_namespace).combine_chunks().to_batches()

    first = persist_table(vectors.mapInArrow(lambda batches: core_sets(batches, read), ROWS), "varied-first")
    asked = persist_table(first.filter("place = -1").dropDuplicates(["seq"]), "varied-open")
    near = _neighbour_counts(asked, vectors, centres, probes)
    asked = asked.join(near, "seq", "left").withColumn("near", F.coalesce("near", F.lit(0)).cast("long"))
    loose = asked.select(*first.columns, "near").mapInArrow(lambda batches: core_sets(batches, settle), ROWS)
    rows = first.filter("place <> -1").unionByName(loose)
    for _ in range(rounds):
        rows = rows.withColumn("node", F.floor(F.col("node") / fan_in)).repartition("node").mapInArrow(meet, ROWS)
    return rows.select("place", "namespace", "item_id", "seq", "gain")
