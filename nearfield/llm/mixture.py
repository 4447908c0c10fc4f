"""Clusters of similar vectors by a Gaussian mixture.

Unit vectors are standardised and reduced to the principal axes that carry more than one axis' share of the variance;
a mixture of Gaussians with regularised diagonal covariance is fitted by expectation-maximisation. A bounded sample
gives the starting points and, by the Bayesian information criterion, their number; the parameters then come from EM
steps over all rows. Rows that only the background component explains are sampled again in further rounds, so that
groups too small for the first sample get components of their own. The members of highest density represent a
component, and an exact check against them, by cosine, decides membership. Rows that reach none are compared with all
others exactly, and the components' centres exclude most of these pairs by their angles: a good fit makes this
cheap, a bad one slow, and neither changes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.arrays import bytes_rows, column, cosines, row_bytes, unit, usable_by_dim
from nearfield.llm.components import components, star_links
from nearfield.llm.probes import Probes
from nearfield.operators.live import live_rows
from nearfield.session import persist_table, persist_tables

VECTORS = "namespace string, item_id string, seq long, raw binary"


@dataclass
class Mixture:
    """Component 0 is the background. basis maps a unit vector to standardised, reduced features."""

    shift: np.ndarray
    basis: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    bic: float = float("nan")
    loglik: float = float("nan")

    def features(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.shift) @ self.basis).astype(np.float64)

    def log_density(self, z: np.ndarray) -> np.ndarray:
        """log(weight * density) of each row and component."""
        inv = 1 / self.var
        const = (self.mean**2 * inv + np.log(self.var)).sum(1) + z.shape[1] * np.log(2 * np.pi)
        return np.log(self.weight) - 0.5 * (z**2 @ inv.T - 2 * z @ (self.mean * inv).T + const)

    def moments(self, z: np.ndarray) -> np.ndarray:
        """For each component: sum of responsibilities, of r z, of r z**2, and its part of the log likelihood."""
        ld = self.log_density(z)
        top = ld.max(1, keepdims=True)
        r = np.exp(ld - top)
        s = r.sum(1, keepdims=True)
        r /= s
        return np.concatenate([r.sum(0)[:, None], r.T @ z, r.T @ z**2, (r * (top + np.log(s))).sum(0)[:, None]], 1)

    def maximised(self, mom: np.ndarray, shrink: float, floor: float, least: float) -> Mixture:
        """The M step; covariances are shrunk towards the pooled one, components of less than `least` rows go."""
        q, n = self.mean.shape[1], mom[:, 0].sum()
        keep = mom[:, 0] >= least
        keep[0] = True
        mom = mom[keep]
        nk = np.maximum(mom[:, :1], 1e-9)
        mean = mom[:, 1 : 1 + q] / nk
        var = np.maximum(mom[:, 1 + q : 1 + 2 * q] / nk - mean**2, 0)
        if len(mom) > 1:
            pooled = (var[1:] * nk[1:]).sum(0) / nk[1:].sum()
            var[1:] = (1 - shrink) * var[1:] + shrink * pooled
        var += floor
        loglik, k = float(mom[:, -1].sum()), len(mom)
        return Mixture(self.shift, self.basis, nk[:, 0] / nk.sum(), mean, var, -2 * loglik + k * (2 * q + 1) * np.log(max(n, 2)), loglik)

    def with_seeds(self, z: np.ndarray, var: np.ndarray, share: float) -> Mixture:
        """Further components at z, taking `share` of the background's weight."""
        w = np.concatenate([self.weight, np.full(len(z), self.weight[0] * share / max(len(z), 1))])
        w[0] *= 1 - share
        return Mixture(self.shift, self.basis, w / w.sum(), np.concatenate([self.mean, z]), np.concatenate([self.var, np.tile(var, (len(z), 1))]))


def sum_by(df: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the double vectors (k long, vals binary) for each k; their number and width don't depend on the rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(v)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "vals"])

    return {r.k: np.frombuffer(r.vals) for r in df.repartition("k").mapInArrow(add, "k long, vals binary").collect()}


def _partials(vectors: DataFrame, width: int, f: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """f maps a block of unit vectors to a fixed number of rows; their sums over all blocks, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = f(unit(bytes_rows(column(b.slice(s, 4096), "raw"), width)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([v.astype(np.float64).tobytes() for v in total], pa.binary())], ["k", "vals"])

    return sum_by(vectors.select("raw").mapInArrow(run, "k long, vals binary"))


def _sample(vectors: DataFrame, n_rows: int, size: int, width: int, salt: int) -> np.ndarray:
    picked = vectors.filter(F.pmod(F.xxhash64("seq", F.lit(salt)), F.lit(max(n_rows, 1))) < size).select("raw").limit(2 * size).toArrow()
    raw = picked["raw"].combine_chunks()
    raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) and raw.num_chunks else raw
    return unit(bytes_rows(raw, width)) if len(raw) else np.empty((0, width), np.float32)


def density_seeds(x: np.ndarray, link: float, least: int) -> np.ndarray:
    """Rows by falling number of neighbours, each with its neighbourhood removed from the rest."""
    degree = np.concatenate([(x[s : s + 512] @ x.T >= link).sum(1) - 1 for s in range(0, len(x), 512)]) if len(x) else np.empty(0, int)
    free, seeds = degree >= least, []
    while free.any():
        i = int(np.argmax(np.where(free, degree, -1)))
        seeds.append(i)
        free &= x @ x[i] < link
    return np.array(seeds, int)


def fit_mixture(vectors: DataFrame, width: int, n_rows: int, link: float, min_size: int, sample: int = 16_384, rounds: int = 3, passes: int = 2, shrink: float = 0.2, floor: float = 1e-3, max_axes: int = 64) -> Mixture:
    """vectors: raw (float32 rows of `width`), seq. `sample` bounds the rows that starting points come from, a round."""
    mom = _partials(vectors, width, lambda x: (lambda e: e.T @ e)(np.concatenate([np.ones((len(x), 1)), x.astype(np.float64)], 1)))
    mom = np.stack([mom[i] for i in range(width + 1)])
    mu = mom[0, 1:] / n_rows
    cov = mom[1:, 1:] / n_rows - np.outer(mu, mu)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    val, vec = np.linalg.eigh(cov / np.outer(sd, sd))
    axes = np.argsort(-val)[: int(np.clip((val > val.mean()).sum(), min(2, width), max_axes))]
    base = Mixture(mu, vec[:, axes] / sd[:, None], np.ones(1), np.zeros((1, len(axes))), np.maximum(val[axes], floor)[None])

    def em(model: Mixture, z: np.ndarray, steps: int) -> Mixture:
        for _ in range(steps):
            model = model.maximised(sum(model.moments(z[s : s + 4096]) for s in range(0, len(z), 4096)), shrink, floor, 2)
        return model

    model = base
    for at in range(rounds):
        if at:
            rest, n_rest = vectors.mapInArrow(_background(model, width), VECTORS), int(model.weight[0] * n_rows)
            if n_rest < min_size:
                break
        else:
            rest, n_rest = vectors, n_rows
        x = _sample(rest, n_rest, sample, width, at)
        seeds = density_seeds(x, link, 3)
        if not len(seeds):
            break
        z = base.features(x)
        spread = np.mean([z[x @ x[s] >= link].var(0) for s in seeds[:64]], 0) + floor
        if at == 0:
            tried = {}
            for k in sorted({k for k in (1, 2, 4, 8, 16, 24, 32, 48, 64, 96, 128, 192, 256) if k < len(seeds)} | {len(seeds)}):
                tried[k] = em(base.with_seeds(z[seeds[:k]], spread, 0.9), z, 12)
                if len(tried) > 2 and sorted(m.bic for m in tried.values()).index(tried[k].bic) >= 2:
                    break  # two numbers of components in a row no longer gain
            model = min(tried.values(), key=lambda m: m.bic)
        else:
            model = model.with_seeds(z[seeds], spread, 0.5)
        for _ in range(passes):
            got = _partials(vectors, width, lambda x, m=model: m.moments(m.features(x)))
            model = model.maximised(np.stack([got[i] for i in range(len(model.weight))]), shrink, floor, min_size / 2)
    return model


def _background(model: Mixture, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = model.log_density(model.features(unit(bytes_rows(column(b, "raw"), width)))).argmax(1)
            yield b.filter(pa.array(best == 0))

    return run


def _typical(vectors: DataFrame, model: Mixture, width: int, each: int) -> list:
    """The `each` members of highest density of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            ld = model.log_density(model.features(unit(bytes_rows(column(b, "raw"), width))))
            k = ld.argmax(1)
            t = pa.Table.from_batches([b]).append_column("k", pa.array(k.astype(np.int32))).append_column("density", pa.array(ld[np.arange(len(k)), k])).filter(pa.array(k > 0))
            t = t if kept is None else pa.concat_tables([kept, t])
            k, density = t["k"].to_numpy(), t["density"].to_numpy()
            order = np.lexsort((t["seq"].to_numpy(), -density, k))
            start = np.flatnonzero(np.append(True, np.diff(k[order]) != 0)) if len(k) else np.array([], int)
            rank = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
            kept = t.take(pa.array(order[rank < each]))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    top = vectors.mapInArrow(run, VECTORS + ", k int, density double")
    w = Window.partitionBy("k").orderBy(F.desc("density"), "seq")
    return top.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= each).collect()


def _union(n: int, pairs: set[tuple[int, int]]) -> np.ndarray:
    root = np.arange(n)
    for a, b in sorted(pairs):
        ra, rb = root[a], root[b]
        root[root == max(ra, rb)] = min(ra, rb)
    return root


def _central(rows: DataFrame, width: int, each: int) -> DataFrame:
    """typical rows of clusters, by cosine to the sum of the cluster's unit vectors; density is null."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, at = np.unique(column(b, "cluster_seq").to_numpy(), return_inverse=True)
            total = np.zeros((len(c), width))
            np.add.at(total, at, unit(bytes_rows(column(b, "raw"), width)))
            yield pa.RecordBatch.from_arrays([pa.array(c), row_bytes(total)], ["cluster_seq", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<f4").astype(np.float64) for x in t["part"])
        return pa.table({"cluster_seq": t["cluster_seq"][:1], "centre": row_bytes(total[None])})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = cosines(bytes_rows(column(b, "raw"), width), bytes_rows(column(b, "centre"), width))
            yield pa.RecordBatch.from_arrays([*(column(b, n) for n in ("cluster_seq", "namespace", "item_id", "seq")), pa.array(c)], ["cluster_seq", "namespace", "item_id", "seq", "c"])

    centre = rows.select("cluster_seq", "raw").mapInArrow(sums, "cluster_seq long, part binary").groupBy("cluster_seq").applyInArrow(add, "cluster_seq long, centre binary")
    found = rows.join(centre, "cluster_seq").mapInArrow(near, "cluster_seq long, namespace string, item_id string, seq long, c double")
    place = F.row_number().over(Window.partitionBy("cluster_seq").orderBy(F.desc("c"), "seq"))
    return found.withColumn("place", place).filter(F.col("place") <= each).select("cluster_seq", "place", "namespace", "item_id", F.lit(None).cast("double").alias("density"))


def similarity_clusters(log: DataFrame, link: float = 0.5, min_size: int = 8, width: int = 128, hubs: int = 24, chunk: int = 49_152, loose: float = 0.65, sample: int = 16_384) -> tuple[DataFrame, DataFrame, Mixture | None]:
    """(members, typical, mixture) of the live usable rows of `width` dimensions.

    members: namespace, item_id, seq, cluster_seq for each row of a cluster of at least min_size rows; cluster_seq is the
    smallest seq of the cluster. typical: cluster_seq, place, namespace, item_id, density - the representatives.

    Membership: representatives with a cosine of at least `link` form groups; a row belongs to the groups that it has such
    a cosine to a representative of, and groups that share a member are one cluster, so that every cluster is a chain of
    links. A row that reaches no representative, or only by a cosine below `loose`, is compared exactly with all rows,
    `chunk` such rows at a time, and clusters are the components of all links: only a link between members of different
    groups that both are nearer than that to a representative of their own isn't looked for. Also topics that no
    sample showed come out, whatever the length of their chains. This work grows with the rows left over times all rows;
    the mixture's centres exclude most of it. Null, empty, non-finite and zero vectors and other dimensions take no part; repeated rows count once.
    """
    spark = log.sparkSession

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, m in usable_by_dim(column(b, "vector")):
                if d == width:
                    yield pa.RecordBatch.from_arrays([*(column(b, c).take(pa.array(at)) for c in ("namespace", "item_id", "seq")), row_bytes(m)], ["namespace", "item_id", "seq", "raw"])

    vectors = persist_table(live_rows(log.select("namespace", "item_id", "seq", "vector")).mapInArrow(prepare, VECTORS), "mixture-vectors")
    nothing = spark.createDataFrame([], "namespace string, item_id string, seq long, cluster_seq long"), spark.createDataFrame([], "cluster_seq long, place int, namespace string, item_id string, density double"), None
    n_rows = vectors.count()
    if not n_rows:
        return nothing
    model = fit_mixture(vectors, width, n_rows, link, min_size, sample)
    top = _typical(vectors, model, width, hubs)
    ref = unit(np.frombuffer(b"".join(bytes(r.raw) for r in top), "<f4").reshape(-1, width))
    # representatives linked to each other are one group; a diffuse component may fall into several
    a, b = np.nonzero(ref @ ref.T >= link)
    of = _union(len(ref), set(zip(a.tolist(), b.tolist(), strict=True)))
    group_of = of.copy()
    order = np.argsort(of, kind="stable")
    ref, of = ref[order], of[order]
    starts = np.flatnonzero(np.append(True, np.diff(of) != 0)) if len(of) else np.empty(0, int)
    comps = of[starts]

    def lists(row: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
        """Values grouped by ascending row number as a list column of n rows."""
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.int32)))

    # a group's node in the graph of links is the row of its first representative
    node_of = np.full(int(comps.max(initial=-1)) + 1, -1)
    node_of[group_of[::-1]] = [r.seq for r in top[::-1]]

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                x = unit(bytes_rows(column(part, "raw"), width))
                # without any representative a column that no row reaches
                best = np.maximum.reduceat(x @ ref.T, starts, axis=1) if len(ref) else np.full((len(x), 1), -2, np.float32)
                first = best.argmax(1)
                high = best[np.arange(len(best)), first]
                others = best >= link
                others[np.arange(len(best)), first] = False
                row, other = np.nonzero(others & (high >= link)[:, None])
                bridges = lists(row, comps[other], len(best))
                comp = np.where(high >= link, comps[first], -1) if len(ref) else np.full(len(x), -1)
                node = np.where(comp >= 0, node_of[comp], column(part, "seq").to_numpy()) if len(ref) else column(part, "seq").to_numpy()
                settled = (comp >= 0) & (high >= loose)
                yield pa.RecordBatch.from_arrays(
                    [*(column(part, c) for c in ("namespace", "item_id", "seq")), pa.array(comp.astype(np.int32)), bridges, pa.array(node), column(part, "raw").take(pa.array(np.arange(len(comp)), mask=settled))],
                    ["namespace", "item_id", "seq", "comp", "bridge", "node", "raw"],
                )

    attached = persist_table(vectors.mapInArrow(attach, "namespace string, item_id string, seq long, comp int, bridge array<int>, node long, raw binary"), "mixture-attached")
    # pairs of groups: their number doesn't grow with the rows
    pairs = {(r.comp, r.other) for r in attached.filter("size(bridge) > 0").select("comp", F.explode("bridge").alias("other")).distinct().collect()}

    left = attached.filter("comp < 0").select("namespace", "item_id", "seq", "raw")
    asked = attached.filter("raw is not null").select("seq", "node", "raw")
    n_asked = asked.count()
    centres = unit(np.stack([ref[s:e].mean(0) for s, e in zip(starts, np.append(starts[1:], len(ref)), strict=True)])) if len(ref) else ref

    def links_to(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def compare(x: np.ndarray, seq: np.ndarray, probes: Probes, seqs: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = []
            for i, j in probes.hits(x):
                node = seq[i]
                if len(ref):
                    # a row that reaches representatives stands for their group
                    u, at = np.unique(i, return_inverse=True)
                    for s in range(0, len(u), 4096):
                        best = np.maximum.reduceat(x[u[s : s + 4096]] @ ref.T, starts, axis=1)
                        of_u = np.where(best.max(1) >= link, node_of[comps[best.argmax(1)]], seq[u[s : s + 4096]])
                        mine = (at >= s) & (at < s + 4096)
                        node[mine] = of_u[at[mine] - s]
                found.append(star_links(node, seqs[j]))
            if found:
                u, v = star_links(*(np.concatenate(e) for e in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw, at = sent.value
            probes, seqs = Probes(unit(np.frombuffer(raw, "<f4").reshape(-1, width)), link, centres), np.frombuffer(at, np.int64)
            # many rows at a time, so that each centre has enough of them
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            for b in batches:
                waiting.append((unit(bytes_rows(column(b, "raw"), width)), column(b, "seq").to_numpy()))
                if sum(len(w[1]) for w in waiting) >= 65_536:
                    yield from compare(*(np.concatenate(c) for c in zip(*waiting, strict=True)), probes, seqs)
                    waiting.clear()
            if waiting:
                yield from compare(*(np.concatenate(c) for c in zip(*waiting, strict=True)), probes, seqs)

        return run

    # every row that reaches no representative, or barely one, against all rows; so many at a time as the driver and each task hold
    parts = -(-n_asked // chunk)

    def link_parts() -> Iterator[DataFrame]:
        yield spark.createDataFrame([(int(node_of[x]), int(node_of[y])) for x, y in pairs], "a long, b long")
        for k in range(parts):
            t = asked.filter(F.pmod(F.xxhash64("seq"), F.lit(parts)) == k).select("node", "raw").toArrow()
            if t.num_rows:
                sent = spark.sparkContext.broadcast((b"".join(x.as_buffer().to_pybytes() for x in t["raw"]), t["node"].to_numpy().tobytes()))
                yield vectors.mapInArrow(links_to(sent), "a long, b long")
                sent.destroy()

    links = persist_tables(link_parts(), "mixture-links")
    root = persist_table(components(links), "mixture-roots")
    of_node = {r.node: r.component for r in root.join(F.broadcast(spark.createDataFrame([(int(node_of[g]),) for g in comps], "node long")), "node", "left_semi").collect()}
    of_group = spark.createDataFrame([(int(g), of_node.get(int(node_of[g]), int(node_of[g]))) for g in comps], "comp int, cluster long")
    labelled = attached.filter("comp >= 0").select("namespace", "item_id", "seq", "comp").join(F.broadcast(of_group), "comp").drop("comp")
    labelled = labelled.unionByName(left.drop("raw").join(root.withColumnsRenamed({"node": "seq", "component": "cluster"}), "seq").select("namespace", "item_id", "seq", "cluster"))
    ids = persist_table(labelled.groupBy("cluster").agg(F.countDistinct("seq").alias("n"), F.min("seq").alias("cluster_seq")).filter(F.col("n") >= min_size).drop("n"), "mixture-ids")
    members = labelled.join(ids, "cluster").select("namespace", "item_id", "seq", "cluster_seq").dropDuplicates(["seq"])
    root_of = {int(g): of_node.get(int(node_of[g]), int(node_of[g])) for g in comps}
    seq_of = {r.cluster: r.cluster_seq for r in ids.join(F.broadcast(of_group.select("cluster").distinct()), "cluster", "left_semi").collect()}
    best: dict[int, list] = {}
    for r, g in sorted(zip(top, group_of, strict=True), key=lambda x: (-x[0].density, x[0].seq)):
        c = seq_of.get(root_of[int(g)])
        if c is not None:
            best.setdefault(c, []).append((c, len(best.get(c, [])) + 1, r.namespace, r.item_id, float(r.density)))
    typical = spark.createDataFrame([x for v in best.values() for x in v], "cluster_seq long, place int, namespace string, item_id string, density double")
    # clusters without a representative: their members nearest to the sum of their unit vectors
    alone = left.join(members.select("seq", "cluster_seq"), "seq").join(F.broadcast(typical.select("cluster_seq").distinct()), "cluster_seq", "left_anti")
    return members, typical.unionByName(_central(alone, width, hubs)), model
