"""Most similar vectors for every vector.

Stable random projections (standard normal, so a squared projected distance is the squared distance times a chi-square
variable with m degrees of freedom) are indexed by a kd-tree. A query takes the tree's leaves in the order of their
projected distance and verifies their vectors; it stops once a vector as near as the k-th best so far would, with
probability `stop`, have been projected nearer than any leaf still to come. A true neighbour is so missed with
probability 1 - stop at most, whatever the data.

Large namespaces are split into blocks by the top of such a tree, laid out on a sample. A query visits only the blocks that
the same test, with the k-th best of the sample, can't exclude. A task holds the rows of one block at a time; the queries
that visit it pass by in batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.arrays import bytes_rows, column, copy_classes, cosines, row_bytes, unit, usable_by_dim
from nearfield.llm.blocks import MAX_BROADCAST_KEYS, with_blocks
from nearfield.operators.live import live_rows

ROWS = "namespace string, dim int, block int, is_visitor boolean, item_id string, seq long, asks boolean, raw binary"
OUT = "query_seq long, item_id string, seq long, cosine double"


def chi2_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution, by bisection of the regularised lower incomplete gamma series."""

    def cdf(x: float) -> float:
        a, x = m / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0

    lo, hi = 0.0, 10.0 * m + 50
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projection(dim: int, m: int, seed: int = 4) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m)).astype(np.float32)


class ProjectedTree:
    """A balanced kd-tree over m-dimensional projections of unit vectors; nodes are contiguous row ranges with their boxes."""

    def __init__(self, x: np.ndarray, m: int, leaf: int):
        self.a = projection(x.shape[1], m)
        p = x @ self.a
        order = np.arange(len(x))
        depth = max(0, math.ceil(math.log2(max(len(x), 1) / leaf)))
        cuts = np.array([0, len(x)])
        for _ in range(depth):
            mids = (cuts[:-1] + cuts[1:]) // 2
            for s, mid, e in zip(cuts[:-1], mids, cuts[1:], strict=True):
                if e - s > 1:
                    part = p[order[s:e]]
                    by = part[:, np.argmax(part.max(0) - part.min(0))]
                    order[s:e] = order[s:e][np.argpartition(by, mid - s)]
            cuts = np.insert(cuts, np.arange(1, len(cuts)), mids)
        self.order, self.x, self.start, self.end = order, x[order], cuts[:-1], cuts[1:]
        p = p[order]
        # boxes of the leaves, then of their parents up to the root; an empty leaf's box is nowhere
        lo, hi = np.full((len(self.start), m), np.inf, np.float32), np.full((len(self.start), m), -np.inf, np.float32)
        full = np.flatnonzero(self.end > self.start)
        lo[full], hi[full] = np.minimum.reduceat(p, self.start[full], axis=0), np.maximum.reduceat(p, self.start[full], axis=0)
        self.boxes = [(lo, hi)]
        while len(lo) > 1:
            lo, hi = np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])
            self.boxes.insert(0, (lo, hi))

    @staticmethod
    def _gap(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Squared distance of points to boxes, row by row."""
        g = np.maximum(np.maximum(lo - p, p - hi), 0)
        return np.einsum("ij,ij->i", g, g)

    def _verify(self, q: np.ndarray, of: np.ndarray, leaves: np.ndarray, best: np.ndarray, which: np.ndarray) -> None:
        """Merge the rows of leaves (a row of leaf numbers, -1 for none, for each query in `of`) into the best so far."""
        k, nl, width = best.shape[1], leaves.shape[1], int((self.end - self.start).max())
        sims = np.full((len(of), k + nl * width), -2, np.float32)
        sims[:, :k] = best[of]
        places = sims[:, k:].reshape(len(of), nl, width)
        row, col = np.divmod(np.argsort(leaves, axis=None, kind="stable"), nl)
        flat = leaves[row, col]
        cuts = np.flatnonzero(np.diff(flat)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(flat)], strict=True):
            if flat[s] >= 0:
                a, b = self.start[flat[s]], self.end[flat[s]]
                places[row[s:e], col[s:e], : b - a] = q[of[row[s:e]]] @ self.x[a:b].T
        sims[:, k:] = places.reshape(len(of), -1)
        top = np.argpartition(sims, -k, axis=1)[:, -k:]
        value = np.take_along_axis(sims, top, 1)
        nth, off = np.divmod(np.maximum(top - k, 0), width)
        new = np.where(value > -2, self.start[np.take_along_axis(leaves, nth, 1)] + off, -1)
        which[of] = np.where(top < k, np.take_along_axis(which[of], np.minimum(top, k - 1), 1), new)
        best[of] = value

    def search(self, q: np.ndarray, k: int, stop_factor: float, leaves_at_once: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, float32 cosines) of the k best per query, padded by -1; unsorted."""
        nq, pq = len(q), q @ self.a
        best, which = np.full((nq, k), -2, np.float32), np.full((nq, k), -1, np.int64)
        # down the tree to the nearest leaf: a first k-th best
        home = np.zeros(nq, int)
        for lo, hi in self.boxes[1:]:
            left = 2 * home
            home = left + (self._gap(pq, lo[left + 1], hi[left + 1]) < self._gap(pq, lo[left], hi[left]))
        self._verify(q, np.arange(nq), home[:, None], best, which)
        # down again, by all branches that could hold something better
        of, node, bound = np.arange(nq), np.zeros(nq, int), np.zeros(nq, np.float32)
        for lo, hi in self.boxes[1:]:
            of, node = np.repeat(of, 2), (2 * node[:, None] + np.arange(2)).ravel()
            bound = self._gap(pq[of], lo[node], hi[node])
            worst = np.where(which.min(1) < 0, np.inf, np.maximum(2 - 2 * best.min(1), 0))
            keep = bound < stop_factor * worst[of]
            of, node, bound = of[keep], node[keep], bound[keep]
        other = node != home[of]
        of, node, bound = of[other], node[other], bound[other]
        by = np.lexsort((bound, of))
        of, node, bound = of[by], node[by], bound[by]
        at, end = np.searchsorted(of, np.arange(nq)), np.searchsorted(of, np.arange(nq), "right")
        todo = np.flatnonzero(at < end)
        while len(todo):
            worst = np.maximum(2 - 2 * best[todo].min(1), 0)
            todo = todo[(bound[at[todo]] < stop_factor * worst) | (which[todo].min(1) < 0)]
            if not len(todo):
                break
            pos = at[todo][:, None] + np.arange(leaves_at_once)
            self._verify(q, todo, np.where(pos < end[todo][:, None], node[np.minimum(pos, len(node) - 1)], -1), best, which)
            at[todo] += leaves_at_once
            todo = todo[at[todo] < end[todo]]
        return np.where(which >= 0, self.order[which], -1), best


class Layout:
    """How a large namespace is split: the top of a kd-tree over a sample, and the sample itself."""

    def __init__(self, sample: np.ndarray, n_rows: float, block_rows: int, m: int):
        self.a, self.sample = projection(sample.shape[1], m), sample
        p = sample @ self.a
        self.planes: list[tuple[int, float, int, int]] = []  # axis, value, then nodes; leaves are negative
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.slices: list[int] = []

        def build(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
            here = n_rows * len(rows) / len(sample)
            axis = int(np.argmax(p[rows].max(0) - p[rows].min(0)))
            value = float(np.median(p[rows, axis]))
            near = p[rows, axis] < value
            if here > block_rows and len(rows) >= 32 and near.any():
                at = len(self.planes)
                self.planes.append((axis, value, 0, 0))
                left_hi, right_lo = hi.copy(), lo.copy()
                left_hi[axis] = right_lo[axis] = value
                self.planes[at] = axis, value, build(rows[near], lo, left_hi), build(rows[~near], right_lo, hi)
                return at
            self.lo.append(lo)
            self.hi.append(hi)
            # what can't be parted by a plane, as equal vectors, is cut by a hash
            self.slices.append(max(1, math.ceil(here / block_rows)))
            return -len(self.slices)

        m_inf = np.full(m, np.inf, np.float32)
        self.root = build(np.arange(len(sample)), -m_inf, m_inf)
        self.low, self.high, self.n_slices = np.stack(self.lo), np.stack(self.hi), np.array(self.slices)
        self.first = np.cumsum(self.n_slices) - self.n_slices

    def home(self, x: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """The block of each row."""
        p, out, stack = x @ self.a, np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = self.first[-node - 1] + seq[rows] % self.n_slices[-node - 1]
            elif len(rows):
                axis, value, left, right = self.planes[node]
                near = p[rows, axis] < value
                stack += [(left, rows[near]), (right, rows[~near])]
        return out

    def visits(self, x: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of the blocks that can hold one of the k best of a row. The k-th best of the sample, the row itself
        apart, is never better than the k-th best of all rows."""
        rows, blocks = [], []
        for s in range(0, len(x), 1024):
            part = x[s : s + 1024]
            if len(self.sample) > k:
                worst = 2 - 2 * np.partition(part @ self.sample.T, -k - 1, axis=1)[:, -k - 1]
            else:
                worst = np.full(len(part), np.inf)
            p = part @ self.a
            bound = np.zeros((len(part), len(self.low)), np.float32)
            for j in range(p.shape[1]):
                gap = np.maximum(np.maximum(self.low[:, j] - p[:, j, None], p[:, j, None] - self.high[:, j]), 0)
                bound += gap * gap
            i, leaf = np.nonzero(bound < factor * np.maximum(worst, 1e-6)[:, None])
            n = self.n_slices[leaf]
            rows.append(s + np.repeat(i, n))
            blocks.append(np.repeat(self.first[leaf], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.concatenate(rows), np.concatenate(blocks)


class Block:
    """The rows of one block, and the search among them."""

    def __init__(self, items: list[pa.Array], seq: list[np.ndarray], raw: list[np.ndarray], k: int, m: int, leaf: int, factor: float):
        self.k, self.factor = k, factor
        seq_all, raw_all = np.concatenate(seq), np.concatenate(raw)
        self.items = pa.chunked_array(items, pa.string())
        # repeated rows count once; of equal vectors only the k + 1 written first can be among the k nearest
        home = np.unique(seq_all, return_index=True)[1]
        head = copy_classes(raw_all[home])
        order = np.argsort(head, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(head[order]) != 0))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        self.home = home[np.sort(order[rank <= k])]
        self.seq, self.raw = seq_all, raw_all
        self.tree = ProjectedTree(unit(raw_all[self.home]), m, leaf)

    def neighbours(self, seq: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        more = min(self.k + 8, len(self.home))
        for s in range(0, len(seq), 512):
            qs, qr = seq[s : s + 512], raw[s : s + 512]
            found, _ = self.tree.search(unit(qr), more, self.factor)
            a, b = np.repeat(np.arange(len(qs)), more), found.ravel()
            a, b = a[b >= 0], self.home[b[b >= 0]]
            other = qs[a] != self.seq[b]
            a, b = a[other], b[other]
            c = cosines(qr[a], self.raw[b])
            by = np.lexsort((self.seq[b], -c, a))
            a, b, c = a[by], b[by], c[by]
            starts = np.flatnonzero(np.append(True, np.diff(a) != 0)) if len(a) else np.array([], int)
            rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
            a, b, c = a[rank < self.k], b[rank < self.k], c[rank < self.k]
            yield pa.RecordBatch.from_arrays([pa.array(qs[a]), self.items.take(pa.array(b)).combine_chunks(), pa.array(self.seq[b]), pa.array(c)], ["query_seq", "item_id", "seq", "cosine"])



def nearest(log: DataFrame, is_query: Column, k: int = 10, m: int = 10, stop: float = 0.95, leaf: int = 256, block_rows: int = 32_768, sample_rows: int = 32_768, dims: tuple[int, ...] | None = None) -> DataFrame:
    """For each live usable row that satisfies `is_query`, the k items of its namespace and dimension of highest cosine.

    log: namespace, item_id, vector, seq (other columns are ignored). A key's row of highest seq is its live one, usable or
    not and of whatever dimension; dead rows neither ask nor are found. Columns: query_seq, place, item_id, seq, cosine;
    equal cosines by smaller seq first. A query without any other item in its namespace gives no row. Null or empty vectors,
    those with null, NaN or infinite components and those of norm 0 take no part; a null namespace is a namespace, a null
    item_id an item. Rows without seq are no part of the log.

    Every row is indexed, in one block. block_rows is the size of a block; sample_rows bounds the sample on which the
    blocks of large namespaces are laid out. It decides what is compared where: namespaces that have no part in it are cut
    by a hash, and their queries visit every block.
    """
    factor = chi2_quantile(stop, m)
    # before unusable rows and other dimensions are left out, which may be a key's last word
    alive = live_rows(log.select("namespace", "item_id", "seq", "vector", F.coalesce(is_query, F.lit(False)).alias("asks")))
    asked = log.filter(is_query & F.col("seq").isNotNull()).select(F.col("namespace").alias("_asked")).distinct()
    few = asked.limit(MAX_BROADCAST_KEYS + 1).collect()
    if len(few) <= MAX_BROADCAST_KEYS:
        # namespaces without a query needn't be moved
        asked = log.sparkSession.createDataFrame([(r[0],) for r in few], "_asked string")
        alive = alive.join(F.broadcast(asked), F.col("namespace").eqNullSafe(F.col("_asked")), "left_semi")
    rows, n_large = with_blocks(alive, block_rows)
    layouts: dict[tuple, Layout] = {}
    if n_large:
        each = max(64, sample_rows // n_large)
        picked = rows.filter((F.col("n_blocks") > 1) & (F.pmod(F.xxhash64("item_id", F.lit(7)), F.greatest("n_rows", F.lit(1))) < each))
        picked = picked.select("namespace", "n_rows", "vector").limit(2 * sample_rows).toArrow().combine_chunks()
        for b in picked.to_batches():
            ns, n = column(b, "namespace").to_pylist(), column(b, "n_rows").to_numpy()
            usable = usable_by_dim(column(b, "vector"))
            total: dict[str | None, int] = {}
            for _, at, _ in usable:
                for i in at.tolist():
                    total[ns[i]] = total.get(ns[i], 0) + 1
            for d, at, mat in usable:
                of: dict[str | None, list[int]] = {}
                for j, i in enumerate(at.tolist()):
                    of.setdefault(ns[i], []).append(j)
                for name, js in of.items():
                    layouts[name, d] = Layout(unit(mat[js]), n[at[js[0]]] * len(js) / total[name], block_rows, m)
    layouts_sent = log.sparkSession.sparkContext.broadcast(layouts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns_col = column(b, "namespace").dictionary_encode(null_encoding="encode")
            names, code = ns_col.dictionary.to_pylist(), ns_col.indices.to_numpy(zero_copy_only=False)
            seq_all, asks_all, n_blocks = column(b, "seq").to_numpy(), column(b, "asks").to_numpy(zero_copy_only=False), column(b, "n_blocks").to_numpy()
            for d, at, mat in usable_by_dim(column(b, "vector")):
                if (dims and d not in dims) or not len(at):
                    continue
                seq, asks, block = seq_all[at], asks_all[at], np.zeros(len(at), np.int64)
                rows, blocks = [], []
                for c in np.unique(code[at[n_blocks[at] > 1]]):
                    mine = np.flatnonzero(code[at] == c)
                    layout = layouts_sent.value.get((names[c], d))
                    ask = mine[asks[mine]]
                    if layout is None:
                        n = int(n_blocks[at[mine[0]]])
                        block[mine] = seq[mine] % n
                        r, v = np.repeat(ask, n), np.tile(np.arange(n), len(ask))
                    else:
                        x = unit(mat[mine])
                        block[mine] = layout.home(x, seq[mine])
                        i, v = layout.visits(x[asks[mine]], k, factor) if len(ask) else (np.empty(0, int), np.empty(0, int))
                        r = ask[i]
                    away = v != block[r]
                    rows.append(r[away])
                    blocks.append(v[away])
                away = np.concatenate(rows) if rows else np.empty(0, int)
                who = np.concatenate([np.arange(len(at)), away])
                where = np.concatenate([block, *blocks]).astype(np.int32)
                visitor = np.arange(len(who)) >= len(at)
                for s in range(0, len(who), 8192):
                    w = who[s : s + 8192]
                    t = pa.array(at[w])
                    yield pa.RecordBatch.from_arrays(
                        [column(b, "namespace").take(t), pa.array(np.full(len(w), d, np.int32)), pa.array(where[s : s + 8192]), pa.array(visitor[s : s + 8192]), column(b, "item_id").take(t), pa.array(seq[w]), pa.array(asks[w]), row_bytes(mat[w])],
                        ["namespace", "dim", "block", "is_visitor", "item_id", "seq", "asks", "raw"],
                    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items, seqs, raws, asking, block = None, [], [], [], [], None

        def built() -> Block | None:
            """The block of the rows so far, once a query needs it."""
            return Block(items, seqs, raws, k, m, leaf, factor) if seqs else None

        def close() -> Iterator[pa.RecordBatch]:
            """The queries among the block's own rows."""
            own = block or (built() if any(a.any() for a in asking) else None)
            for s, r, a in zip(seqs, raws, asking, strict=True) if own else ():
                yield from own.neighbours(s[a], r[a])

        for b in batches:
            ns, dim, blk = column(b, "namespace"), column(b, "dim").to_numpy(), column(b, "block").to_numpy()
            code = ns.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            visitor = column(b, "is_visitor").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(code) != 0) | (np.diff(dim) != 0) | (np.diff(blk) != 0) | (np.diff(visitor.astype(np.int8)) != 0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                if s == e:
                    continue
                now = (ns[s].as_py(), int(dim[s]), int(blk[s]))
                if now != key:
                    yield from close()
                    key, items, seqs, raws, asking, block = now, [], [], [], [], None
                part = b.slice(s, e - s)
                seq, raw = column(part, "seq").to_numpy(), bytes_rows(column(part, "raw"), int(dim[s]))
                if not visitor[s]:
                    items.append(column(part, "item_id"))
                    seqs.append(seq)
                    raws.append(raw)
                    asking.append(column(part, "asks").to_numpy(zero_copy_only=False))
                elif seqs:
                    block = block or built()
                    yield from block.neighbours(seq, raw)
        yield from close()

    placed = rows.select("namespace", "item_id", "seq", "vector", "asks", "n_blocks").mapInArrow(place, ROWS)
    # own rows first: they are held, the visitors pass by
    found = placed.repartition("namespace", "dim", "block").sortWithinPartitions("namespace", "dim", "block", "is_visitor").mapInArrow(search, OUT)
    order = Window.partitionBy("query_seq").orderBy(F.col("cosine").desc(), F.col("seq").asc())
    once = found.withColumn("again", F.lag("seq").over(order)).filter(F.col("again").isNull() | (F.col("again") != F.col("seq")))
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query_seq", "place", "item_id", "seq", "cosine")
