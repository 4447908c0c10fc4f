"""Near copies among vectors: pairs of items of one namespace whose cosine reaches a threshold.

Vectors get sign fingerprints of random hyperplanes, on which the share of differing bits follows the angle. A
vantage-point tree over fingerprints partitions large namespaces into shards: a row lives in one shard and visits every
other whose boundary is within the search radius, by the triangle inequality. Inside a shard a tree of the same kind
prunes branches, and what is left is compared and verified by its exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.arrays import bytes_rows, column, copy_classes, cosines, row_bytes, row_hash, unit, usable_by_dim
from nearfield.llm.blocks import with_blocks
from nearfield.llm.components import components, star_links
from nearfield.operators.live import live_rows
from nearfield.session import persist_table

BITS = 1024
#: Words of 64 bits compared first; the whole fingerprint serves the tree and the second look.
HEAD = 4
SHARD = "namespace string, dim int, leaf int, i int, j int, slice int, is_home boolean, raw binary, members array<struct<item_id:string,seq:bigint>>"
FOUND = "namespace string, a long, b long, item_id string, seq long, n long"


def radius(cosine: float, bits: int, miss: float = 1e-4) -> int:
    """Smallest distance that two vectors of at least that cosine exceed with probability `miss` at most."""
    p = math.acos(min(1.0, cosine)) / math.pi
    if p == 0:
        return 0
    total, r = 0.0, -1
    while total < 1 - miss and r < bits:
        r += 1
        total += math.exp(math.lgamma(bits + 1) - math.lgamma(r + 1) - math.lgamma(bits - r + 1) + r * math.log(p) + (bits - r) * math.log1p(-p))
    return r


def fingerprints(x: np.ndarray, bits: int = BITS, seed: int = 2) -> np.ndarray:
    """Sign bits of `bits` random projections as uint64 words."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], bits)).astype(np.float32)
    out = np.empty((len(x), bits // 64), np.uint64)
    for s in range(0, len(x), 4096):
        out[s : s + 4096] = np.packbits(x[s : s + 4096] @ planes > 0, axis=1).view(np.uint64)
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, word by word."""
    d = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        d += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return d


def _majority(fp: np.ndarray) -> np.ndarray:
    """The fingerprint of the bits that most rows have."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1)
    return np.packbits(bits.mean(0) > 0.5).view(np.uint64)


class VantageTree:
    """Vantage points with the distance that parts near from far; built on fingerprints, split where few rows lie at the boundary."""

    def __init__(self, fp: np.ndarray, r: int, leaf: int, max_overlap: float, seed: int = 1):
        self.r, self.nodes, self.n_leaves = r, [], 0
        rng = np.random.default_rng(seed)

        def build(rows: np.ndarray) -> int:
            """Number of the node; leaves are negative."""
            if len(rows) > leaf:
                probe = rows if len(rows) <= 2048 else rng.choice(rows, 2048, replace=False)
                best = (max_overlap, 0, None)
                for c in rng.choice(rows, 8):
                    # the majority of a row's surroundings lies nearer to all of them than the row itself
                    around = probe[hamming(fp[c : c + 1], fp[probe])[0] <= 0.3 * 64 * fp.shape[1]]
                    point = _majority(fp[around]) if len(around) > 2 else fp[c]
                    d = np.sort(hamming(point[None], fp[probe])[0].astype(np.int64))
                    mu = np.unique(np.linspace(d[0], d[-1], 60).astype(np.int64))
                    near = np.searchsorted(d, mu, "right") / len(d)
                    both = (np.searchsorted(d, mu + r, "right") - np.searchsorted(d, mu - r, "right")) / len(d)
                    cost = both + 0.02 * np.abs(near - 0.5) + (np.minimum(near, 1 - near) < 0.005)
                    k = int(np.argmin(cost))
                    if cost[k] < best[0]:
                        best = (cost[k], int(mu[k]), point)
                if best[2] is not None:
                    d = hamming(best[2][None], fp[rows])[0]
                    inside = d <= best[1]
                    if inside.any() and not inside.all():
                        self.nodes.append([best[2], best[1], 0, 0])
                        at = len(self.nodes) - 1
                        self.nodes[at][2], self.nodes[at][3] = build(rows[inside]), build(rows[~inside])
                        return at
            self.n_leaves += 1
            return -self.n_leaves

        self.root = build(np.arange(len(fp)))

    def _descend(self, fp: np.ndarray, slack: int) -> Iterator[tuple[int, np.ndarray]]:
        stack = [(self.root, np.arange(len(fp)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows
                continue
            point, mu, near, far = self.nodes[node]
            d = hamming(point[None], fp[rows])[0].astype(np.int64)
            stack += [(near, rows[d <= mu + slack]), (far, rows[d > mu - slack])]

    def home(self, fp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fp), np.int32)
        for leaf, rows in self._descend(fp, 0):
            out[rows] = leaf
        return out

    def visits(self, fp: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows that may have a partner there)."""
        return list(self._descend(fp, self.r))


def _compare(members: np.ndarray, asking: np.ndarray, fp: np.ndarray, raw: np.ndarray, seq: np.ndarray, cosine: float, r: int, r_head: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified ordered pairs (asking row, member) with the smaller seq asking."""
    tree = VantageTree(fp[members], r, 256, 0.5)
    home = tree.home(fp[members])
    for leaf, visiting in tree.visits(fp[asking]):
        m = members[home == leaf]
        for s in range(0, len(visiting), 1024):
            q = asking[visiting[s : s + 1024]]
            for t in range(0, len(m), 1024):
                part = m[t : t + 1024]
                a, b = np.nonzero(hamming(fp[q, :HEAD], fp[part, :HEAD]) <= r_head)
                a, b = q[a], part[b]
                ok = seq[a] < seq[b]
                a, b = a[ok], b[ok]
                ok = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= r
                a, b = a[ok], b[ok]
                for u in range(0, len(a), 65_536):
                    x, y = a[u : u + 65_536], b[u : u + 65_536]
                    ok = cosines(raw[x], raw[y]) >= cosine
                    if ok.any():
                        yield x[ok], y[ok]


def near_copy_classes(log: DataFrame, cosine: float = 0.97, block_rows: int = 32_768, sample_rows: int = 16_384, stars: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, degrees) of the live usable rows of each namespace and dimension.

    members: namespace, cls, item_id, seq - the items of each class of equal vectors that has a partner or two items;
    links: a, b - pairs of classes whose cosine reaches the threshold, or with `stars` no more than a link a class and
    shard that connect the same classes; degrees (with stars): cls, n_links - the pairs that a class has. cls is the
    smallest seq of the class. Null item_ids form an item. Null, empty, non-finite and zero vectors take no part, nor do
    rows without seq.

    sample_rows bounds the sample on which the shard tree is built; it decides the layout alone, never the result.
    """
    rows, n_large = with_blocks(live_rows(log.select("namespace", "item_id", "seq", "vector")), block_rows)
    r, r_head = radius(cosine, BITS), radius(cosine, HEAD * 64)
    trees: dict[int, VantageTree] = {}
    slices: dict[tuple, int] = {}
    sampled: set[tuple] = set()
    if n_large:
        each = max(16, sample_rows // n_large)
        picked = rows.filter((F.col("n_blocks") > 1) & (F.pmod(F.xxhash64("item_id", F.lit(7)), F.greatest("n_rows", F.lit(1))) < each))
        picked = picked.select("namespace", "n_rows", "vector").limit(4 * sample_rows).toArrow().combine_chunks()
        batch = picked.to_batches()[0] if picked.num_rows else None
        for d, at, m in usable_by_dim(column(batch, "vector")) if batch is not None else []:
            fp = fingerprints(unit(m))
            trees[d] = VantageTree(fp, r, max(64, sample_rows // 64), 0.35)
            home, ns, n = trees[d].home(fp), column(batch, "namespace").take(pa.array(at)).to_pylist(), column(batch, "n_rows").to_numpy()[at]
            total: dict[str, int] = {}
            for x in ns:
                total[x] = total.get(x, 0) + 1
            sampled |= {(x, d) for x in total}
            share: dict[tuple, float] = {}
            for x, leaf, rows_of in zip(ns, home, n, strict=True):
                share[x, d, int(leaf)] = share.get((x, d, int(leaf)), 0) + rows_of / total[x]
            slices |= {key: math.ceil(v / block_rows) for key, v in share.items() if v > block_rows}

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, m in usable_by_dim(column(b, "vector")):
                if not len(at):
                    continue
                ns_col = column(b, "namespace").take(pa.array(at)).dictionary_encode(null_encoding="encode")
                code = ns_col.indices.to_numpy().astype(np.int64)
                head = copy_classes(m, code)
                uniq, cls = np.unique(head, return_inverse=True)
                fp = fingerprints(unit(m[uniq]))
                names = ns_col.dictionary.to_pylist()
                is_large = column(b, "n_blocks").to_numpy()[at[uniq]] > 1
                home = np.full(len(uniq), -1, np.int32)
                who, leaf = [np.flatnonzero(~is_large)], [np.full(int((~is_large).sum()), -1, np.int32)]
                big = np.flatnonzero(is_large)
                if len(big) and d in trees:
                    home[big] = trees[d].home(fp[big])
                    for lf, v in trees[d].visits(fp[big]):
                        who.append(big[v])
                        leaf.append(np.full(len(v), lf, np.int32))
                elif len(big):
                    who.append(big)
                    leaf.append(np.full(len(big), -1, np.int32))
                who, leaf = np.concatenate(who), np.concatenate(leaf)
                # a shard too large for one task is cut into slices, compared slice by slice
                n_sl = np.ones(len(who), np.int64)
                for c in np.unique(code[uniq[big]]):
                    mine = np.flatnonzero(is_large[who] & (code[uniq[who]] == c))
                    if (names[c], d) in sampled:
                        n_sl[mine] = [slices.get((names[c], d, lf), 1) for lf in leaf[mine].tolist()]
                    elif len(mine):
                        # nothing is known of its shards: as many slices as would do for the namespace
                        n_sl[mine] = column(b, "n_blocks").to_numpy()[at[uniq[who[mine[0]]]]]
                sl = (row_hash(m[uniq])[who] % n_sl.astype(np.uint64)).astype(np.int32)
                rep = np.repeat(np.arange(len(who)), n_sl)
                other = (np.arange(len(rep)) - np.repeat(np.cumsum(n_sl) - n_sl, n_sl)).astype(np.int32)
                who, leaf, sl = who[rep], leaf[rep], sl[rep]
                order = np.argsort(cls, kind="stable")
                size = np.bincount(cls, minlength=len(uniq))
                members = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(size)).astype(np.int32)),
                    pa.StructArray.from_arrays([column(b, c).take(pa.array(at[order])) for c in ("item_id", "seq")], ["item_id", "seq"]),
                )
                for s in range(0, len(who), 8192):
                    w = who[s : s + 8192]
                    yield pa.RecordBatch.from_arrays(
                        [column(b, "namespace").take(pa.array(at[uniq[w]])), pa.array(np.full(len(w), d, np.int32)), pa.array(leaf[s : s + 8192]), pa.array(np.minimum(sl, other)[s : s + 8192]), pa.array(np.maximum(sl, other)[s : s + 8192]), pa.array(sl[s : s + 8192]), pa.array(home[w] == leaf[s : s + 8192]), row_bytes(m[uniq[w]]), members.take(pa.array(w))],
                        ["namespace", "dim", "leaf", "i", "j", "slice", "is_home", "raw", "members"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition is sorted: one shard's rows at a time."""
        key, parts = None, []
        for b in batches:
            code = column(b, "namespace").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cols = [code, *(column(b, c).to_numpy() for c in ("dim", "leaf", "i", "j"))]
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                if s == e:
                    continue
                now = (column(b, "namespace")[s].as_py(), *(int(c[s]) for c in cols[1:]))
                if now != key:
                    if parts:
                        yield from compare_shard(*key, parts)
                    key, parts = now, []
                parts.append(b.slice(s, e - s))
        if parts:
            yield from compare_shard(*key, parts)

    def rows_of(name: str | None, size: int, **cols: pa.Array) -> pa.RecordBatch:
        kinds = {"a": pa.int64(), "b": pa.int64(), "item_id": pa.string(), "seq": pa.int64(), "n": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([name] * size, pa.string()), *(cols[c] if c in cols else pa.nulls(size, k) for c, k in kinds.items())], ["namespace", *kinds])

    def compare_shard(name: str | None, d: int, leaf: int, i: int, j: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.concatenate([bytes_rows(column(p, "raw"), d) for p in parts])
        home, sl = (np.concatenate([column(p, c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("is_home", "slice"))
        lists = [column(p, "members") for p in parts]
        n_each = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists])
        elements = [x.flatten() for x in lists]
        el_seq = np.concatenate([x.field("seq").to_numpy(zero_copy_only=False) for x in elements]).astype(np.int64)
        el_item = pa.chunked_array([x.field("item_id") for x in elements], pa.string())
        # copies met in different batches become one class; its number is the smallest seq of it
        uniq, cls = np.unique(copy_classes(raw), return_inverse=True)
        owner = cls[np.repeat(np.arange(len(n_each)), n_each)]
        seq = np.full(len(uniq), np.iinfo(np.int64).max)
        np.minimum.at(seq, owner, el_seq)
        n_items = np.bincount(owner, minlength=len(uniq))
        raw, home, sl = raw[uniq], home[uniq], sl[uniq]
        fp = fingerprints(unit(raw))
        degree = np.zeros(len(uniq), np.int64)
        if i == j:
            runs = [(np.flatnonzero(home), np.arange(len(uniq)))]
        else:
            runs = [(np.flatnonzero(home & (sl == x)), np.flatnonzero(sl == y)) for x, y in ((i, j), (j, i))]
        star, waiting = (np.empty(0, np.int64), np.empty(0, np.int64)), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for m, q in runs:
            for a, b in _compare(m, q, fp, raw, seq, cosine, r, r_head) if len(m) and len(q) else ():
                degree += np.bincount(a, minlength=len(uniq)) + np.bincount(b, minlength=len(uniq))
                if not stars:
                    yield rows_of(name, len(a), a=pa.array(seq[a]), b=pa.array(seq[b]))
                    continue
                held.append((a, b))
                waiting += len(a)
                if waiting > 1 << 20:
                    star, held, waiting = star_links(*(np.concatenate(x) for x in zip(star, *held, strict=True))), [], 0
        if stars:
            a, b = star_links(*(np.concatenate(x) for x in zip(star, *held, strict=True)))
            yield rows_of(name, len(a), a=pa.array(seq[a]), b=pa.array(seq[b]))
            linked = np.flatnonzero(degree)
            yield rows_of(name, len(linked), a=pa.array(seq[linked]), n=pa.array(degree[linked]))
        # a visitor's members are told too: the partner's shard alone may have found the link
        e = np.flatnonzero(((degree > 0) | ((n_items > 1) & home))[owner])
        for s in range(0, len(e), 65_536):
            part = e[s : s + 65_536]
            yield rows_of(name, len(part), a=pa.array(seq[owner[part]]), item_id=el_item.take(pa.array(part)).combine_chunks(), seq=pa.array(el_seq[part]))

    shards = rows.select("namespace", "item_id", "seq", "vector", "n_blocks").mapInArrow(shard, SHARD)
    by = ("namespace", "dim", "leaf", "i", "j")
    found = persist_table(shards.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, FOUND), "near-copies")
    members = found.filter("seq is not null").select("namespace", F.col("a").alias("cls"), "item_id", "seq").distinct()
    links = found.filter("b is not null").select("a", "b").distinct()
    degrees = found.filter("n is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n_links"))
    return members, links, degrees


def near_copy_pairs(log: DataFrame, cosine: float = 0.97, **kw: int) -> DataFrame:
    """(namespace, item_a, item_b) with item_a < item_b: all pairs of different items; an item with a null id has no pair."""
    members, links, _ = near_copy_classes(log, cosine, **kw)
    m = members.select("namespace", "cls", "item_id")
    both = links.unionByName(members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    x = m.select(F.col("cls").alias("a"), "namespace", F.col("item_id").alias("x"))
    y = m.select(F.col("cls").alias("b"), F.col("item_id").alias("y"))
    pairs = both.join(x, "a").join(y, "b").filter((F.col("x") < F.col("y")) | ((F.col("a") != F.col("b")) & (F.col("x") > F.col("y"))))
    return pairs.select("namespace", F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).distinct()


def near_copy_groups(log: DataFrame, cosine: float = 0.97, **kw: int) -> DataFrame:
    """(namespace, item_id, seq, group_id, n_links) for each item with a partner; group_id is the smallest class number of
    the chain of links, n_links the number of other classes linked to the item's class."""
    members, links, degrees = near_copy_classes(log, cosine, stars=True, **kw)
    group = components(links)
    size = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    out = members.join(group.withColumnRenamed("node", "cls"), "cls", "left").join(degrees, "cls", "left")
    out = out.join(size, "cls").filter("n > 1 or n_links > 0")
    return out.select("namespace", "item_id", "seq", F.coalesce("component", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
