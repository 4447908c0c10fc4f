"""Vector operators against brute force, with nulls, ties, repeats, hot groups and empty tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import blocks
from nearfield.llm.components import components
from nearfield.llm.diverse import greedy_determinant, varied_subset
from nearfield.llm.mixture import similarity_clusters
from nearfield.llm.near_copies import VantageTree, fingerprints, hamming, near_copy_classes, near_copy_groups, near_copy_pairs, radius
from nearfield.llm.neighbours import Layout, ProjectedTree, chi2_quantile, nearest
from nearfield.llm.probes import Probes

SCHEMA = "namespace string, item_id string, seq long, vector array<float>"
DIRT = [("a", "null", 9001, None), ("a", "empty", 9002, []), ("a", "zero", 9003, [0.0] * 8), ("a", "nan", 9004, [float("nan")] * 8), ("a", "inf", 9005, [float("inf")] * 8), ("a", "hole", 9006, [None] + [1.0] * 7), (None, None, 9007, [1.0] * 8), (None, "x", 9008, [1.0] * 8), ("a", "no seq", None, [1.0] * 8)]


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def rows():
    """Three topics, scattered rows, near and exact copies, dead versions, a redelivery, one hot namespace."""
    rng = np.random.default_rng(5)
    out, centres = [], unit(rng.normal(size=(3, 8)))
    for i in range(300):
        v = unit(centres[i % 3] + 0.15 * rng.normal(size=8)) if i % 10 else unit(rng.normal(size=8))
        out.append(("a" if i % 3 else f"n{i % 5}", f"i{i}", i, (v * (3 if i % 7 == 0 else 1)).astype(np.float32).tolist()))
    out += [(ns, f"copy{s}", 1000 + s, v) for ns, _, s, v in out[:40]]
    out += [("a", f"same{s}", 2000 + s, out[1][3]) for s in range(30)]
    out += [(ns, item, 3000 + s, unit(rng.normal(size=8)).astype(np.float32).tolist()) for ns, item, s, _ in out[50:70]]
    out += [("a", f"short{s}", 4000 + s, [1.0, 0.1 * s]) for s in range(5)]
    out.append(out[5])
    return out + DIRT


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit("clash")).withColumn("raw", F.lit(1)).repartition(5)


def live(rows):
    last = {}
    for r in rows:
        if r[2] is not None and ((r[0], r[1]) not in last or last[r[0], r[1]][2] <= r[2]):
            last[r[0], r[1]] = r
    return [r for r in last.values() if r[3] and all(x is not None and np.isfinite(x) for x in r[3]) and any(r[3])]


def cosine(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_chi2_quantile():
    assert chi2_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3)
    assert chi2_quantile(0.5, 2) == pytest.approx(1.3863, abs=1e-3)


def test_layout_excludes_no_near_block():
    rng = np.random.default_rng(3)
    centre = unit(rng.normal(size=(12, 32)))
    x = unit(centre[rng.integers(0, 12, 6000)] + 0.02 * rng.normal(size=(6000, 32))).astype(np.float32)
    lay = Layout(x[::6], len(x), 400, 10)
    home = lay.home(x, np.arange(len(x)))
    assert len(np.unique(home)) > 8 and np.bincount(home).max() < 1200
    q = np.arange(0, 6000, 60)
    who, block = lay.visits(x[q], 10, chi2_quantile(0.95, 10))
    reach = set(zip(who.tolist(), block.tolist()))
    near = np.argsort(-(x[q] @ x.T), axis=1)[:, 1:11]
    met = [(i, int(home[j])) in reach for i in range(len(q)) for j in near[i]]
    assert np.mean(met) >= 0.97 and len(reach) < 0.7 * len(q) * len(np.unique(home))
    same = Layout(np.tile(x[:1], (100, 1)), 5000, 400, 10)  # nothing to part: cut by a hash
    assert len(np.unique(same.home(np.tile(x[:1], (5000, 1)), np.arange(5000)))) == 13


def test_probes_equal_a_full_product():
    rng = np.random.default_rng(2)
    centre = unit(rng.normal(size=(5, 24))).astype(np.float32)
    x = unit(np.concatenate([centre[rng.integers(0, 5, 3000)] + 0.1 * rng.normal(size=(3000, 24)), rng.normal(size=(1500, 24))])).astype(np.float32)
    p = x[::7]
    want = set(zip(*(v.tolist() for v in np.nonzero(x @ p.T >= 0.5))))
    for c in (None, centre):
        assert {(int(a), int(b)) for i, j in Probes(p, 0.5, c).hits(x) for a, b in zip(i, j)} == want
    assert not list(Probes(p[:0], 0.5, centre).hits(x)) and not list(Probes(p, 0.5, centre).hits(x[:0]))


def test_probes_bound_most_pairs_of_rows_near_a_centre():
    """Scattered probes against topics and scattered rows, a few pairs planted about the threshold: all are found, few products made."""
    rng, d = np.random.default_rng(12), 128
    scale = np.where(np.arange(d) % 3 > 0, 1, 0.3)
    c = unit(rng.normal(size=(4, d)) * scale).astype(np.float32)
    x = unit(c[rng.integers(0, 4, 3000)] * 0.865 + 0.5 * unit(rng.normal(size=(3000, d)) * scale))
    p = unit(rng.normal(size=(1500, d)) * scale)
    for i, cosine_to in enumerate(np.concatenate([np.linspace(0.45, 0.55, 60), np.full(20, 0.5)])):
        off = unit(p[i] - p[i] @ x[i] * x[i])
        p[i] = cosine_to * x[i] + np.sqrt(1 - cosine_to**2) * off
    x, p = np.concatenate([x, p[1000:]]).astype(np.float32), p.astype(np.float32)
    made = []

    class Counted(Probes):
        def _tiles(self, x, p, *more):
            made.append(len(x) * len(p))
            return super()._tiles(x, p, *more)

    a, b = (m.astype(float) for m in (x, p))
    want = set(zip(*(w.tolist() for w in np.nonzero(unit(a) @ unit(b).T >= 0.5 - 1e-12)), strict=True))
    got = {(int(i), int(j)) for rows, of in Counted(p, 0.5, c).hits(x) for i, j in zip(rows, of, strict=True)}
    sure = {(i, j) for i, j in want if unit(a[i]) @ unit(b[j]) >= 0.5 + 1e-12}
    assert sure <= got <= want and len(got) > 500
    assert sum(made) < 0.2 * len(x) * len(p)


def test_projected_tree_recall():
    rng = np.random.default_rng(1)
    x = unit(rng.normal(size=(4000, 64))).astype(np.float32)
    x[1000:] = unit(x[:1000].repeat(3, 0) + 0.1 * rng.normal(size=(3000, 64)))
    q = x[::40]
    got, _ = ProjectedTree(x, 10, 32).search(q, 10, chi2_quantile(0.95, 10))
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, true)]) >= 0.9


@pytest.mark.parametrize("block_rows, sample_rows", [(32_768, 100), (40, 10_000), (40, 0)])
def test_nearest_equals_brute_force(log, rows, block_rows, sample_rows):
    """In one block, in blocks by a layout, and without a sample to lay them out on."""
    k = 6
    got = {}
    for r in nearest(log, F.col("seq") % 4 == 0, k=k, stop=0.9999, leaf=16, block_rows=block_rows, sample_rows=sample_rows).collect():
        got.setdefault(r.query_seq, []).append((r.place, r.item_id, r.seq))
    alive = live(rows)
    true = {}
    for q in alive:
        if q[2] % 4 == 0:
            others = [(-cosine(q[3], o[3]), o[2], o[1]) for o in alive if o[0] == q[0] and o[1] != q[1] and len(o[3]) == len(q[3])]
            if others:
                true[q[2]] = [(p + 1, item, s) for p, (_, s, item) in enumerate(sorted(others)[:k])]
    assert set(got) == set(true)
    assert np.mean([sorted(got[s]) == v for s, v in true.items()]) >= 0.98
    assert nearest(log.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("block_rows", [32_768, 3])
def test_nearest_leaves_out_keys_overwritten_by_unusable_rows(spark, block_rows):
    good = [("a", f"i{s}", s, [1.0, 0.1 * s]) for s in range(8)]
    # the live rows of four keys: not finite, null, zero, of another dimension; a fifth came back to its first dimension
    last = [("a", "i1", 101, [float("nan"), 1.0]), ("a", "i2", 102, None), ("a", "i3", 103, [0.0, 0.0]), ("a", "i4", 104, [1.0, 0.0, 0.0]), ("a", "i5", 105, [1.0] * 3), ("a", "i5", 106, [1.0, 0.55])]
    got = nearest(spark.createDataFrame(good + last, SCHEMA).repartition(4), F.lit(True), k=10, block_rows=block_rows).collect()
    alive = {"i0": 0, "i5": 106, "i6": 6, "i7": 7}
    assert {(r.query_seq, r.item_id, r.seq) for r in got} == {(q, i, s) for a, q in alive.items() for i, s in alive.items() if a != i}


def test_block_lookup_by_join(log, rows, monkeypatch):
    monkeypatch.setattr(blocks, "MAX_BROADCAST_KEYS", 0)
    monkeypatch.setattr(blocks, "MAX_VERSIONS", 1)
    got = nearest(log, F.col("seq") % 4 == 0, k=3, stop=0.9999, block_rows=40)
    monkeypatch.undo()
    assert {tuple(r) for r in got.select("query_seq", "item_id").collect()} == {tuple(r) for r in nearest(log, F.col("seq") % 4 == 0, k=3, stop=0.9999).select("query_seq", "item_id").collect()}


def pairs(rows, least):
    alive, out = live(rows), set()
    for i, a in enumerate(alive):
        for b in alive[i + 1 :]:
            if a[0] == b[0] and a[1] and b[1] and a[1] != b[1] and len(a[3]) == len(b[3]) and cosine(a[3], b[3]) >= least:
                out.add((a[0], *sorted((a[1], b[1]))))
    return out


@pytest.mark.parametrize("block_rows, sample_rows", [(32_768, 64), (30, 64), (8, 64), (30, 0)])
def test_near_copy_pairs_equal_brute_force(log, rows, block_rows, sample_rows):
    got = {tuple(r) for r in near_copy_pairs(log, 0.97, block_rows=block_rows, sample_rows=sample_rows).collect()}
    assert got == pairs(rows, 0.97)
    members, links, degrees = near_copy_classes(log, 0.97, block_rows=block_rows, sample_rows=sample_rows, stars=True)
    group = {r.node: r.component for r in components(links).collect()}
    every = near_copy_classes(log, 0.97, block_rows=block_rows, sample_rows=sample_rows)[1].collect()
    n = Counter(x for p in every for x in p)
    assert {r.cls: r.n_links for r in degrees.collect()} == n and set(group) == set(n)
    assert all(group[a] == group[b] for a, b in every) and links.count() <= len(every)


def test_near_copy_groups(log, rows):
    got = near_copy_groups(log, 0.97).collect()
    link = pairs(rows, 0.97)
    items = {(p[0], x) for p in link for x in p[1:]}
    assert {(r.namespace, r.item_id) for r in got if r.namespace is not None} == items
    group = {(r.namespace, r.item_id): r.group_id for r in got}
    assert all(group[p[0], p[1]] == group[p[0], p[2]] for p in link)
    assert near_copy_groups(log.limit(0)).count() == near_copy_pairs(log.limit(0)).count() == 0


def test_vantage_tree_loses_nothing():
    rng = np.random.default_rng(2)
    c = unit(rng.normal(size=(6, 32)))
    x = unit(c[rng.integers(0, 6, 1500)] + 0.1 * rng.normal(size=(1500, 32))).astype(np.float32)
    fp, r = fingerprints(x), radius(0.97, 1024)
    tree = VantageTree(fp, r, 64, 0.9)
    home = tree.home(fp)
    reach = {(int(q), leaf) for leaf, v in tree.visits(fp) for q in v}
    a, b = np.nonzero(hamming(fp, fp) <= r)
    assert tree.n_leaves > 3 and all((int(i), int(home[j])) in reach for i, j in zip(a, b))
    assert radius(1.0, 1024) == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3), (100, 102)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters(spark):
    rng = np.random.default_rng(8)
    d = 96
    c = np.linalg.qr(rng.normal(size=(d, 5)))[0].T
    rows = []
    for i in range(600):
        v = c[i % 6] + 0.07 * rng.normal(size=d) if i % 6 < 5 else rng.normal(size=d)
        rows.append((f"n{i % 4}", f"i{i}", i + 10, (unit(v) * (1 + i % 3)).astype(np.float32).tolist()))
    for i in range(12):  # hanging on one member of a topic each, the last ones on the row before
        on = unit(np.array(rows[6 * i + i % 5][3] if i < 9 else rows[-1][3]))
        off = unit((lambda v: v - v @ on * on)(rng.normal(size=d)))
        rows.append(("n", f"far{i}", 1 + i % 3 + 700 * i, (0.56 * on + np.sqrt(1 - 0.56**2) * off).astype(np.float32).tolist()))
    rows += [rows[3], *DIRT]
    members, typical, model = similarity_clusters(spark.createDataFrame(rows, SCHEMA).withColumn("comp", F.lit("x")), link=0.5, width=d)
    alive = [r for r in live(rows) if len(r[3]) == d]
    x = unit(np.array([r[3] for r in alive]))
    label = np.arange(len(x))
    near = x @ x.T >= 0.5
    for _ in range(50):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    true = {}
    for lab in set(label):
        mine = [alive[i] for i in np.flatnonzero(label == lab)]
        if len(mine) >= 8:
            true |= {(r[0], r[1]): min(m[2] for m in mine) for r in mine}
    got = {(r.namespace, r.item_id): r.cluster_seq for r in members.collect()}
    assert got == true
    assert {r.cluster_seq for r in typical.collect()} == set(got.values()) and len(model.weight) >= 6
    assert similarity_clusters(spark.createDataFrame(rows[:0], SCHEMA))[0].count() == 0
    assert similarity_clusters(spark.createDataFrame(rows[:3], SCHEMA), width=d)[0].count() == 0


def test_clusters_that_no_sample_shows(spark):
    """Small topics that are no three neighbours in the sample, and a chain of 40 links behind a topic's member."""
    rng, d = np.random.default_rng(9), 96
    v = [*(unit(np.eye(d)[0] + 0.05 * rng.normal(size=d)) for _ in range(60)), *unit(rng.normal(size=(500, d)))]
    true = {f"i{i}": 0 for i in range(60)}
    for t in range(3):
        centre = unit(rng.normal(size=d))
        true |= {f"i{len(v) + i}": len(v) for i in range(8)}
        v += [unit(centre + 0.05 * rng.normal(size=d)) for _ in range(8)]
    for _ in range(40):
        on = v[0] if len(v) == 584 else v[-1]
        off = unit((lambda r: r - r @ on * on)(rng.normal(size=d)))
        true[f"i{len(v)}"] = 0
        v.append(0.53 * on + np.sqrt(1 - 0.53**2) * off)
    rows = [("n", f"i{i}", i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    members, typical, _ = similarity_clusters(spark.createDataFrame(rows, SCHEMA), link=0.5, width=d, sample=100, chunk=300)
    assert {r.item_id: r.cluster_seq for r in members.collect()} == true
    places = {(r.cluster_seq, r.place) for r in typical.collect()}
    assert {c for c, _ in places} == set(true.values()) and all((c, p) in places for c in (560, 568, 576) for p in range(1, 9))


def test_clusters_joined_by_ordinary_members_alone(spark):
    """A member at the edge of one topic is near a member at the edge of another, and near none of its representatives."""
    rng, d = np.random.default_rng(12), 96
    a, b, e = np.linalg.qr(rng.normal(size=(d, 3)))[0].T
    v = [unit(c + 0.04 * rng.normal(size=d)) for c in (a, b) for _ in range(60)] + [*unit(rng.normal(size=(300, d)))]
    v += [0.6 * a + 0.8 * e, 0.6 * b + 0.8 * e]
    rows = [("n", f"i{i}", i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    members, _, _ = similarity_clusters(spark.createDataFrame(rows, SCHEMA), link=0.5, width=d)
    assert {r.item_id: r.cluster_seq for r in members.collect()} == {f"i{i}": 0 for i in [*range(120), 420, 421]}


def test_greedy_determinant_is_greedy():
    rng = np.random.default_rng(4)
    b = rng.normal(size=(30, 12))
    k = b @ b.T + 0.1 * np.eye(30)
    got, gains = greedy_determinant(lambda i: k[i], np.diag(k), 6)
    chosen = []
    for _ in range(6):
        det = [np.linalg.slogdet(k[np.ix_(chosen + [i], chosen + [i])])[1] if i not in chosen else -np.inf for i in range(30)]
        chosen.append(int(np.argmax(det)))
    assert got.tolist() == chosen
    assert np.log(gains).sum() == pytest.approx(np.linalg.slogdet(k[np.ix_(chosen, chosen)])[1], rel=1e-4)


def test_varied_subset(log, rows):
    got = varied_subset(log, 12, chunk=64, fan_in=2, sample=50).collect()
    assert sorted(r.place for r in got) == list(range(1, 13)) and len({r.seq for r in got}) == 12
    alive = {r[2]: r for r in live(rows)}
    assert all(r.seq in alive for r in got)
    for i, a in enumerate(got):
        assert all(len(alive[a.seq][3]) != len(alive[b.seq][3]) or cosine(alive[a.seq][3], alive[b.seq][3]) < 0.97 for b in got[i + 1 :])
    assert len({r.namespace for r in got}) >= 5
    assert varied_subset(log.limit(0), 5).count() == 0 and varied_subset(log.filter("seq < 3"), 50).count() == 3


def test_varied_subset_weighs_a_rare_topic_by_all_rows(spark):
    rng, d = np.random.default_rng(6), 96
    centre = unit(rng.normal(size=d))
    v = [*unit(rng.normal(size=(1500, d))), *(unit(centre + 0.03 * rng.normal(size=d)) for _ in range(8))]
    rows = [("n", f"i{i}", i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    got = sorted(varied_subset(spark.createDataFrame(rows + rows[:3], SCHEMA), 3, sample=20).collect())
    assert got[0].seq >= 1500 and got[0].gain == pytest.approx(1, abs=1e-3)
    assert all(r.seq < 1500 and r.gain < 0.5 for r in got[1:])


def test_varied_subset_doesn_t_depend_on_the_sample(spark):
    """A row whose only neighbours are three of an arm that a large topic settles, and one with a redelivered neighbour."""
    rng, d = np.random.default_rng(14), 96
    c = np.eye(d)
    v = [c[1], *(unit(0.75 * c[0] + 0.66 * c[1] + 0.01 * rng.normal(size=d)) for _ in range(3))]
    v += [unit(c[0] + 0.02 * rng.normal(size=d)) for _ in range(80)] + [*unit(rng.normal(size=(40, d)))]
    v += [c[2], unit(c[2] + 0.5 * c[3])]
    rows = [("n", f"i{i}", i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    log = spark.createDataFrame(rows + 3 * rows[-1:], SCHEMA)
    near = unit(np.array(v)) @ unit(np.array(v)).T >= 0.5
    got = {n: {r.seq: (r.place, r.gain) for r in varied_subset(log, len(rows), sample=n).collect()} for n in (20, 4096)}
    assert near[0].sum() == 4 and near[-1].sum() == 2 and got[20][0] == (1, pytest.approx(1))
    assert set(got[20]) == set(got[4096]) == set(range(len(rows)))
    assert all(got[20][s] == (place, pytest.approx(gain, abs=1e-4)) for s, (place, gain) in got[4096].items())
    pair = spark.createDataFrame(3 * [rows[-1]] + [rows[-2]], SCHEMA)
    assert max(r.gain for r in varied_subset(pair, 1).collect()) == pytest.approx(0.8**2, abs=1e-3)


def test_varied_subset_takes_a_sharpness_for_all_dimensions(spark):
    rows = [("n", f"i{i}", i, [1.0, 0.0, 0.0]) if i else ("m", "i0", 0, [0.0, 1.0, 0.0]) for i in range(2)]
    gain = [min(r.gain for r in varied_subset(spark.createDataFrame(rows, SCHEMA), 2, sharpness=s, sample=0, lonely=1.0).collect()) for s in (1.0, 4.0)]
    assert gain == pytest.approx([1 - (0.7 * np.exp(-s)) ** 2 for s in (1, 4)], abs=1e-5)
