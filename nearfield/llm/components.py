"""Connected components of a graph given by its links, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import drop_table, persist_table


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b) of longs -> (node, component): component is the smallest node of the chain of links.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest node seen; the graph ends as
    stars, after a number of rounds that grows with the logarithm of the longest chain. A node's neighbours are never
    gathered: only their minimum is. Rows of a null end and loops are left out. A graph that isn't finished after
    max_rounds is an error, not a result.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        moved = both.join(low, "a")
        if large:
            return moved.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        return moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()

    edges = persist_table(links.select("a", "b").dropna().filter("a <> b").distinct(), "links")
    sign = None
    for _ in range(max_rounds):
        new = persist_table(star(star(edges, True), False), "stars")
        now = new.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        drop_table(edges)
        edges = new
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"links form chains that {max_rounds} rounds don't resolve")
    stars = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as one link a node to the smallest node of its chain."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.unique(np.sort(inv.reshape(2, -1), axis=0), axis=1) if len(a) else (inv[:0], inv[:0])
    low = np.arange(len(nodes))
    while len(x):
        new, least = low.copy(), np.minimum(low[x], low[y])
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    away = low != np.arange(len(nodes))
    return nodes[away], nodes[low[away]]
