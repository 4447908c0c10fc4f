"""Splitting large namespaces into blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.live import live_keys, live_rows

#: So many namespaces at most are looked up in a broadcast table (under 2 MB); beyond it they are joined by shuffle.
MAX_BROADCAST_KEYS = 10_000
#: A key with more versions than this is reduced to its live row before vectors are moved.
MAX_VERSIONS = 1_000


def with_blocks(log: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """The log with `n_rows`, `n_blocks` of its namespace: ceil(keys / block_rows); and how many have several blocks.

    The lookup holds only namespaces above block_rows, so at most rows / block_rows of them. Versions of a key stay in
    the log unless some key has more than MAX_VERSIONS; then only live rows go on.
    """
    spark = log.sparkSession
    per_ns = live_keys(log).groupBy("namespace").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_versions").alias("v"))
    large = per_ns.filter((F.col("n_rows") > block_rows) | (F.col("v") > MAX_VERSIONS))
    rows = large.limit(MAX_BROADCAST_KEYS + 1).collect()
    if any(r.v > MAX_VERSIONS for r in rows):
        log = live_rows(log)
    n_large = sum(r.n_rows > block_rows for r in rows) if len(rows) <= MAX_BROADCAST_KEYS else large.count()
    large = large.select(F.col("namespace").alias("_ns"), "n_rows", F.ceil(F.col("n_rows") / block_rows).cast("int").alias("n_blocks"))
    if len(rows) <= MAX_BROADCAST_KEYS:
        large = F.broadcast(spark.createDataFrame([(r.namespace, r.n_rows, -(-r.n_rows // block_rows)) for r in rows], "_ns string, n_rows long, n_blocks int"))
    out = log.join(large, F.col("namespace").eqNullSafe(F.col("_ns")), "left").drop("_ns")
    out = out.withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), "n_blocks": F.coalesce("n_blocks", F.lit(1))})
    return out, n_large
