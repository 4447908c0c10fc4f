"""The vector index as a pure function of its log of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.live import live_rows

KEY = ["namespace", "item_id"]


def upsert(log: DataFrame) -> DataFrame:
    """State after the upserts of a log (namespace, item_id, vector, seq, ...): the last vector of a key at the position of
    its first insert. A row without seq is left out.

    Only the rows of keys with several versions are moved, by their unique seq: a key with very many versions costs no
    task more than others.
    """
    last = live_rows(log, KEY, versions=True).drop("n_versions")
    return last.withColumnRenamed("seq", "last_seq").withColumnRenamed("first_seq", "seq")


def fold(ops: DataFrame) -> DataFrame:
    """State after upserts, removes and purges: op_seq, op, namespace, item_id, vector -> namespace, item_id, vector, seq.

    A key's upserts count from its last remove or its namespace's last purge on; the last vector wins, seq is the position
    of the first. A remove and re-add so moves an item to the end. Purges are aggregated per namespace before the join,
    and the aggregate of a key holds one vector at a time.
    """
    up = ops.filter("op = 'upsert'")
    removed = ops.filter("op = 'remove'").groupBy(*KEY).agg(F.max("op_seq").alias("removed_at"))
    purged = ops.filter("op = 'purge'").groupBy("namespace").agg(F.max("op_seq").alias("purged_at"))
    alive = up.join(removed, KEY, "left").join(purged, "namespace", "left").filter(F.col("op_seq") > F.greatest(F.coalesce("removed_at", F.lit(-1)), F.coalesce("purged_at", F.lit(-1))))
    return alive.groupBy(*KEY).agg(F.max_by("vector", "op_seq").alias("vector"), F.min("op_seq").alias("seq"))


def removed_counts(ops: DataFrame, slices: int = 1024) -> DataFrame:
    """op_seq, n_removed of each remove and purge: how many live items it took away.

    A key lives from an upsert to the next operation on it. The first purge of its namespace in that time took it, or else
    the remove that ends it. The first purge after an upsert is looked for in the upsert's own slice of the operations,
    and, where there is none, in a table of the next purge after each slice; so neither a key nor a namespace nor the
    number of purges makes a task large.
    """
    span = ops.agg(F.min("op_seq").alias("low"), F.max("op_seq").alias("high")).first()
    width = max(1, ((span.high or 0) - (span.low or 0)) // slices + 1)
    place = F.floor((F.col("op_seq") - F.lit(span.low or 0)) / width).cast("int")
    after = F.lead("op_seq").over(Window.partitionBy(*KEY).orderBy("op_seq"))
    after_op = F.lead("op").over(Window.partitionBy(*KEY).orderBy("op_seq"))
    lives = ops.filter("op <> 'purge'").select("op_seq", "op", *KEY, after.alias("end_seq"), after_op.alias("end_op")).filter("op = 'upsert'")
    purges = ops.filter("op = 'purge'").select("op_seq", "op", "namespace")
    both = lives.select("op_seq", "op", "namespace", "end_seq", "end_op").unionByName(purges, allowMissingColumns=True).withColumn("slice", place)
    ahead = Window.partitionBy("namespace", "slice").orderBy("op_seq").rowsBetween(1, Window.unboundedFollowing)
    near = both.withColumn("purge_seq", F.min(F.when(F.col("op") == "purge", F.col("op_seq"))).over(ahead)).filter("op = 'upsert'")
    first = purges.groupBy("namespace", place.alias("slice")).agg(F.min("op_seq").alias("first"))
    every = purges.select("namespace").distinct().select("namespace", F.explode(F.sequence(F.lit(0), F.lit(slices))).alias("slice")).join(first, ["namespace", "slice"], "left")
    later = Window.partitionBy("namespace").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)  # slices + 1 rows
    following = every.select(F.col("namespace").alias("_ns"), F.col("slice").alias("_slice"), F.min("first").over(later).alias("later_seq"))
    found = near.join(following, F.col("namespace").eqNullSafe(F.col("_ns")) & (F.col("slice") == F.col("_slice")), "left")
    purge_seq = F.coalesce("purge_seq", "later_seq")
    taken = F.when(purge_seq.isNotNull() & (F.col("end_seq").isNull() | (purge_seq < F.col("end_seq"))), purge_seq).when(F.col("end_op") == "remove", F.col("end_seq"))
    n = found.select(taken.alias("op_seq")).filter("op_seq IS NOT NULL").groupBy("op_seq").agg(F.count(F.lit(1)).alias("n"))
    return ops.filter("op <> 'upsert'").select("op_seq").join(n, "op_seq", "left").select("op_seq", F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"))


def remove(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The index without the given keys (namespace, item_id)."""
    return index.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def remove_count(index: DataFrame, keys: DataFrame) -> DataFrame:
    """One row: n_removed, the keys that exist; repeated keys count once."""
    return index.join(keys.select(*KEY).distinct(), KEY, "left_semi").agg(F.count(F.lit(1)).alias("n_removed"))


def purge(index: DataFrame, namespace: str) -> DataFrame:
    return index.filter(~F.col("namespace").eqNullSafe(namespace))


def count_namespace(index: DataFrame, namespace: str) -> DataFrame:
    """One row, 0 for an unknown namespace."""
    return index.filter(F.col("namespace").eqNullSafe(namespace)).agg(F.count(F.lit(1)).alias("n"))


def stats(index: DataFrame) -> DataFrame:
    """One row: vectors and namespaces, both exact."""
    return index.agg(F.count(F.lit(1)).alias("n_vectors"), F.countDistinct("namespace").alias("n_namespaces"))


def dim_groups(index: DataFrame, dim: Column | None = None) -> DataFrame:
    """Vectors per namespace and dimension: what the search treats as one matrix."""
    return index.groupBy("namespace", (dim if dim is not None else F.size("vector")).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
