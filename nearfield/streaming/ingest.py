"""Streaming ingestion: operations appended to a log, each micro-batch published as one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.index import fold
from nearfield.schema import OPS
from nearfield.sources.store import SnapshotStore


def ingest(spark: SparkSession, source: str, log: str, store: SnapshotStore, checkpoint: str) -> StreamingQuery:
    """Read operations (Parquet files of OPS) as they arrive, append them to the log and publish the state.

    A micro-batch is written under its own id, overwriting what a failed attempt left, so a replay changes nothing. Only
    the cells of the keys and namespaces it names are folded again: from what they hold, or, where an operation is older
    than some that were applied already, from the log of these cells.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        new = spark.read.schema(OPS).parquet(f"{log}/batch={batch_id}")
        first, last = new.agg(F.min("op_seq"), F.max("op_seq")).first()
        if first is None:
            return
        version = store.version()
        shape = store.manifest(version)
        cells = set(store.cells_of(new.filter("op <> 'purge'").select("namespace", "item_id")))
        purged = new.filter("op = 'purge'").select(F.pmod(F.xxhash64("namespace"), F.lit(shape["n_buckets"]))).distinct().collect()
        cells |= {r[0] * shape["n_parts"] + p for r in purged for p in range(shape["n_parts"])}
        if first > shape.get("top", -1):
            # what the cells hold counts as written before the batch, each row at its position
            held = store.read(cells=cells).select(F.col("seq").alias("op_seq"), F.lit("upsert").alias("op"), "namespace", "item_id", "vector")
            ops = held.unionByName(new)
        else:
            every = spark.read.schema(OPS).parquet(log).select("op_seq", "op", "namespace", "item_id", "vector")
            wanted = spark.createDataFrame([(c,) for c in sorted(cells)], "c int")
            ops = every.join(F.broadcast(wanted), (store.cell(F.col("namespace"), F.col("item_id"), shape) == F.col("c")) & (F.col("op") != "purge"), "left_semi").unionByName(every.filter("op = 'purge'"))
        state = fold(ops).select("namespace", "item_id", "vector", F.size("vector").alias("dim"), F.current_timestamp().alias("created_at"), "seq")
        store.replace(cells, state, version, last)

    ops = spark.readStream.schema(OPS).parquet(source)
    return ops.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Operations by window and kind, with a watermark for late ones; works on streams and tables alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
