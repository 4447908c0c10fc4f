"""Migration of stored embeddings into the index, verbatim."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.codec import decode_blob
from nearfield.operators.index import stats


class Destination(Protocol):
    """An index that takes vectors."""

    def upsert_vectors(self, rows: DataFrame) -> int: ...

    def load(self) -> DataFrame: ...


# fixed values: how the migrated keys are written
NAMESPACE_PREFIX = "cpersona:"
NO_AGENT = "None"
ITEM_PREFIXES = ("mem", "ep")


def candidates(memories: DataFrame, episodes: DataFrame | None, agent_id: str | None = None) -> DataFrame:
    """namespace, item_id, embedding of the rows with an embedding, memories before episodes; an empty agent means all.

    Raises ValueError if memories lacks the columns id, agent_id, embedding.
    """
    if missing := {"id", "agent_id", "embedding"} - set(memories.columns):
        raise ValueError(f"not a memory store: no {', '.join(sorted(missing))}")
    parts = []
    for rank, (prefix, t) in enumerate(zip(ITEM_PREFIXES, (memories, episodes), strict=True)):
        if t is not None:
            parts.append(t.select(F.lit(rank).alias("source_rank"), F.lit(prefix).alias("prefix"), "id", "agent_id", "embedding"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.filter("embedding IS NOT NULL")
    if agent_id:
        rows = rows.filter(F.col("agent_id") == agent_id)
    key = F.concat(F.lit(NAMESPACE_PREFIX), F.coalesce("agent_id", F.lit(NO_AGENT)))
    return rows.select("source_rank", key.alias("namespace"), F.concat("prefix", F.lit(":"), F.col("id").cast("string")).alias("item_id"), "embedding")


def well_formed(rows: DataFrame) -> DataFrame:
    """Without empty blobs and those whose length isn't a multiple of 4; such rows aren't counted anywhere."""
    return rows.filter("octet_length(embedding) > 0 AND octet_length(embedding) % 4 = 0")


def backfill(memories: DataFrame, episodes: DataFrame | None, agent_id: str | None = None, expect_dim: int | None = None) -> DataFrame:
    """namespace, item_id, embedding, vector, dim to upsert. Of repeated keys the greatest blob, byte by byte, is taken:
    a table has no order of writing that could decide."""
    rows = well_formed(candidates(memories, episodes, agent_id))
    if expect_dim:
        rows = rows.filter(F.octet_length("embedding") == expect_dim * 4)
    kept = rows.groupBy("namespace", "item_id").agg(F.max("embedding").alias("embedding"))
    return kept.select("namespace", "item_id", "embedding", decode_blob("embedding").alias("vector"), (F.octet_length("embedding") / 4).cast("int").alias("dim"))


def summary(memories: DataFrame, episodes: DataFrame | None, agent_id: str | None = None, expect_dim: int | None = None) -> DataFrame:
    """One row, also the dry run: rows read, migrated and skipped for their dimension, and what the destination would hold."""
    rows = well_formed(candidates(memories, episodes, agent_id))
    fits = F.octet_length("embedding") == expect_dim * 4 if expect_dim else F.lit(True)
    per_key = rows.withColumn("fits", fits).groupBy("namespace", "item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("ok"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("n_migrated"),
        F.coalesce(F.sum(F.col("n") - F.col("ok")), F.lit(0)).alias("n_skipped"),
        F.count_if(F.col("ok") > 0).alias("n_vectors"),
        F.countDistinct(F.when(F.col("ok") > 0, F.col("namespace"))).alias("n_namespaces"),
    )


@dataclass(frozen=True)
class Migration:
    """What a migration read, skipped and wrote; code is 0 unless there was no store to read. total and namespaces: of the
    whole index afterwards, None where nothing was written."""

    code: int
    message: str
    n_rows: int = 0
    n_migrated: int = 0
    n_skipped: int = 0
    n_total: int | None = None
    n_namespaces: int | None = None


def migrate(index: Destination, memories: DataFrame, episodes: DataFrame | None, agent_id: str | None = None, expect_dim: int | None = None, dry_run: bool = False) -> Migration:
    """Upsert the stored embeddings into the index, verbatim.

    A table that is no memory store gives code 1; a dry run and an empty selection write nothing. Vectors of another
    dimension than expect_dim are skipped and counted.
    """
    try:
        read = summary(memories, episodes, agent_id, expect_dim).first()
    except ValueError as e:
        return Migration(1, str(e))
    counts = (read.n_rows, read.n_migrated, read.n_skipped)
    if dry_run:
        return Migration(0, "dry run: nothing written", *counts)
    if not read.n_migrated:
        return Migration(0, "nothing to migrate", *counts)
    index.upsert_vectors(backfill(memories, episodes, agent_id, expect_dim).select("namespace", "item_id", "vector"))
    now = stats(index.load()).first()
    return Migration(0, "done", *counts, now.n_vectors, now.n_namespaces)
