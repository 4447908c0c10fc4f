"""The index's interface: embed, index, search, remove, purge, count, over a snapshot store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.index import purge, remove, remove_count
from nearfield.operators.providers import embed
from nearfield.operators.search import MAX_BROADCAST_QUERIES, matrix_blocks, search, search_batch, search_resident
from nearfield.schema import LIMITS
from nearfield.sources.store import SnapshotStore


class VectorIndex:
    """Each write makes a new snapshot, so a reader never sees half of one; the last snapshot is cached by version."""

    def __init__(self, spark: SparkSession, path: str, provider: str = "hashing", **provider_args: object):
        self.spark, self.store, self.provider, self.args = spark, SnapshotStore(spark, path), provider, provider_args
        self._cached: tuple[int, DataFrame] | None = None
        self._matrices: tuple[int, DataFrame] | None = None

    def load(self) -> DataFrame:
        v = self.store.version()
        if self._cached is None or self._cached[0] != v:
            self.shutdown()
            self._cached = (v, self.store.read().persist())
        return self._cached[1]

    def embed(self, texts: DataFrame, text: str = "text") -> DataFrame:
        return texts.withColumn("vector", embed(F.col(text), self.provider, **self.args))

    def index(self, namespace: str, items: DataFrame) -> int:
        """items (id, text, and optionally pos for the order in the batch); returns the items processed, repeats included."""
        pos = F.col("pos") if "pos" in items.columns else F.monotonically_increasing_id()
        return self._upsert(self.embed(items.select(F.lit(namespace).alias("namespace"), F.col("id").cast("string").alias("item_id"), pos.alias("pos"), "text")))

    def upsert_vectors(self, rows: DataFrame) -> int:
        """rows (namespace, item_id, vector, and optionally pos) verbatim, as a migration does; returns their number. Of a
        repeated key the last row counts, by pos or else in the order the rows are read."""
        pos = F.col("pos") if "pos" in rows.columns else F.monotonically_increasing_id()
        return self._upsert(rows.select("namespace", "item_id", "vector", pos.alias("pos")))

    def _upsert(self, rows: DataFrame) -> int:
        """Replace the cells that the rows' keys lie in. A key that exists keeps its position, a new one takes the position
        of its first row after all others."""
        version = self.store.version()
        rows = rows.select("namespace", "item_id", "vector", "pos").persist()
        n = rows.count()
        if n:
            low, high = rows.agg(F.min("pos"), F.max("pos")).first()
            top = self.store.manifest(version)["top"]
            cells = self.store.cells_of(rows)
            old = self.store.read(cells=cells)
            fresh = rows.groupBy("namespace", "item_id").agg(F.max_by("vector", "pos").alias("vector"), (F.min("pos") - F.lit(low) + F.lit(top + 1)).alias("new_seq"))
            kept = old.join(fresh.select("namespace", "item_id"), ["namespace", "item_id"], "left_anti")
            now = fresh.join(old.select("namespace", "item_id", "seq"), ["namespace", "item_id"], "left").select("namespace", "item_id", "vector", F.size("vector").alias("dim"), F.current_timestamp().alias("created_at"), F.coalesce("seq", "new_seq").alias("seq"))
            self.store.replace(cells, kept.select(*now.columns).unionByName(now), version, top + 1 + high - low)
        rows.unpersist()
        return n

    def search(self, namespace: str, query: str, limit: int = LIMITS.default_results, min_similarity: float = LIMITS.default_similarity) -> DataFrame:
        """An unknown or empty namespace gives no row without asking the provider."""
        rows = self.store.read(namespace)
        vector = None
        if not rows.isEmpty():
            vector = self.embed(self.spark.createDataFrame([(query,)], "text string")).first().vector
        return search(rows, namespace, list(vector or []), limit, min_similarity)

    def search_many(self, queries: DataFrame, limit: int = LIMITS.default_results, min_similarity: float = LIMITS.default_similarity) -> DataFrame:
        """queries: qid, namespace, text; the snapshot's matrices stay resident until the next write."""
        asked = self.embed(queries)
        if asked.count() > MAX_BROADCAST_QUERIES:
            return search_batch(self.load(), asked, limit, min_similarity)
        v = self.store.version()
        if self._matrices is None or self._matrices[0] != v:
            if self._matrices:
                self._matrices[1].unpersist()
            self._matrices = (v, matrix_blocks(self.store.read()).persist())
        return search_resident(self._matrices[1], asked, limit, min_similarity)

    def remove(self, namespace: str, ids: list[str]) -> int:
        version = self.store.version()
        keys = self.spark.createDataFrame([(namespace, str(i)) for i in ids], "namespace string, item_id string")
        cells = self.store.cells_of(keys)
        old = self.store.read(cells=cells)
        n = remove_count(old, keys).first()[0]
        if n:
            self.store.replace(cells, remove(old, keys), version)
        return n

    def purge(self, namespace: str) -> int:
        version, n = self.store.version(), self.count(namespace)
        if n:
            cells = self.store.cells_of_namespace(namespace)
            self.store.replace(cells, purge(self.store.read(cells=cells), namespace), version)
        return n

    def count(self, namespace: str) -> int:
        return self.store.read(namespace).count()

    def shutdown(self) -> None:
        if self._matrices:
            self._matrices[1].unpersist()
            self._matrices = None
        if self._cached:
            self._cached[1].unpersist()
            self._cached = None
