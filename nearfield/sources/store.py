"""The index on disk: immutable Parquet cells, and versions that name the file of each cell."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.schema import INDEX

#: Buckets of namespaces, and parts of a namespace by item; together the cells of an index. For large ones choose more.
N_BUCKETS, N_PARTS = 64, 8


class SnapshotStore:
    """Readers see the cells that the latest version names; a writer publishes a new version when its files are complete.

    A row's cell is a hash of its namespace and one of its item, so a search reads the parts of one namespace, a write
    replaces the cells of the keys it touches and no others, and a namespace that holds most rows is spread over its
    parts. Within a cell rows are sorted by namespace and seq, which lets scans skip row groups. Namespaces are arbitrary
    strings and no partition column. A version also holds the highest seq, so appending needs no scan.
    """

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = N_BUCKETS, n_parts: int = N_PARTS):
        self.spark, self.path, self.n, self.parts = spark, path.rstrip("/"), n_buckets, n_parts
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _pointers(self) -> list[int]:
        if not self.fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at(""))]
        return sorted(int(n[8:]) for n in names if n.startswith("current-"))

    def version(self) -> int:
        """0 if nothing was published yet. A version is created whole or not at all, by a rename."""
        return (self._pointers() or [0])[-1]

    def manifest(self, version: int | None = None) -> dict:
        """cells: folder by cell; top: the highest seq, -1 in an empty index; n_buckets, n_parts."""
        v = self.version() if version is None else version
        if not v:
            return {"cells": {}, "top": -1, "n_buckets": self.n, "n_parts": self.parts}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/current-{v}").first().value)

    def cell(self, namespace: Column, item_id: Column, shape: dict | None = None) -> Column:
        """The cell of a key; an index keeps the shape it was first written with."""
        n, parts = (shape["n_buckets"], shape["n_parts"]) if shape else (self.n, self.parts)
        return (F.pmod(F.xxhash64(namespace), F.lit(n)) * parts + F.pmod(F.xxhash64(item_id, F.lit(1)), F.lit(parts))).cast("int")

    def cells_of(self, keys: DataFrame) -> list[int]:
        """The cells of keys (namespace, item_id), at most as many as the index has."""
        shape = self.manifest()
        return sorted(r[0] for r in keys.select(self.cell(F.col("namespace"), F.col("item_id"), shape)).distinct().collect())

    def cells_of_namespace(self, namespace: str) -> list[int]:
        shape = self.manifest()
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(namespace)), F.lit(shape["n_buckets"]))).first()[0]
        return [bucket * shape["n_parts"] + p for p in range(shape["n_parts"])]

    def read(self, namespace: str | None = None, cells: Iterable[int] | None = None) -> DataFrame:
        """The index, or the rows of a namespace, or those of some cells."""
        files = self.manifest()["cells"]
        if namespace is not None:
            cells = self.cells_of_namespace(namespace)
        wanted = sorted(set(files.values()) if cells is None else {files[str(c)] for c in cells if str(c) in files})
        if not wanted:
            return self.spark.createDataFrame([], INDEX)
        df = self.spark.read.schema(INDEX).parquet(*(f"{self.path}/{f}" for f in wanted))
        return df if namespace is None else df.filter(F.col("namespace") == namespace)

    def publish(self, index: DataFrame, expected: int | None = None) -> int:
        """Write the whole index and publish it; returns the new version. Fails if another writer was faster."""
        return self.replace(None, index, expected)

    def replace(self, cells: Iterable[int] | None, rows: DataFrame, expected: int | None = None, top: int | None = None) -> int:
        """Publish a version in which the given cells (None: all) hold `rows` and all others what they held.

        top: a bound of the highest seq; by default it is read off the files written.
        """
        base = self.version() if expected is None else expected
        if self.version() != base:
            raise RuntimeError(f"version {base} isn't the latest any more")
        old, snap = self.manifest(base), f"snap-{uuid.uuid4().hex}"
        if cells is None:
            old = {**old, "cells": {}, "top": -1, "n_buckets": self.n, "n_parts": self.parts}
        placed = rows.withColumn("cell", self.cell(F.col("namespace"), F.col("item_id"), old))
        placed.repartition("cell").sortWithinPartitions("cell", "namespace", "seq").write.partitionBy("cell").parquet(f"{self.path}/{snap}")
        kept = {c: f for c, f in old["cells"].items() if cells is not None and int(c) not in set(cells)}
        written = [s.getPath().getName() for s in self.fs.listStatus(self._at(snap)) if s.isDirectory()]
        new = {n[5:]: f"{snap}/{n}" for n in written if n.startswith("cell=")}
        if top is None and new:
            top = self.spark.read.parquet(*(f"{self.path}/{f}" for f in new.values())).agg(F.max("seq")).first()[0]
        manifest = {**old, "cells": kept | new, "top": max(old["top"], -1 if top is None else top)}
        out = self.fs.create(self._at(f"pending-{snap}"), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.version() != base or not self.fs.rename(self._at(f"pending-{snap}"), self._at(f"current-{base + 1}")):
            raise RuntimeError(f"version {base} isn't the latest any more")
        return base + 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last `keep` versions and the files that none of the kept ones names; returns how many went."""
        every = self._pointers()
        old = every[:-keep] if keep else every
        used = {f.split("/")[0] for v in every[len(old) :] for f in self.manifest(v)["cells"].values()}
        for v in old:
            for snap in {f.split("/")[0] for f in self.manifest(v)["cells"].values()} - used:
                self.fs.delete(self._at(snap), True)
            self.fs.delete(self._at(f"current-{v}"), False)
        return len(old)
