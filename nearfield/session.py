"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; an existing session is reused."""
    b = SparkSession.builder.appName("nearfield").config(map=DEFAULTS | conf)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return reachable(b.getOrCreate())


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did, whatever the working directory is.

    On a cluster whose machines don't share that path, send the package with --py-files.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset (local tests) a folder of this machine is set instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(_delete, spark, named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the scratch folder and read it back: cuts lineage and survives lost executors."""
    return persist_tables([df], name)


def persist_tables(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Write DataFrames of one schema after one another, each when it is asked for, and read them back as one."""
    path, spark, schema = "", None, None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{scratch_dir(spark)}/nearfield-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").mode("append").parquet(path)
    if spark is None:
        raise ValueError("no part to write")
    atexit.register(_delete, spark, path)
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a DataFrame made by persist_table, once nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _delete(df.sparkSession, f)
