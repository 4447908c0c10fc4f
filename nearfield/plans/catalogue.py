"""The core queries; their SQL is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import tokens as tok
from nearfield.functions import vector as vec
from nearfield.functions.codec import decode_blob, encode_vector
from nearfield.operators import backfill as bf
from nearfield.operators import index as ix
from nearfield.operators import requests as rq
from nearfield.operators import skew
from nearfield.operators.providers import CATALOGUE
from nearfield.operators.search import matrix_blocks, ranked, search, search_batch, search_blocks, search_resident
from nearfield.plans import oracle
from nearfield.session import scratch_dir
from nearfield.sources.store import SnapshotStore
from nearfield.sources.tables import table
from nearfield.streaming.ingest import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def small_index(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings table as an index: a namespace per label."""
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("ns"), "label").alias("namespace"), F.concat(F.lit("v"), "vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("seq"))


def index(spark: SparkSession, d: str) -> DataFrame:
    return ix.upsert(table(spark, d, "vectors"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    """The probe table's vectors as queries."""
    p = table(spark, d, "knn_probes")
    keys = F.broadcast(p) if p.count() <= 100_000 else p
    # counted, sent and searched: derived once
    return index(spark, d).join(keys, ix.KEY).select(F.col("probe_id").cast("bigint").alias("qid"), "namespace", "vector").persist()


def components(v: Column, key: str, digits: int = 5) -> list[Column]:
    """A row per component of a vector: its position from 0 and its rounded value."""
    return [F.col(key), F.posexplode(F.transform(v, lambda x: F.nanvl(F.round(x, digits) + F.lit(0.0), F.lit(None)))).alias("pos", "value")]


# search


@query
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "embeddings").filter("vec_id = 0").first()
    return search(small_index(spark, d), f"ns{first.label}", list(first.embedding), 10, 0.0)


@query
def search_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return search_batch(index(spark, d), probes(spark, d), 10, 0.3)


@query
def search_kernel(spark: SparkSession, d: str) -> DataFrame:
    return search_blocks(index(spark, d), probes(spark, d), 10, 0.3)


@query
def search_matrix(spark: SparkSession, d: str) -> DataFrame:
    return search_resident(matrix_blocks(index(spark, d)), probes(spark, d), 10, 0.3)


@query
def search_threshold(spark: SparkSession, d: str) -> DataFrame:
    i = small_index(spark, d)
    return search_batch(i, i.select(F.col("seq").alias("qid"), "namespace", "vector"), 500, 0.8)


@query
def search_limit_clamp(spark: SparkSession, d: str) -> DataFrame:
    return search_blocks(index(spark, d), probes(spark, d), 1000, -1.0)


@query
def search_mixed_dims(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    return search_blocks(i, i.filter("size(vector) = 64").select(F.col("seq").alias("qid"), "namespace", "vector"), 10, 0.0)


@query
def dot_scores(spark: SparkSession, d: str) -> DataFrame:
    i = small_index(spark, d)
    other = i.select("namespace", F.col("seq").alias("b"), F.col("vector").alias("w"))
    return i.join(other, "namespace").select(F.col("seq").alias("a"), "b", vec.score(vec.dot(F.col("vector"), F.col("w"))).alias("score"))


# index


@query
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).select("namespace", "item_id", F.size("vector").alias("dim"), "seq", "last_seq")


@query
def index_load(spark: SparkSession, d: str) -> DataFrame:
    """Published as a snapshot and read back."""
    import uuid

    store = SnapshotStore(spark, f"{scratch_dir(spark)}/nearfield-index-{uuid.uuid4().hex}", 16)
    store.publish(index(spark, d).select("namespace", "item_id", "vector", F.size("vector").alias("dim"), "created_at", "seq"))
    return store.read().select("namespace", "item_id", "dim", "seq")


@query
def index_count_dups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vectors").groupBy("namespace").agg(F.count(F.lit(1)).alias("n_processed"), F.countDistinct("item_id").alias("n_items"))


@query
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return ix.stats(index(spark, d))


@query
def dim_groups(spark: SparkSession, d: str) -> DataFrame:
    return ix.dim_groups(index(spark, d))


@query
def remove(spark: SparkSession, d: str) -> DataFrame:
    return ix.remove(index(spark, d), table(spark, d, "knn_probes")).select("namespace", "item_id", "seq")


@query
def remove_count(spark: SparkSession, d: str) -> DataFrame:
    return ix.remove_count(index(spark, d), table(spark, d, "knn_probes"))


@query
def purge(spark: SparkSession, d: str) -> DataFrame:
    return ix.purge(index(spark, d), "default").select("namespace", "item_id", "seq")


@query
def purge_count(spark: SparkSession, d: str) -> DataFrame:
    return ix.count_namespace(index(spark, d), "default").withColumnRenamed("n", "n_removed")


@query
def namespace_count(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d)
    out = None
    for ns in ("default", "docs:handbook", "", "no such namespace"):
        one = ix.count_namespace(i, ns).select(F.lit(ns).alias("namespace"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def operations(spark: SparkSession, d: str) -> DataFrame:
    """The events table read as operations on an index."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "remove").when((F.col("event_type") == "purchase") & (F.col("event_id") % 97 == 0), "purge").otherwise("upsert")
    return e.select(F.col("event_id").alias("op_seq"), op.alias("op"), F.concat(F.lit("ns"), F.col("user_id") % 5).alias("namespace"), F.concat(F.lit("i"), F.col("event_id") % 211).alias("item_id"), F.array(F.col("value").cast("float")).alias("vector"))


@query
def oplog_fold(spark: SparkSession, d: str) -> DataFrame:
    return ix.fold(operations(spark, d)).select("namespace", "item_id", "seq", F.round(F.col("vector")[0].cast("double"), 3).alias("value"))


@query
def oplog_removed(spark: SparkSession, d: str) -> DataFrame:
    return ix.removed_counts(operations(spark, d))


# vector arithmetic


@query
def l2_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vectors").select(*components(vec.l2_guard(F.col("vector")), "seq"))


@query
def l2_clip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vectors").select(*components(vec.l2_clip(F.col("vector")), "seq"))


def token_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 64 components of each embedding as 8 token vectors of 8, of which label + 1 are real."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, 8))
    return table(spark, d, "embeddings").select("vec_id", tokens.alias("tokens"), F.least(F.col("label") + 1, F.lit(8)).alias("n"))


@query
def pool_mean(spark: SparkSession, d: str) -> DataFrame:
    return token_vectors(spark, d).select(*components(vec.pool_mean(F.col("tokens"), F.col("n")), "vec_id"))


@query
def pool_cls(spark: SparkSession, d: str) -> DataFrame:
    return token_vectors(spark, d).select(*components(vec.doubles(vec.pool_cls(F.col("tokens"))), "vec_id"))


@query
def pool_last(spark: SparkSession, d: str) -> DataFrame:
    return token_vectors(spark, d).select(*components(vec.doubles(vec.pool_last(F.col("tokens"), F.col("n"))), "vec_id"))


@query
def padding_invariance(spark: SparkSession, d: str) -> DataFrame:
    """Pooled over tokens padded to 8 and to 32 vectors: the largest difference, and the pooled vector's norm."""
    t = token_vectors(spark, d)
    zero = F.array_repeat(F.lit(0.0).cast("float"), 8)
    real = F.slice("tokens", F.lit(1), F.col("n"))
    pooled = [vec.pool_mean(F.concat(real, F.array_repeat(zero, F.lit(size) - F.col("n"))), F.col("n")) for size in (8, 32)]
    apart = F.array_max(F.zip_with(*pooled, lambda x, y: F.abs(x - y)))
    return t.select("vec_id", (apart < 1e-5).alias("same"), F.round(vec.norm(pooled[1]), 5).alias("norm"))


# tokens


def token_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.split("text", " "), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("bigint"))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "namespace", ids.alias("ids"))


@query
def truncate(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(spark, d).select("doc_id", tok.truncate(F.col("ids"), 512).alias("input_ids"))


@query
def pad_longest(spark: SparkSession, d: str) -> DataFrame:
    return tok.pad_longest(token_ids(spark, d), "ids", "namespace", 0, 512).select("doc_id", "input_ids", "attention_mask", "token_type_ids")


@query
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """The non-zero cells of each document's feature-hashed vector."""
    return hashed_cells(spark, d).select("doc_id", "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("value"))


def hashed_cells(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "source", F.explode(tok.hashed_terms(F.col("text"))).alias("t"))
    cells = words.groupBy("doc_id", "source", "t.bucket").agg(F.sum("t.sign").alias("n")).filter("n <> 0")
    norms = cells.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return cells.join(norms, "doc_id")


@query
def search_text(spark: SparkSession, d: str) -> DataFrame:
    """Glossary entries as queries against the documents of their namespace."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "namespace", "source", tok.hash_counts(F.col("text")).alias("n")).withColumn("norm", vec.norm(F.col("n")))
    asked = docs.filter("source = 'glossary'").select(F.col("doc_id").alias("qid"), F.col("namespace").alias("ns"), F.col("n").alias("m"), F.col("norm").alias("q_norm"))
    pairs = docs.join(asked, F.col("namespace").eqNullSafe(F.col("ns")))
    scored = pairs.select("qid", F.col("doc_id").cast("string").alias("item_id"), F.col("doc_id").alias("seq"), (vec.dot(F.col("n"), F.col("m")) / F.nullif(F.col("q_norm") * F.col("norm"), F.lit(0.0))).alias("raw"))
    return ranked(scored.filter("raw IS NOT NULL"), 5, 0.3)


# migration


def stores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "memories"), table(spark, d, "episodes")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("namespace", "item_id", "dim", F.md5(encode_vector("vector")).alias("digest"))


@query
def backfill(spark: SparkSession, d: str) -> DataFrame:
    return _shown(bf.backfill(*stores(spark, d)))


@query
def backfill_agent(spark: SparkSession, d: str) -> DataFrame:
    return _shown(bf.backfill(*stores(spark, d), agent_id="lantern-desk"))


@query
def backfill_expect_dim(spark: SparkSession, d: str) -> DataFrame:
    return _shown(bf.backfill(*stores(spark, d), expect_dim=128))


@query
def backfill_malformed(spark: SparkSession, d: str) -> DataFrame:
    rows = bf.candidates(*stores(spark, d))
    bad = rows.filter("octet_length(embedding) = 0 OR octet_length(embedding) % 4 <> 0")
    return bad.select("namespace", "item_id", F.octet_length("embedding").alias("n_bytes"))


@query
def backfill_summary(spark: SparkSession, d: str) -> DataFrame:
    return bf.summary(*stores(spark, d), expect_dim=128)


@query
def blob_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors").withColumn("blob", encode_vector("vector"))
    same = F.coalesce(decode_blob("blob"), F.array().cast("array<float>")).eqNullSafe(F.col("vector"))
    return v.select("seq", F.octet_length("blob").alias("n_bytes"), same.alias("same"))


# requests


@query
def request_validate(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for endpoint in ("embed", "index", "search", "remove", "purge"):
        bodies = spark.createDataFrame([(i, b) for i, (e, b) in enumerate(oracle.BODIES) if e == endpoint], "case_id int, body string")
        one = bodies.select("case_id", F.lit(endpoint).alias("endpoint"), rq.verdict(endpoint, F.col("body")).alias("v")).select("case_id", "endpoint", "v.status", "v.error")
        out = one if out is None else out.unionByName(one)
    return out


@query
def tool_validate(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for tool in ("embed", "index", "search", "remove", "purge", "other"):
        calls = spark.createDataFrame([(i, b) for i, (t, b) in enumerate(oracle.CALLS) if t == tool], "case_id int, arguments string")
        one = calls.select("case_id", F.lit(tool).alias("tool"), rq.tool_error(tool, F.col("arguments")).alias("error"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def embed_validate(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embed_requests").distinct().select("request_id", rq.texts_verdict(F.col("texts")).alias("v"))
    return v.groupBy("v.status", "v.error").agg(F.countDistinct("request_id").alias("n"))


@query
def auth_decision(spark: SparkSession, d: str) -> DataFrame:
    h = spark.createDataFrame([(i, x) for i, x in enumerate(oracle.HEADERS)], "case_id int, header string")
    return h.select("case_id", rq.auth_status(F.col("header"), "s3cret-token").alias("status"))


@query
def provider_catalog(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(s.key, s.dims, s.pooling, s.normalise) for s in CATALOGUE.values()], "provider string, dims int, pooling string, normalise string")


# skew and streams


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(table(spark, d, "vectors"), "namespace", 0.02).select("namespace")


@query
def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    p = skew.namespace_profiles(table(spark, d, "vectors"))
    n = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return p.select("namespace", "dim", "n_rows", "n_live", "n_usable", F.round(n, 6).alias("mean_norm"), (F.round(F.get("mean", F.lit(0)), 6) + F.lit(0.0)).alias("mean_0"), "last_seq", "last_item_id")


@query
def p6_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean vectors, a row per component."""
    p = skew.namespace_profiles(table(spark, d, "vectors")).filter("mean IS NOT NULL")
    return p.select("namespace", "dim", F.posexplode("mean").alias("pos", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming aggregate."""
    return windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in QUERIES}
