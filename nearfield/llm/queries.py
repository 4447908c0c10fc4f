"""Queries over the operators of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.diverse import varied_subset
from nearfield.llm.encoding import restore_encoding
from nearfield.llm.mix import mixture
from nearfield.llm.mixture import similarity_clusters
from nearfield.llm.near_copies import near_copy_groups, near_copy_pairs
from nearfield.llm.neighbours import nearest
from nearfield.llm.pack import packed_windows, window_report
from nearfield.llm.split import split_elements
from nearfield.llm.tokens import POSITION_TOKENIZER
from nearfield.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the topics of at least 8 vectors, with the topic's smallest seq."""
    members, _, _ = similarity_clusters(table(spark, sf_dir, "vectors"))
    return members.select("namespace", "item_id", "cluster_seq")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each topic's size, number of namespaces and most typical items."""
    members, typical, _ = similarity_clusters(table(spark, sf_dir, "vectors"))
    size = members.groupBy("cluster_seq").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("namespace").alias("n_namespaces"))
    items = typical.filter("place <= 5").groupBy("cluster_seq").agg(F.array_sort(F.collect_list(F.struct("place", "namespace", "item_id"))).alias("typical"))
    return size.join(items, "cluster_seq", "left")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items of one namespace with a cosine of at least 0.97."""
    return near_copy_pairs(table(spark, sf_dir, "vectors"), 0.97)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item that has near copies: its group and number of links."""
    return near_copy_groups(table(spark, sf_dir, "vectors"), 0.97)


def p3_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256 items that cover the variety of the live usable vectors."""
    return varied_subset(table(spark, sf_dir, "vectors"), 256)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each probe."""
    vectors, probes = table(spark, sf_dir, "vectors"), table(spark, sf_dir, "knn_probes")
    keys = probes.select("namespace", "item_id").distinct()
    small = probes.count() <= 10_000
    asked = (F.broadcast(keys) if small else keys).withColumn("asked", F.lit(True))
    log = vectors.join(asked, ["namespace", "item_id"], "left")
    found = nearest(log, F.col("asked"), k=10, dims=(128,))
    of_query = log.filter("asked").select("namespace", F.col("item_id").alias("probe_item"), F.col("seq").alias("query_seq"))
    named = probes.withColumnRenamed("item_id", "probe_item").join(of_query, ["namespace", "probe_item"])
    return named.join(found, "query_seq").select("probe_id", F.col("place").cast("int").alias("place"), "item_id")


def p4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose seq is divisible by 20, against all rows."""
    return nearest(table(spark, sf_dir, "vectors"), F.col("seq") % 20 == 0, k=10)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that had to be split: those of more than 2,000 code points."""
    return split_elements(table(spark, sf_dir, "embed_requests")).select("request_id", "text_pos").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of those elements."""
    return split_elements(table(spark, sf_dir, "embed_requests"))


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a window of 2,048 tokens."""
    return packed_windows(table(spark, sf_dir, "documents"))


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with text, and whether its tokens lie in windows once each, in pieces without a gap, none overfull."""
    w = packed_windows(table(spark, sf_dir, "documents"))
    fill = w.groupBy("window_id").agg(F.sum("n_tokens").alias("fill"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("token_start")) - 1
    rows = w.join(fill, "window_id").withColumn("at", at)
    good = (F.col("fill") <= 2_048) & (F.col("piece") == F.col("at")) & (F.col("token_start") == F.col("at") * 2_048)
    return rows.groupBy("doc_id").agg(F.min(good.cast("int")).alias("is_whole"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source over all windows, and how far single windows are from it."""
    return window_report(packed_windows(table(spark, sf_dir, "documents")))


def p5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of more than 512 tokens in pieces of at most 512, the last 64 repeated."""
    return split_elements(table(spark, sf_dir, "embed_requests"), 512, 64, POSITION_TOKENIZER)


def p8_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target that some document has: whether no document is repeated too often and the share reached is reported."""
    report = p8_report(spark, sf_dir).filter("tokens_in > 0")
    copies = p8_mixture(spark, sf_dir).groupBy("source").agg(F.max("copy_no").alias("most"))
    both = report.join(copies, "source", "left")
    good = (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & (F.coalesce("most", F.lit(0)) == F.col("most_copies"))
    return both.select("source", "max_repeats", good.cast("int").alias("is_within"))


def p8_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares wanted and reached of a mixture of as many tokens as the documents have: scarce sources meet their caps."""
    docs = table(spark, sf_dir, "documents")
    return mixture(docs, table(spark, sf_dir, "source_targets"), as_large=1.0)[1]


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' copies in a mixture of the target shares."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares wanted and reached."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with wrongly decoded text."""
    return restore_encoding(table(spark, sf_dir, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with their text as far as it can be had."""
    return restore_encoding(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_groups, p3_varied, p4_found, p4_knn, p5_found, p5_pieces, p5_tokens, p7_windows, p7_placed, p7_report, p8_mixture, p8_report, p8_capped, p8_within, p9_found, p9_restored)}


# live usable rows, unit vectors in double precision
USABLE = """live AS (SELECT * FROM vectors QUALIFY row_number() OVER (PARTITION BY namespace, item_id ORDER BY seq DESC) = 1),
 w AS (SELECT namespace, item_id, seq, len(vector) AS dim, vector::DOUBLE[] AS v FROM live WHERE len(vector) > 0),
 u AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM w WHERE coalesce(isfinite(list_inner_product(v, v)) AND list_inner_product(v, v) > 0, false))"""
#: Clusters as the least seq that a chain of links leads to; so many links of a chain at most are followed.
CHAIN = 10
CLUSTERS = (
    f"""WITH {USABLE}, x AS MATERIALIZED (SELECT namespace, item_id, seq, CAST(list_transform(v, lambda y: y / norm) AS DOUBLE[128]) AS x FROM u WHERE dim = 128),
 e AS MATERIALIZED (SELECT a.seq AS a, b.seq AS b FROM x a JOIN x b ON array_inner_product(a.x, b.x) >= 0.5),
 l0 AS MATERIALIZED (SELECT a, min(b) AS l FROM e GROUP BY a)"""
    + "".join(f",\n l{i} AS MATERIALIZED (SELECT e.a, min(l) AS l FROM e JOIN l{i - 1} ON l{i - 1}.a = e.b GROUP BY e.a)" for i in range(1, CHAIN))
    + f",\n c AS (SELECT namespace, item_id, l, count(*) OVER (PARTITION BY l) AS n FROM x JOIN l{CHAIN - 1} ON a = seq)"
)
SOURCE = r"regexp_replace(lower(trim({}, ' ')), '[\s\-]+', '_', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": CLUSTERS + " SELECT namespace, item_id, l AS cluster_seq FROM c WHERE n >= 8",
        "p2_found": f"""WITH {USABLE} SELECT a.namespace, a.item_id AS item_a, b.item_id AS item_b FROM u a JOIN u b ON a.namespace = b.namespace AND a.dim = b.dim AND a.item_id < b.item_id
WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.97""",
        "p4_found": f"""WITH {USABLE}, s AS (SELECT p.probe_id, b.item_id, b.seq, list_inner_product(a.v, b.v) / (a.norm * b.norm) AS c
 FROM knn_probes p JOIN u a ON a.namespace = p.namespace AND a.item_id = p.item_id JOIN u b ON b.namespace = a.namespace AND b.dim = a.dim AND b.seq <> a.seq WHERE a.dim = 128)
SELECT probe_id, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY c DESC, seq) AS INTEGER) AS place, item_id FROM s QUALIFY place <= 10""",
        "p5_found": "SELECT DISTINCT request_id, CAST(text_pos - 1 AS INTEGER) AS text_pos FROM (SELECT request_id, generate_subscripts(texts, 1) AS text_pos, unnest(texts) AS t FROM embed_requests) WHERE length(t) > 2000",
        # invariants: each text's tokens are placed once and whole; caps hold
        "p7_placed": "SELECT doc_id, 1 AS is_whole FROM documents WHERE text <> ''",
        "p8_within": f"SELECT s AS source, max(max_repeats) AS max_repeats, 1 AS is_within FROM (SELECT {SOURCE.format('source')} AS s, * FROM source_targets WHERE target_share > 0 AND max_repeats > 0) WHERE s IN (SELECT {SOURCE.format('source')} FROM documents WHERE text <> '') GROUP BY s",
    }
