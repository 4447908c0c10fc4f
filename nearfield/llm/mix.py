"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.tokens import DEFAULT_TOKENIZER, normal_source, token_counts
from nearfield.session import persist_table

#: So many rates at most are sent to all tasks (under 1 MB); beyond it they are joined by shuffle.
MAX_BROADCAST_TARGETS = 10_000


def source_rates(counted: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """source, target_share, max_repeats, tokens_in, rate for each target; rate is how often a document comes out on average.

    The shares of the targets that have tokens are scaled to sum to 1. The mixture's size is total_tokens, or else the
    largest at which no source exceeds its max_repeats, so that every share is met. With a larger total_tokens the capped
    sources fall short, and the report says so. Targets are few and don't grow with the documents.
    """
    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens_in"))
    want = targets.select(normal_source("source").alias("source"), "target_share", "max_repeats").dropna().filter("target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = want.join(have, "source", "left").withColumn("tokens_in", F.coalesce("tokens_in", F.lit(0)))
    met = t.filter("tokens_in > 0").agg(F.sum("target_share").alias("shares"), F.min(F.col("max_repeats") * F.col("tokens_in") / F.col("target_share")).alias("feasible")).first()
    shares = met.shares or 1.0
    size = F.lit(float(total_tokens / shares if total_tokens else met.feasible or 0.0))
    rate = F.when(F.col("tokens_in") > 0, F.least(F.col("target_share") * size / F.col("tokens_in"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return t.select("source", (F.col("target_share") / F.lit(float(shares))).alias("wanted"), "target_share", "max_repeats", "tokens_in", rate.alias("rate"))


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer_path: str = DEFAULT_TOKENIZER, seed: int = 8, as_large: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    copies: doc_id, source, copy_no, n_tokens - each document floor(rate) times and once more if a hash of its id and the
    seed falls below the fraction, so never more than max_repeats times. report: per target its share wanted (of the targets
    that have tokens) and reached. docs: doc_id, text, source; spellings of a source count as one; documents of no
    target or of a null source aren't in the mixture; null and empty texts have no tokens and are left out. as_large: the
    size as a multiple of all documents' tokens, instead of total_tokens.
    """
    counted = persist_table(token_counts(docs.withColumn("source", normal_source("source")), tokenizer_path).filter("n_tokens > 0"), "mix-counts")
    if as_large is not None:
        total_tokens = as_large * (counted.agg(F.sum("n_tokens")).first()[0] or 0)
    rates = source_rates(counted, targets, total_tokens)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    n = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    few = rates.limit(MAX_BROADCAST_TARGETS + 1).count() <= MAX_BROADCAST_TARGETS
    by_source = rates.select("source", "rate")
    chosen = counted.join(F.broadcast(by_source) if few else by_source, "source").withColumn("n", n).filter("n > 0")
    copies = chosen.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "n_tokens")
    out = chosen.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens_out"), F.max("n").alias("most_copies"))
    report = rates.join(out, "source", "left").withColumn("all_out", F.lit(out.agg(F.sum("tokens_out")).first()[0]))
    return copies, report.select("source", "target_share", F.when(F.col("tokens_in") > 0, F.col("wanted")).otherwise(0.0).alias("wanted_share"), F.coalesce(F.col("tokens_out") / F.col("all_out"), F.lit(0.0)).alias("actual_share"), "max_repeats", "rate", "tokens_in", F.coalesce("tokens_out", F.lit(0)).alias("tokens_out"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
