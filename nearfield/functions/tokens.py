"""Token arrays: truncation, padding and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truncate(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def pad(ids: Column, length: Column, pad_id: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id).cast("bigint"), length - F.size(ids)))


def attention_mask(n: Column, length: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1).cast("bigint"), n), F.array_repeat(F.lit(0).cast("bigint"), length - n))


def token_type_ids(length: Column) -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), length)


def pad_longest(df: DataFrame, ids: str, batch: str, pad_id: int, max_len: int) -> DataFrame:
    """Each row's ids cut to max_len and padded to the longest of its batch; adds input_ids, attention_mask, token_type_ids.

    The longest length of each batch comes from an aggregate that combines on the map side and is joined back, so a
    batch of any size isn't gathered in one task. A null batch is a batch; null ids give null arrays.
    """
    cut = df.withColumn("input_ids", truncate(F.col(ids), max_len))
    longest = cut.groupBy(F.col(batch).alias("_batch")).agg(F.max(F.size("input_ids")).alias("_longest"))
    joined = cut.join(longest, F.col(batch).eqNullSafe(F.col("_batch")))
    n, m = F.size("input_ids"), F.col("_longest")
    return joined.select(*df.columns, pad(F.col("input_ids"), m, pad_id).alias("input_ids"), attention_mask(n, m).alias("attention_mask"), token_type_ids(m).alias("token_type_ids"))


def hashed_terms(text: Column, buckets: int = 64) -> Column:
    """Array of (bucket, sign) of the words of a text between single blanks: signed feature hashing by md5."""

    def one(w: Column) -> Column:
        h = F.md5(w.cast("binary"))
        bucket = F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % buckets
        sign = F.when(F.conv(F.substring(h, 5, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
        return F.struct(bucket.alias("bucket"), sign.alias("sign"))

    return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), one)


def hash_counts(text: Column, buckets: int = 64) -> Column:
    """Signed counts of a text's words by bucket, as doubles."""
    return F.aggregate(
        hashed_terms(text, buckets),
        F.array_repeat(F.lit(0.0), buckets),
        lambda acc, t: F.transform(acc, lambda x, i: x + F.when(i == t["bucket"], t["sign"]).otherwise(0).cast("double")),
    )


def hash_embedding(text: Column, buckets: int = 64) -> Column:
    """Unit vector of a text by feature hashing; all zeros for a text without words."""
    counts = hash_counts(text, buckets)
    n = F.greatest(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-9))
    return F.transform(counts, lambda x: (x / n).cast("float"))
