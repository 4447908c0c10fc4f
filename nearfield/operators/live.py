"""The live rows of a write log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the lookup of keys with several versions: so many a key, within these bounds (4 KB to 64 MB are sent to all tasks).
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 15, 1 << 29


def live_keys(log: DataFrame, keys: Sequence[str] = ("namespace", "item_id"), order: str = "seq") -> DataFrame:
    """One row per key with the highest and the lowest `order` and the number of versions; reads only these columns.

    The aggregate combines on the map side, so a key with very many versions costs one row per task.
    """
    return log.groupBy(*keys).agg(F.max(order).alias(order), F.min(order).alias(f"first_{order}"), F.count(F.lit(1)).alias("n_versions"))


def _words(hashes: DataFrame, n_bits: int) -> DataFrame:
    """(_bucket, _words): the set bits of `h` modulo n_bits, in buckets of 512 words of 64 bits."""
    at = F.pmod("h", F.lit(n_bits)) + 1  # buckets count from 1
    maps = hashes.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    return maps.select("_bucket", F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("m", i * 8 + 1, F.lit(8))), 16, -10).cast("long")).alias("_words"))


def _bit(h: Column, n_bits: int) -> Column:
    """Whether the bit of h is set in the joined bucket."""
    at = F.bitmap_bit_position(F.pmod(h, F.lit(n_bits)) + 1)
    word = F.get("_words", F.shiftright(at, 6).cast("int"))
    # the first byte of a word is its highest, the first bit of a byte its lowest
    place = (7 - F.pmod(F.shiftright(at, 3), F.lit(8))) * 8 + F.pmod(at, F.lit(8))
    return F.coalesce(F.call_function("shiftright", word, place.cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def live_rows(log: DataFrame, keys: Sequence[str] = ("namespace", "item_id"), order: str = "seq", versions: bool = False) -> DataFrame:
    """Rows that hold the highest `order` of their key.

    Null keys form a key of their own; rows with a null `order` are no part of the log and are left out. A row delivered
    twice with the same `order` comes out twice. `order` is unique in the log otherwise. With `versions` the rows get
    n_versions, the number of rows of their key, and the lowest `order` among them as first_<order>.

    Keys with several versions are found on keys alone, and a bitmap of their hashes, bounded in size, is sent to all
    tasks. Rows that it excludes are live and stay where they are; the others meet the live `order`s in a semi join, which
    spreads evenly whatever the keys are. With more such keys than the bitmap can tell apart, more rows take the join.
    """
    log = log.filter(F.col(order).isNotNull())
    per_key = live_keys(log, keys, order)
    hashes = per_key.filter("n_versions > 1").select(F.xxhash64(*keys).alias("h")).persist()
    n = hashes.count()
    one = {"n_versions": F.lit(1).cast("long"), f"first_{order}": F.col(order)} if versions else {}
    if not n:
        return log.withColumns(one)
    n_bits = min(max(1 << (n * BITS_PER_KEY - 1).bit_length(), LEAST_BITS), MOST_BITS)
    h = F.xxhash64(*(F.col(k) for k in keys))
    bucket = F.bitmap_bucket_number(F.pmod(h, F.lit(n_bits)) + 1)
    looked = log.join(F.broadcast(_words(hashes, n_bits)), bucket == F.col("_bucket"), "left")
    kept = [F.col(f"`{c}`") for c in log.columns]
    sure = looked.filter(~_bit(h, n_bits)).select(*kept).withColumns(one)
    unsure = looked.filter(_bit(h, n_bits)).select(*kept)
    live = unsure.join(per_key.select(order, "n_versions", f"first_{order}"), order) if versions else unsure.join(per_key.select(order), order, "left_semi")
    return sure.unionByName(live)
