"""Joins and numbering that a key with very many rows doesn't gather in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of all rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: Never call a key with fewer rows hot.
HOT_ROWS = 2_000
#: Bits of a filter of keys, and of one of the rows that it is gathered in.
FILTER_BITS, FILTER_PART = 1 << 24, 1 << 15


def join_on_counted_key(rows: DataFrame, per_key: DataFrame, key: str, n_col: str, total: int, how: str = "left", parts: int | None = None) -> DataFrame:
    """Join rows with one row per key that carries the key's row count in n_col.

    Keys above the hot threshold number at most 1 / HOT_SHARE whatever the input, so their rows are broadcast;
    all other keys are shuffled, each holding a small share of a partition at most. Null keys match nothing.
    parts: into so many partitions, where rows are too many for the session's number of them.
    """
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    names = [c for c in per_key.columns if c != key]
    held = F.struct(*[F.col(c) for c in names])
    hot = per_key.where(F.col(n_col) > limit).select(F.col(key).alias("__hot_key"), held.alias("__hot"))
    cold = per_key.where(F.col(n_col) <= limit).select(F.col(key).alias("__cold_key"), held.alias("__cold"))
    rows_with_hot = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left")
    # a hot row is dealt by all its columns; it finds no partner on the cold side
    deal = F.when(F.col("__hot_key").isNull() & F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*rows.columns))
    left, right = rows_with_hot.withColumn("__deal", deal), cold.withColumn("__cold_deal", F.xxhash64("__cold_key"))
    if parts:
        left, right = left.repartition(parts, "__deal", key), right.repartition(parts, "__cold_deal", "__cold_key")
    joined = left.join(right, (F.col("__deal") == F.col("__cold_deal")) & (F.col(key) == F.col("__cold_key")), "left")
    out = joined.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in names])
    return out.where(F.col(n_col).isNotNull()) if how == "inner" else out


def key_filter(keys: DataFrame) -> Callable[[str | Column], Column]:
    """keys: one column. Tells of a key whether it may be among them: never no for one that is, and no for most others.

    A bit for each slot of a hash, FILTER_BITS whatever the input, so wide rows are looked through where they lie.
    """
    slot = F.pmod(F.xxhash64(keys.columns[0]), F.lit(FILTER_BITS))
    parts = keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / FILTER_PART).alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % FILTER_PART).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():  # FILTER_BITS / FILTER_PART rows at most
        first = r.part * FILTER_PART // 8
        bits[first : first + FILTER_PART // 8] = np.frombuffer(r.bits, np.uint8)
    held = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def marked(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda key: marked(F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)))


def without_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among gone (a column of that name). Only rows that its filter marks are shuffled. rows must be stored."""
    marked = key_filter(gone)
    return rows.where(~marked(key)).unionByName(rows.where(marked(key)).join(gone, key, "left_anti"))


def numbered_within(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], out: str, total: int, spread: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Add out, a gapless number from 0 within each group, without gathering a group in one task.

    Each group is dealt into buckets by a hash of the column spread; bucket counts (a table of groups x buckets
    rows) give each bucket's first number, and only buckets are sorted. The order is by bucket, then by order.
    df must give the same rows each time it is read (a stored table).
    """
    from pyspark.sql import Window as W

    buckets = max(8, -(-total // rows_per_bucket))
    tagged = df.withColumn("__b", F.pmod(F.xxhash64(F.col(spread)), F.lit(buckets)).cast("int"))
    counts = tagged.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.withColumn("__first", F.sum("__n").over(W.partitionBy(*groups).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)))
    first = first.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__b").alias("__gb"), F.coalesce("__first", F.lit(0)).alias("__first"))
    ranked = tagged.withColumn("__r", F.row_number().over(W.partitionBy(*groups, "__b").orderBy(*order)))
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)] + [F.col("__b") == F.col("__gb")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = ranked.join(first, cond, "left")
    return joined.select(*df.columns, (F.col("__r") - 1 + F.col("__first")).cast("long").alias(out))
