"""Equality join with a large lookup table when a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 1000


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Keys with a thousandth of all rows or more: never over a thousand of them, whatever the data."""
    total = counts.agg(F.sum(n).alias("_total"))
    # the total is one row
    return counts.join(F.broadcast(total)).where(F.col(n) * HOT_SHARE >= F.col("_total")).select(key)


def skew_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with a table that has each key once.

    Rows of hot keys get their values by broadcast, a thousand at most, and aren't shuffled. All other keys hold less
    than a thousandth of the rows each and are joined by a shuffle; rows without a key have no match and aren't
    shuffled either. ``counts`` (key, n) saves a pass where it is known.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    values = [c for c in table.columns if c != key]
    packed = table.select(key, F.struct(*values).alias("_value"))
    hot = hot_keys(counts.where(F.col(key).isNotNull()), key).withColumn("_is_hot", F.lit(True))
    # a table without a hot key's row gives it a null value, as any other key
    hot = F.broadcast(hot.join(packed, key, "left"))
    flagged = rows.join(hot, key, "left")
    aside = F.col("_is_hot").isNotNull() | F.col(key).isNull()
    cold = flagged.where(~aside).drop("_is_hot", "_value").join(packed, key, "left")
    joined = flagged.where(aside).drop("_is_hot").unionByName(cold)
    if how == "inner":
        joined = joined.where("_value is not null")
    return joined.select(*rows.columns, *[F.col(f"_value.{v}").alias(v) for v in values])
