"""Running totals, positions and text assembly that stay exact and spread out when one key is hot.

A plain window over a key puts every row of that key into one task. Here the order column is cut into
blocks of 2**16 values; sums per block are combined on the map side, prefix sums run over those few block
rows (again in two steps), and the rows themselves only meet the rows of their own block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_BITS = 16
SUPER_BITS = 40


def running_totals(df: DataFrame, keys: list[str], order: str, totals: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums per key in the order of a unique integer column.

    A block holds at most 2**16 rows of a key, a super block at most 2**24 block rows, a key at most
    2**23 super-block rows, whatever the data.
    """
    names = list(totals)
    cut = df.withColumns({
        "_super": F.shiftright(F.col(order).cast("long"), SUPER_BITS),
        "_block": F.shiftright(F.col(order).cast("long"), BLOCK_BITS),
        **{f"_v_{n}": totals[n] for n in names},
    })
    earlier_blocks = Window.partitionBy(*keys, "_super").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier_supers = Window.partitionBy(*keys).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*keys, "_super", "_block").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    supers = blocks.groupBy(*keys, "_super").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in names]).select(
        *keys, "_super", *[F.coalesce(F.sum(f"_t_{n}").over(earlier_supers), F.lit(0)).alias(f"_u_{n}") for n in names])
    offsets = blocks.select(
        *keys, "_super", "_block",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier_blocks), F.lit(0)).alias(f"_o_{n}") for n in names],
    ).join(supers, [*keys, "_super"]).select(
        *keys, "_super", "_block", *[(F.col(f"_o_{n}") + F.col(f"_u_{n}")).alias(f"_o_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_super", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(offsets, [*keys, "_super", "_block"]).select(
        *df.columns, *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}")).alias(n) for n in names])


def positions(df: DataFrame, keys: list[str], order: str, out: str = "pos") -> DataFrame:
    """Adds the 0-based rank of a row inside its key, by a unique integer column."""
    ranked = running_totals(df, keys, order, {out: F.lit(1).cast("long")})
    return ranked.withColumn(out, F.col(out) - 1)


def hashed_ranks(df: DataFrame, column: str, out: str, bucket_digits: int = 3) -> DataFrame:
    """Adds a dense 0-based number to distinct strings, ordered by their MD5.

    The first hex digits cut the strings into even buckets, so no task sees all of them.
    """
    digest = df.withColumn("_md5", F.md5(F.col(column))).withColumn("_bucket", F.left("_md5", F.lit(bucket_digits)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 16**digits rows
    offsets = digest.groupBy("_bucket").count().select(
        "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("_md5", column)
    return digest.join(F.broadcast(offsets), "_bucket").select(
        *df.columns, (F.row_number().over(inside) - 1 + F.col("_before")).cast("long").alias(out))


def assemble_text(df: DataFrame, keys: list[str], pos: str, piece: str, out: str, block: int = 1024) -> DataFrame:
    """Joins ordered text pieces to one text per key, first inside blocks of positions, then over blocks,
    so that a long text is put together from few parts."""
    parts = df.groupBy(*keys, F.expr(f"{pos} div {block}").alias("_part")).agg(
        F.expr(f"listagg({piece}, '') within group (order by {pos})").alias("_text"))
    return parts.groupBy(*keys).agg(
        F.expr("coalesce(listagg(_text, '') within group (order by _part), '')").alias(out))
