"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on the whole edge table; between rounds the edges are written to the
shared folder, so that lineage stays short and a lost executor costs one round. Only a count and a checksum
come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stored


def _point_to_least(edges: DataFrame, only_smaller: bool) -> DataFrame:
    """Links each neighbour of a node to the least node around it.

    ``only_smaller``: a node moves its smaller neighbours and itself (small-star), else its larger ones (large-star).
    Edges are (a, b) with a > b. Minima combine on the map side, so a node with very many neighbours is no hot key
    there; the join that follows is a plain equality join, whose large partitions Spark splits.
    """
    if only_smaller:
        least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        moved = edges.join(least, edges.a == least.node).select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    else:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        moved = edges.join(least, edges.b == least.node).select("a", F.col("least").alias("b"))
        # the larger side of an edge keeps its own link to the least node around it
        moved = moved.union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of an edge (a, b), with the least node that it can reach.

    Loops, repeated edges and either direction are fine; rows with a null end are left out. No edge: no row.
    """
    now = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        now = stored(_point_to_least(_point_to_least(now, False), True), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
