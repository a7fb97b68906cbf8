"""Approximate nearest neighbours by inner product: forests of random-projection trees with exact reranking.

Rows are dealt by hash into shards of about ``SHARD_ROWS``; a shard has a forest of ``TREES`` trees over all its rows. A tree
splits at the median of the rows' projections on a random direction until a leaf has ``LEAF`` rows or fewer. For inner products of vectors
of any length, rows get one more component that makes them equally long, and queries a zero there.

A search has one priority queue for all trees of the forest: the key of a branch is the largest distance by which the query lies on the
other side of a split above it, zero for the leaf that the query falls into. Leaves leave the queue in that order until
``SHARE`` of the shard's rows, and ``LEAST_MET`` of them, have been met; these are scored exactly, in double precision. It is done for a block of queries at a
time: a row is met when the first of its leaves is, so its key is the least of its leaves' keys, and the rows with the least keys
are the candidates. The products of a block with a shard are worked out together, also those of rows that are not met. Equal keys are met together, so the result doesn't depend on an order of work.

Queries meet every shard in blocks of ``QUERY_ROWS``; a pair of a block and a shard gives its best rows, and the best of these are
the result. Memory is bounded by one shard and one block. Splits are drawn from a seed by shard, tree and depth, so
a lost task gives the same rows again.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null
id; vectors of another length than the query's aren't its candidates; rows that share the query's id aren't either; rows that share an id
count once with their best score; fewer candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SHARD_ROWS = 8192
QUERY_ROWS = 4096
TREES = 16
LEAF = 32
SHARE = 0.65
LEAST_MET = 1024
AT_ONCE = 256


def usable(vector: str) -> Column:
    """Not null or empty, every component a finite number, one at least not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def plant(rows: np.ndarray, trees: int, leaf: int, seed: int) -> list[list[tuple]]:
    """For each tree its nodes, parents first: (parent, side, direction, split, rows); inner nodes have no rows, leaves no direction."""
    forest = []
    for t in range(trees):
        draw = np.random.default_rng((seed, t))
        nodes: list[tuple] = []
        waiting = [(-1, 0, np.arange(len(rows)))]
        while waiting:
            parent, side, own = waiting.pop()
            direction = draw.standard_normal(rows.shape[1])
            direction /= np.linalg.norm(direction)
            along = rows[own] @ direction
            split = float(np.median(along))
            low = along < split
            if len(own) <= leaf or not low.any():  # equal rows can't be parted
                nodes.append((parent, side, None, 0.0, own))
                continue
            nodes.append((parent, side, direction, split, None))
            waiting += [(len(nodes) - 1, 0, own[low]), (len(nodes) - 1, 1, own[~low])]
        forest.append(nodes)
    return forest


def keys(forest: list[list[tuple]], n_rows: int, queries: np.ndarray) -> np.ndarray:
    """For each query and row, the queue's key of the row's first leaf."""
    least = np.full((len(queries), n_rows), np.inf, np.float32)
    for nodes in forest:
        inner = [i for i, n in enumerate(nodes) if n[2] is not None]
        beyond = {}
        if inner:
            margins = queries @ np.stack([nodes[i][2] for i in inner], axis=1) - np.array([nodes[i][3] for i in inner])
            beyond = {i: margins[:, k].astype(np.float32) for k, i in enumerate(inner)}
        key: list[np.ndarray] = []
        of_row = np.zeros(n_rows, np.int64)
        leaves: list[np.ndarray] = []
        for parent, side, direction, _, own in nodes:
            if parent < 0:
                here = np.zeros(len(queries), np.float32)
            else:
                # how far the query lies on the other side of the split
                away = beyond[parent] if side == 0 else -beyond[parent]
                here = np.maximum(key[parent], away)
            key.append(here)
            if direction is None:
                of_row[own] = len(leaves)
                leaves.append(here)
        np.minimum(least, np.stack(leaves, axis=1)[:, of_row], out=least)
    return least


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, trees: int = TREES,
           leaf: int = LEAF, share: float = SHARE, seed: int = 0, least_met: int = LEAST_MET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best candidates, and more where ids are shared."""
    longest = np.sqrt((rows * rows).sum(axis=1).max())
    lifted = np.column_stack((rows, np.sqrt(np.maximum(0, longest**2 - (rows * rows).sum(axis=1)))))
    forest = plant(lifted, trees, leaf, seed)
    met = min(len(rows), max(least_met, 4 * k, int(np.ceil(share * len(rows)))))
    spare = len(ids) - len(np.unique(ids))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), AT_ONCE):
        own, own_ids = queries[at:at + AT_ONCE], query_ids[at:at + AT_ONCE]
        key = keys(forest, len(rows), np.column_stack((own, np.zeros(len(own)))))
        last = np.partition(key, met - 1, axis=1)[:, met - 1:met]
        rough = np.where((key <= last) & (ids[None, :] != own_ids[:, None]), own @ rows.T, -np.inf)
        keep = min(len(rows), k + spare)
        edge = np.partition(rough, len(rows) - keep, axis=1)[:, len(rows) - keep]
        scale = 1e-12 * longest * np.sqrt((own * own).sum(axis=1))
        q, r = np.nonzero((rough >= (edge - scale)[:, None]) & (rough > -np.inf))
        # summed the same way for any pair, wherever it stands
        found.append((own_ids[q], ids[r], (own[q] * rows[r]).sum(axis=1)))
    return tuple(np.concatenate(x) for x in zip(*found))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, trees: int = TREES, leaf: int = LEAF,
            share: float = SHARE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, least_met: int = LEAST_MET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & usable("vector"))
    is_query = F.col("vec_id") % every == 0
    n_rows, n_queries = own.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_queries // query_rows))
    mix = F.xxhash64("vec_id", F.lit(11))
    rows = own.withColumns({"shard": F.pmod(mix, F.lit(shards)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asked = own.where(is_query).withColumns(
        {"block": F.pmod(mix, F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))})
    on = ["shard", "block", "size"]
    rows, asked = (x.withColumn("size", F.size("vector")) for x in (rows, asked))

    def run(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
        if not index.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

        def parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            table = table.combine_chunks()
            flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ids, vectors = table.column("vec_id").to_numpy(), flat.reshape(table.num_rows, -1)
            order = np.lexsort((*vectors.T[::-1], ids))  # the same order whatever the shuffle's
            ids, vectors = ids[order], vectors[order]
            new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)))
            return ids[new], vectors[new]

        query_id, vec_id, score = search(*parts(index), *parts(asked), k, trees, leaf, share, seed=key[0].as_py(), least_met=least_met)
        return pa.table({"query_id": query_id, "vec_id": vec_id, "score": score})

    found = rows.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
