"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets the weight p^a / sum of p^a. The exponent a runs from 0 (all sources alike) to 1 (as they
are); with a, both the entropy of the weights and the most repeated source's number of epochs fall. So the least exponent is searched
whose entropy is no more than the target and whose repetition is within the limit, by sections: each pass over the table of
sources evaluates ``SECTIONS`` exponents at once and keeps the section in which both conditions begin to hold.

The weights are realised by budgets in tokens: a source's documents are taken in whole epochs and, for what is left of its
budget, as the beginning of one more. The order of an epoch is a permutation of blocks, and of the documents in
each block, by hashes of a seed. Positions in it are running totals: those of the blocks of a source, at most
``MOST_BLOCKS`` rows, and inside a block. A source that holds most rows is spread over its blocks.

Defined results: a null source is one of its own; a null text has no tokens; a document without tokens costs nothing and is taken
once; rows with a null doc_id are documents like any other; of repeated rows each is one; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored

SECTIONS = 32
PASSES = 6
BLOCK_DOCS = 256
MOST_BLOCKS = 1 << 16
FLATTEN = 0.5  # of the way from the entropy of the sources as they are to that of equal weights
REPEAT_LIMIT = 4.0
SEED = 17


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens): tokens are runs without white space."""
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long").alias("tokens"))


def exponent(sources: DataFrame, flatten: float = FLATTEN, repeat_limit: float = REPEAT_LIMIT, cover: bool = False) -> float:
    """The least exponent within the target entropy and the repetition limit. ``sources``: (source, tokens).

    ``cover``: the budget is the least with which every source is taken once at least; else it is all tokens there are.
    """
    present = sources.where("tokens > 0")
    total, kinds, least, most = present.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    if not kinds or least == most:
        return 1.0
    share = present.select(F.log(F.col("tokens") / F.lit(total)).alias("ln_p"))
    low_p, high_p = math.log(least / total), math.log(most / total)

    def measured(exponents: list[float]) -> list[tuple[float, float]]:
        """Entropy and most epochs under each exponent, in one pass."""
        weight = [F.exp(F.col("ln_p") * a) for a in exponents]
        row = share.agg(*[F.sum(w) for w in weight], *[F.sum(w * F.col("ln_p")) for w in weight]).first()
        n, out = len(exponents), []
        for a, z, moment in zip(exponents, row[:n], row[n:]):
            epochs = math.exp((low_p - high_p) * (a - 1)) if cover else math.exp(low_p * (a - 1)) / z
            out.append((math.log(z) - a * moment / z, epochs))
        return out

    natural = measured([1.0])[0][0]
    target = natural + flatten * (math.log(kinds) - natural)
    low, high = 0.0, 1.0  # the conditions hold at ``high``
    for _ in range(PASSES):
        grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS)]
        holds = [h <= target and e <= repeat_limit for h, e in measured(grid)]
        k = holds.index(True) if any(holds) else SECTIONS
        low, high = (low, grid[0]) if not k else (grid[k - 1], grid[k] if k < SECTIONS else high)
    return high


def weights(sources: DataFrame, a: float, cover: bool = False) -> DataFrame:
    """Adds weight, budget, epochs (whole ones) and rest (tokens of one more) to (source, tokens, docs)."""
    total, top = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    total, top = total or 1, top or 1
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.sum(raw)).first()[0] or 1.0
    weighted = sources.withColumn("weight", raw / F.lit(z))
    if cover:  # epochs = (tokens / most tokens)^(a - 1), one at least
        taken = F.greatest(F.col("tokens"), F.round(F.col("tokens") * F.pow(F.col("tokens") / F.lit(top), F.lit(a - 1))).cast("long"))
    else:
        taken = F.round(F.col("weight") * F.lit(total)).cast("long")
    some = F.col("tokens") > 0
    return weighted.withColumn("budget", F.when(some, taken).otherwise(F.lit(0).cast("long"))).withColumns({
        "epochs": F.when(some, F.expr("budget div tokens")).otherwise(F.lit(1).cast("long")),
        "rest": F.when(some, F.expr("budget % tokens")).otherwise(F.lit(0).cast("long"))})


def realise(counted: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, copy, start, weight): every document taken, once for each copy; start is the number of tokens that
    its source's stream has before it. ``counted``: (doc_id, source, tokens); ``plan``: as ``weights`` gives it."""
    def mixed(*parts: str) -> Column:
        return F.xxhash64(*[F.col(p) for p in parts], F.lit(seed))

    # repeated rows are told apart by what else they hold, here nothing: their order is of no consequence
    source = F.col("source").eqNullSafe(F.col("_source"))
    dealt = plan.withColumnRenamed("source", "_source").withColumn(
        "blocks", F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS))))
    rows = counted.join(dealt.select("_source", "blocks"), source).select(
        *counted.columns, F.pmod(F.xxhash64("doc_id", "tokens", F.lit(seed)), F.col("blocks")).alias("block"))
    rows = stored(rows, "mixing")
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    # as many as the repetition limit allows, and the part of one more
    each = blocks.join(dealt.select("_source", "epochs", "rest", "weight", F.col("tokens").alias("whole")), source).drop("_source").withColumn(
        "copy", F.explode(F.expr("sequence(0L, epochs - if(rest > 0, 0, 1))")))
    before = Window.partitionBy("source", "copy").orderBy(mixed("block", "copy"), "block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(
        (F.col("copy") < F.col("epochs")) | (F.col("before") < F.col("rest"))).withColumnsRenamed(
        {"source": "_source", "block": "_block"})
    placed = rows.join(each, source & (F.col("block") == F.col("_block")))
    inside = Window.partitionBy("source", "block", "copy").orderBy(mixed("doc_id", "copy"), "doc_id", "tokens").rowsBetween(
        Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.col("before") + F.sum("tokens").over(inside))
    shown = ["doc_id", "source", "tokens", F.col("copy").cast("int").alias("copy")]
    taken = placed.where((F.col("tokens") > 0) & ((F.col("copy") < F.col("epochs")) | (F.col("upto") <= F.col("rest")))).select(
        *shown, (F.col("copy") * F.col("whole") + F.col("upto") - F.col("tokens")).alias("start"), "weight")
    free = rows.where("tokens = 0").join(dealt.select("_source", "weight"), source).withColumn("copy", F.lit(0))
    return taken.unionByName(free.select(*shown, F.lit(0).cast("long").alias("start"), "weight"))


def mix(docs: DataFrame, flatten: float = FLATTEN, repeat_limit: float = REPEAT_LIMIT, cover: bool = False) -> tuple[DataFrame, float]:
    """What ``realise`` gives for all documents, and the exponent."""
    counted = stored(token_counts(docs), "tokens")
    sources = stored(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    a = exponent(sources, flatten, repeat_limit, cover)
    return realise(counted, stored(weights(sources, a, cover), "weights")), a


def remixed(docs: DataFrame, flatten: float = FLATTEN, repeat_limit: float = REPEAT_LIMIT) -> DataFrame:
    """The documents, columns as they are, each at least once and those of small sources repeated, so that the sources' token
    shares come to the target weights. Rows that share a doc_id and a source get the most copies that one of them gets."""
    taken, _ = mix(docs, flatten, repeat_limit, cover=True)
    copies = taken.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(
        (F.max("copy") + 1).alias("_copies"))
    joined = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
