"""Bottom-k sketches of word shingles: resemblance, containment and distinct counts, mergeable across parts.

A text's shingles are its runs of five lower-case words (a shorter text is one shingle, one without a word none). Each is hashed to
48 bits; the sketch is the ascending array of the k least distinct hashes. The sketch of a union is the k least of the
sketches' union, so parts can be sketched apart and merged. Everything is column expressions.

Defined results: a null text counts as the empty one, whose sketch is empty; two empty sketches resemble each other with 1,
an empty and another one with 0; rows with a null doc_id have no place in the order and take no part in ``edited``; rows that
share a doc_id follow each other by text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import let, texts

K = 128
SHINGLE = 5
HASH_BITS = 48
BLOCK_BITS = 8
STEP_BITS = 12


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all shingles, with repeats, in the order of the text."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        return F.when(F.size(h) >= width, F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))),
            lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(width)]), 64 - HASH_BITS))).when(
            F.size(h) > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - HASH_BITS))).otherwise(F.array().cast("array<bigint>"))

    return let(words, shingles)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated shared shingles over all shingles; exact where both together have no more than k."""
    return let(union(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0 ** HASH_BITS) / (F.element_at(a, k) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has too; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_shingles(union(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merged(parts: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per key from those of its parts; only each task's k least hashes of a key are shuffled."""
    least = Window.partitionBy(*keys).orderBy("_hash")
    kept = parts.select(*keys, F.explode(column).alias("_hash")).withColumn("_rank", F.dense_rank().over(least)).where(
        F.col("_rank") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_set("_hash")).alias(column))  # k hashes at most


def as_text(a: Column) -> Column:
    """12 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), HASH_BITS // 4, "0"))), "")


def _next_lower(keys: DataFrame, key: str, levels: int) -> DataFrame:
    """(key, lower): the next smaller of distinct keys, null for the least. No window holds more than 2^12 keys where
    the caller's ``levels`` leave so few for the last one."""
    if levels <= 0:
        return keys.select(key, F.lead(key).over(Window.orderBy(F.col(key).desc())).alias("lower"))
    group = f"_group_{levels}"
    grouped = keys.withColumn(group, F.shiftright(key, STEP_BITS))
    inside = grouped.withColumn("_lower", F.lead(key).over(Window.partitionBy(group).orderBy(F.col(key).desc())))
    heads = grouped.groupBy(group).agg(F.max(key).alias("_head"))
    follow = _next_lower(heads.select(group), group, levels - 1).withColumnRenamed("lower", "_follow")
    after = follow.join(heads.select(F.col(group).alias("_follow"), "_head"), "_follow").select(group, "_head")
    return inside.join(after, group, "left").select(key, F.coalesce("_lower", "_head").alias("lower"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the next document by descending doc_id; the last one's next is the first.

    Texts are shuffled once, into blocks of 2^8 ids; the block's last document takes the first text of the next block.
    """
    own = texts(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "block", F.shiftright("doc_id", BLOCK_BITS))
    low, high = own.agg(F.min("block"), F.max("block")).first()
    if low is None:
        return own.select("doc_id", "text", F.col("text").alias("next_text"))
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc(), "text")
    inside = own.withColumns({"inner": F.lead("text").over(order), "before": F.lag("doc_id").over(order)})
    heads = inside.where("before is null").select("block", F.col("text").alias("head"))
    levels = max(0, -(-((high - low).bit_length() - STEP_BITS) // STEP_BITS))
    follow = _next_lower(own.select("block").distinct(), "block", levels).select(
        "block", F.coalesce("lower", F.lit(high)).alias("follow"))
    outer = follow.join(heads.withColumnRenamed("block", "follow"), "follow").select("block", "head")
    return inside.join(outer, "block").select("doc_id", "text", F.coalesce("inner", "head").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many characters of the following one, or all that it has."""
    n = F.char_length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def compare_with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Sketches of each text, of its edited form and of the next text, and how much they resemble each other."""
    rows = with_next(docs).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"),
        sketch(F.col("text"), k).alias("own"), sketch(F.col("edit"), k).alias("edit"), sketch(F.col("next_text"), k).alias("next"))


def digest(compared: DataFrame, k: int = K) -> DataFrame:
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edit")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("edit"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
        containment(F.col("own"), F.col("edit"), k).alias("kept_share"), distinct_shingles(F.col("own"), k).alias("n_shingles"))
