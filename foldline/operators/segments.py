"""Cutting token sequences into fixed-size segments, and memory slots beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import let
from ..functions.tokenisers import WHITESPACE, Tokeniser

# Tail slots by merge size.
TAIL_SLOTS = {4: 128, 8: 64}

PLACED_BYTES = 32 << 20  # of text in a partition
PART = "_part"  # the column with the partition's number
VEC = "_vec"  # (vec_id, vec) in rows that bring their part a vector, null in all others


def segment_count(length: Column, size: int, empty: int | None = None) -> Column:
    """ceil(length / size); a sequence without tokens is an error, or has ``empty`` segments. With ``empty`` no length has no count."""
    count = F.when(length > 0, F.ceil(length / F.lit(float(size))).cast("long"))
    if empty is None:
        return count.otherwise(F.raise_error(F.lit("a sequence needs at least one token")))
    return count.when(length == 0, F.lit(empty).cast("long"))


def slices(items: Column, size: int | Column) -> Column:
    """Consecutive slices of an array, the last one shorter; an empty array has none."""
    size = size if isinstance(size, Column) else F.lit(size)

    def cut(all_items: Column) -> Column:
        n = F.ceil(F.size(all_items) / size).cast("int")
        indexes = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(indexes, lambda i: F.slice(all_items, i * size + 1, size))

    return let(items, cut)


def split_segments(df: DataFrame, ids: str, size: int) -> DataFrame:
    """One row per segment: ``seg_idx``, ``tokens``, ``seg_len``."""
    kept = [c for c in df.columns if c != ids]
    cut = df.select(*kept, F.posexplode(slices(F.col(ids), size)).alias("seg_idx", "tokens"))
    return cut.withColumn("seg_len", F.size("tokens"))


def segment_slots(df: DataFrame, ids: str, size: int, first_slot: int, slots: int) -> DataFrame:
    """Segments with memory slots first_slot .. first_slot+slots-1 shared out: ceil(slots / segments) each,
    the later segments get what is left, which can be nothing."""
    quota = F.ceil(F.lit(float(slots)) / F.col("_n")).cast("int")
    all_slots = F.sequence(F.lit(first_slot), F.lit(first_slot + slots - 1))
    counted = df.withColumn("_n", F.ceil(F.size(ids) / F.lit(float(size))).cast("int"))
    return split_segments(counted, ids, size).withColumn(
        "slots", F.slice(all_slots, F.col("seg_idx") * quota + 1, quota)).drop("_n")


def tail_slots(ids: Column, first_slot: int, slots: int) -> Column:
    """Token ids followed by the ids of the memory slots."""
    return F.concat(ids, F.sequence(F.lit(first_slot), F.lit(first_slot + slots - 1)))


def valid_tokens(ids: Column, mask: Column) -> Column:
    """The tokens whose mask is 1, in order."""
    return let(mask, lambda m: F.filter(ids, lambda t, i: F.get(m, i) == 1))


def bytes_of(df: DataFrame) -> Column:
    """A row's size: the bytes of its texts, also of those in arrays, and eight for any other value."""
    def size(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            own = F.octet_length(field.name).cast("long")
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            own = F.aggregate(field.name, F.lit(0).cast("long"), lambda n, text: n + F.coalesce(F.octet_length(text), F.lit(0)))
        elif isinstance(field.dataType, T.ArrayType):
            own = 8 * F.size(field.name).cast("long")
        else:
            own = F.lit(8).cast("long")
        return F.coalesce(own, F.lit(0).cast("long"))

    return sum((size(f) for f in df.schema.fields), F.lit(0).cast("long"))


def placed(df: DataFrame, key: str, part_bytes: int = PLACED_BYTES) -> DataFrame:
    """Puts rows into the task of their key, in partitions of about ``part_bytes``, as many as the session's shuffles have at least.

    This is the one shuffle of the compression: every later grouping, window and join on the key finds its rows
    in place. A record is one row, so a key is never larger than a row can be. The input's bytes are summed first, a pass that shuffles one number
    a task; left to itself a shuffle would be sized by its own bytes, too few parts as a kilobyte of text becomes a hundred of vectors.
    A given number is neither coalesced nor split later.

    Rows without a key are left out here, so that a later join adds no filter below the shuffle and finds it done. The column PART is worked out
    from the key, so that it is the same wherever the rows are read.
    """
    keyed = df.where(F.col(key).isNotNull())
    measured = keyed.agg(F.sum(bytes_of(keyed))).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-measured // part_bytes))
    return keyed.repartition(parts, key).withColumn(PART, F.pmod(F.hash(key), F.lit(parts)))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where they come from fewer files than there are cores, as a file of one row group is one task; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def segment_rows(records: DataFrame, key: str, query: str | None, document: str, size: int, kept: list[str] | None = None,
                 tokeniser: Tokeniser = WHITESPACE) -> DataFrame:
    """One row per segment with its ``words``, the tokeniser's pieces: the query, where one is named, as segment -1, the document's segments from 0.

    A document without tokens has one segment without words. A row that brings a vector, where VEC is ``kept``, stays one row, a segment 0 without words.
    """
    nothing = F.array(F.array().cast("array<string>"))
    cut = let(slices(tokeniser.pieces(F.col(document)), size), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(nothing))
    numbered = F.transform(cut, lambda w, i: F.struct(i.cast("long").alias("seg_idx"), w.alias("words")))
    if query is not None:
        asked = F.array(F.struct(F.lit(-1).cast("long").alias("seg_idx"), tokeniser.pieces(F.col(query)).alias("words")))
        if VEC in (kept or []):
            asked = F.when(F.col(VEC).isNull(), asked).otherwise(F.slice(asked, 1, 0))
        numbered = F.concat(asked, numbered)
    return records.select(key, *(kept or []), F.inline(numbered))


def token_rows(segments: DataFrame, size: int) -> DataFrame:
    """One row per token; ``pos`` counts through the document, and from 0 again in the query. Segments without words have no row."""
    rest = [c for c in segments.columns if c != "words"]
    rows = segments.select(*rest, F.posexplode("words").alias("_p", "token"))
    pos = F.greatest(F.col("seg_idx"), F.lit(0)) * size + F.col("_p")
    return rows.select(*rest, pos.alias("pos"), "token")


def inner_words(words: Column, cap: int | None = None) -> Column:
    """The first ``cap`` words without the first and the last one."""
    cut = words if cap is None else F.slice(words, 1, cap)
    return let(cut, lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))
