"""Query-segment similarity, ratio top-k, skim vectors and the hybrid sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let, tokens
from ..functions.vectors import cosine, dot
from . import pooling
from .pooling import WHOLE, Reading, VectorTable, attach_vectors
from .segments import PART, VEC, inner_words, slices, token_rows

TIE_DIGITS = 9


def pooled_segments(segments: DataFrame, table: VectorTable, key: str = "example_id", missing: str = "error") -> DataFrame:
    """Mean vector per segment; the query is segment -1. A segment without words has the zero vector and no tokens."""
    return pooling.pool_groups(segments, [key, "seg_idx"], table, F.col("words"), missing=missing)


def block_embeddings(segments: DataFrame, table: VectorTable, cap: int = 512, key: str = "example_id", missing: str = "error") -> DataFrame:
    """Mean vector of each segment's first ``cap`` words without the first and the last one; with none left, the zero vector."""
    inner = segments.select(key, "seg_idx", inner_words(F.col("words"), cap).alias("words"))
    return pooled_segments(inner, table, key, missing)


def with_query_vector(pooled: DataFrame, key: str = "example_id") -> DataFrame:
    """Puts the vector of segment -1 beside each document segment.

    The rows already lie together by key, so the window adds a sort and no shuffle.
    """
    head = Window.partitionBy(key).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.when(F.first("seg_idx").over(head) == -1, F.first("vec").over(head))
    return pooled.withColumn("query_vec", asked).where("seg_idx >= 0")


def segment_similarity(pooled: DataFrame, key: str = "example_id") -> DataFrame:
    """Cosine of query and segment; an empty query is the zero vector and gives 0."""
    return with_query_vector(pooled, key).withColumn(
        "sim", F.coalesce(cosine(F.col("query_vec"), F.col("vec")), F.lit(0.0)))


def record_similarities(records: DataFrame, table: VectorTable, size: int, key: str = "example_id", query: str = "question",
                        document: str = "document", missing: str = "error") -> DataFrame:
    """One row per record: the document, the query's vector, and ``n_tokens`` and ``sims`` by segment. Nothing is shuffled.

    For a table that is sent to the workers; a document without tokens has one segment without words.
    """
    compare = pooling.gather_records(table, size, missing=missing)
    rows = records.where(F.col(key).isNotNull()).select(key, document, compare(query, document).alias("_found"))
    return rows.select(key, document, "_found.query_vec", "_found.n_tokens", "_found.sims")


def records_in_parts(records: DataFrame, table: VectorTable, size: int, cap: int | None = None, key: str = "example_id", query: str = "question",
                     document: str = "document", missing: str = "error") -> DataFrame:
    """One row per record, as ``pooling.gather_records`` has it, for a table of any size. What is sent needs no shuffle; else records are placed once."""
    records = records.where(F.col(key).isNotNull())
    if table.fits_broadcast:
        gather = pooling.gather_records(table, size, cap, missing)
        return records.select(key, gather(query, document).alias("_found")).select(key, "_found.*")
    return pooling.pull_records(records, table, size, cap, key, query, document, missing)


def block_vectors(records: DataFrame, table: VectorTable, size: int, cap: int = 512, key: str = "example_id", query: str = "question",
                  document: str = "document", missing: str = "error") -> DataFrame:
    """(key, seg_idx, n_tokens, vec, query_vec): the block embedding of each of the document's segments, beside that of the query.

    Both are made where the record lies, so that no vector of a segment is shuffled.
    """
    found = records_in_parts(records, table, size, cap, key, query, document, missing)
    rows = F.arrays_zip("n_tokens", F.col("vecs").alias("vec"))
    return found.select(key, "query_vec", F.posexplode(rows).alias("seg_idx", "_row")).select(
        key, F.col("seg_idx").cast("long").alias("seg_idx"), "_row.n_tokens", "_row.vec", "query_vec")


def similarities(records: DataFrame, table: VectorTable, size: int, key: str = "example_id", query: str = "question",
                 document: str = "document", missing: str = "error") -> DataFrame:
    """(key, seg_idx, n_tokens, sim) of every document segment: light rows, without a vector."""
    found = records_in_parts(records, table, size, None, key, query, document, missing)
    rows = F.arrays_zip("n_tokens", F.col("sims").alias("sim"))
    return found.select(key, F.posexplode(rows).alias("seg_idx", "_row")).select(
        key, F.col("seg_idx").cast("long").alias("seg_idx"), "_row.n_tokens", "_row.sim")


def ranked_segments(sims: DataFrame, key: str = "example_id") -> DataFrame:
    """Adds ``n_segments`` and ``rank`` (1 = closest; ties at nine digits go to the earlier segment).

    The rank does not depend on the ratio, so one pass serves a whole sweep.
    """
    group = Window.partitionBy(key)
    best = group.orderBy(F.round("sim", TIE_DIGITS).desc(), "seg_idx")
    return sims.withColumns({
        "n_segments": F.count(F.lit(1)).over(group),
        "rank": F.row_number().over(best),
    })


def keep_count(ratio: Column, n_segments: Column) -> Column:
    """int(ratio * S) in double arithmetic."""
    return F.floor(ratio.cast("double") * n_segments).cast("long")


def keep_flag(ratio: Column | float, n_segments: str = "n_segments", rank: str = "rank") -> Column:
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.col(rank) <= keep_count(ratio, F.col(n_segments))


def for_ratios(df: DataFrame, ratios: list[float]) -> DataFrame:
    """One copy of each row per ratio: a short literal array, no join."""
    return df.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))


def compression_per_example(ranked: DataFrame, ratios: list[float], key: str = "example_id",
                            others: list[str] | None = None) -> DataFrame:
    """Per example and ratio: segments, kept, original and compressed length."""
    kept = keep_flag(F.col("ratio"))
    grouped = for_ratios(ranked, ratios).groupBy(key, *(others or []), "ratio").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.sum(kept.cast("long")).alias("n_kept"),
        F.avg("n_tokens").alias("avg_seg_len"),
        F.max("n_tokens").alias("max_seg_len"),
        F.sum("n_tokens").alias("org_len"),
        F.sum(F.when(kept & (F.col("n_tokens") > 0), F.col("n_tokens")).otherwise(F.lit(1))).alias("comp_len"),
    )
    return grouped.withColumns({
        "n_compressed": F.col("n_segments") - F.col("n_kept"),
        "kept_rate": F.col("n_kept") / F.col("n_segments"),
        "actual_compression": 1 - F.try_divide(F.col("comp_len"), F.col("n_segments") * F.col("max_seg_len")),
    })


def choices(ranked: DataFrame, ratio: Column | float, key: str = "example_id") -> DataFrame:
    """One row per example: its query vector and the places of the kept segments, never more than the record has.

    ``ratio``: one for all, or a column, such as a drawn one.
    """
    return ranked.groupBy(key).agg(
        F.first("query_vec").alias("query_vec"),
        F.collect_list(F.when(keep_flag(ratio), F.col("seg_idx"))).alias("kept_segs"),
    )


def chosen_segments(records: DataFrame, table: VectorTable, ratio: float, size: int, key: str = "example_id", query: str = "question",
                    document: str = "document", missing: str = "error", vecs: str | None = None, reading: Reading = WHOLE) -> DataFrame:
    """The document's segments with their words, a ``keep`` flag and, with a table that is sent to the workers, the query's vector. A segment without words isn't kept.

    Similarity, order and choice stay where the record lies. With a table that is too large to be sent, that is the task of its part, and what comes of
    the choice is made there too: ``vecs`` has the vectors that ``skim_vectors`` ('summaries') or ``hybrid_vectors`` ('all') ask next, or the ``reading`` that the latter asks.
    """
    if not table.fits_broadcast:
        return pooling.pull_choice(records.where(F.col(key).isNotNull()), table, ratio, size, TIE_DIGITS, vecs, key, query, document, missing, reading)
    found = record_similarities(records, table, size, key, query, document, missing)
    order = F.array_sort(F.transform("sims", lambda s, i: F.struct((-F.round(s, TIE_DIGITS)).alias("away"), i.alias("seg"))))
    count = keep_count(F.lit(float(ratio)), F.size("sims")).cast("int")
    kept = F.transform(F.slice(order, F.lit(1), count), lambda o: o["seg"])
    nothing = F.array(F.array().cast("array<string>"))
    cut = let(slices(tokens(F.col(document)), size), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(nothing))
    rows = found.select(key, cut.alias("words"), "query_vec", kept.alias("_kept"))
    every = F.sequence(F.lit(0), F.size("words") - 1)

    def flagged(places: Column | str, keep: bool) -> Column:
        # a segment takes its own words along: a row that carried the record's would make the whole grow with the square of a document
        return F.transform(places, lambda i: F.struct(
            i.cast("long").alias("seg_idx"), F.get("words", i).alias("words"), F.lit(keep).alias("_keep")))

    both = F.concat(flagged("_kept", True), flagged(F.array_except(every, "_kept"), False))
    rows = rows.select(key, "query_vec", F.inline(both))
    return rows.select(key, "seg_idx", "words", "query_vec", (F.col("_keep") & (F.size("words") > 0)).alias("keep"))


def skim_vectors(segments: DataFrame, table: VectorTable, key: str = "example_id", missing: str = "error") -> DataFrame:
    """One vector per segment that is not kept: its tokens weighted by softmax of cos(token, query).

    The choice comes first, so that tokens of kept segments never meet a vector.
    """
    skimmed = segments.where(~F.col("keep"))
    if "vecs" in segments.columns:
        return skimmed.select(key, "seg_idx", F.size("words").cast("long").alias("n_tokens"), F.get("vecs", F.lit(0)).alias("skim_vec"))
    return pooling.pool_groups(skimmed, [key, "seg_idx"], table, F.col("words"), query="query_vec", score="cosine",
                               missing=missing, out="skim_vec")


def hybrid_rows(segments: DataFrame, size: int, key: str = "example_id") -> DataFrame:
    """Kept segments as their tokens, every other one as a single summary row (src_pos -1): a narrow step."""
    start = F.col("seg_idx") * size
    read = F.transform("words", lambda w, i: F.struct(
        (start + i).alias("src_pos"), F.lit("token").alias("kind"), w.alias("token")))
    summary = F.array(F.struct(F.lit(-1).cast("long").alias("src_pos"), F.lit("summary").alias("kind"),
                               F.lit(None).cast("string").alias("token")))
    return segments.select(key, "seg_idx", F.inline(F.when(F.col("keep"), read).otherwise(summary)))


def hybrid_vectors(segments: DataFrame, table: VectorTable, size: int, key: str = "example_id", missing: str = "error",
                   reading: Reading = WHOLE) -> DataFrame:
    """The hybrid sequence with a vector per row, ``vec``, or its ``reading``: a kept token has its own, a skimmed segment its summary.

    With a table that is sent to the workers, one pass over the segments gives both; segments that have their ``vecs`` need none.
    """
    summary = [F.lit(-1).cast("long").alias("src_pos"), F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("token")]
    if table.fits_broadcast or "vecs" in segments.columns:
        # what is gathered here isn't a column before, as a filter on its size would gather it again
        vectors = F.col("vecs") if "vecs" in segments.columns else pooling.gather_or_pool(table, missing, reading)("words", "keep", "query_vec")
        found = segments.select(key, "seg_idx", "keep", "words", F.posexplode(vectors).alias("_p", "vec"))
        return found.select(
            key, "seg_idx", F.when(F.col("keep"), F.col("seg_idx") * size + F.col("_p")).otherwise(summary[0]).alias("src_pos"),
            F.when(F.col("keep"), F.lit("token")).otherwise(summary[1]).alias("kind"),
            F.when(F.col("keep"), F.get("words", F.col("_p"))).alias("token"), "vec")
    read = token_rows(segments.where("keep").select(key, "seg_idx", "words"), size).withColumns({
        "vec_id": pooling.token_vector_id(F.col("token"), table.rows), "cnt": F.lit(1).cast("long")})
    kept = attach_vectors(read, table, missing).select(
        key, "seg_idx", F.col("pos").alias("src_pos"), F.lit("token").alias("kind"), "token", "vec")
    skims = skim_vectors(segments, table, key, missing).select(key, "seg_idx", *summary, F.col("skim_vec").alias("vec"))
    both = kept.unionByName(skims)
    return both if reading is WHOLE else both.withColumn("vec", F.arrow_udf(*reading)("vec"))


def visible_memories(segments: DataFrame, size: int, merge: int, key: str = "example_id") -> DataFrame:
    """(key, seg_idx, chunk, mem_pos, visible, words): a memory for each ``merge`` words of a segment, with ``mem_pos`` from 0 through the document.

    A segment sees the rows before it and its own, which are those with mem_pos below the ``visible`` of its rows. The prefix stands for a
    copy of them per segment. Only a document's last segment has fewer than ``size`` words, so both numbers follow from the segment's own: a narrow step, taken
    before there are vectors.
    """
    before = F.col("seg_idx") * (-(-size // merge))
    kept = [c for c in (PART, VEC) if c in segments.columns]
    parts = F.transform(slices(F.col("words"), merge), lambda w, i: F.struct(
        i.cast("long").alias("chunk"), (before + i).cast("long").alias("mem_pos"),
        (before + F.ceil(F.size("words") / F.lit(float(merge)))).cast("long").alias("visible"), w.alias("words")))
    if VEC in kept:
        # a row that brings a vector stays one
        one = F.array(F.struct(*[F.lit(None).cast("long").alias(c) for c in ("chunk", "mem_pos", "visible")], F.col("words")))
        parts = F.when(F.col(VEC).isNull(), parts).otherwise(one)
    return segments.select(key, "seg_idx", *kept, F.inline(parts))


def compact(rows: DataFrame, order: list[str], key: str = "example_id", out: str = "new_pos") -> DataFrame:
    """Numbers the remaining rows of an example without gaps."""
    return rows.withColumn(out, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def softmax_share(df: DataFrame, key: str, score: str, out: str) -> DataFrame:
    """Softmax over the rows of a key; its maximum and sum combine on the map side."""
    group = Window.partitionBy(key)
    shifted = F.exp(F.col(score) - F.max(score).over(group))
    return df.withColumn("_e", shifted).withColumn(out, F.col("_e") / F.sum("_e").over(group)).drop("_e")


def query_similarities(records: DataFrame, table: VectorTable, size: int, key: str = "example_id", queries: str = "queries",
                       document: str = "document", missing: str = "error") -> DataFrame:
    """(key, query_id, seg_idx, sim) for records that ask several queries, an array of texts; a record without any has no row.

    The product of queries and segments is one matrix product where the record lies, in its row or, with a table that is too large to be sent, in its part.
    """
    asking = records.where(F.size(queries) > 0)
    if not table.fits_broadcast:
        return pooling.pull_products(asking.where(F.col(key).isNotNull()), table, size, key, queries, document, missing)
    nothing = F.array(F.array().cast("array<string>"))
    cut = let(slices(tokens(F.col(document)), size), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(nothing))

    both = asking.select(key, F.transform(queries, tokens).alias("_asked"), cut.alias("_read"))
    sims = both.select(key, F.posexplode(pooling.gather_products(table, missing)("_asked", "_read")).alias("query_id", "_sims"))
    return sims.select(key, F.col("query_id").cast("long").alias("query_id"), F.posexplode("_sims").alias("seg_idx", "sim")).select(
        key, "query_id", F.col("seg_idx").cast("long").alias("seg_idx"), "sim")


def contrastive_loss(sims: DataFrame, positives: DataFrame, temperature: float = 0.05, key: str | list[str] = "example_id") -> DataFrame:
    """Loss per example, or per query of an example by ``key``; ids without a segment are ignored, and so is what has no positive."""
    keys = [key] if isinstance(key, str) else key
    wanted = positives.select(*keys, F.explode("pos_seg_ids").alias("seg_idx")).distinct().withColumn("positive", F.lit(1))
    weighed = sims.join(wanted, [*keys, "seg_idx"], "left").withColumn("_e", F.exp(F.col("sim") / temperature))
    summed = weighed.groupBy(*keys).agg(
        F.sum(F.when(F.col("positive") == 1, F.col("_e")).otherwise(0.0)).alias("_pos"),
        F.sum("_e").alias("_all"), F.count("positive").alias("n_positive"))
    return summed.where("n_positive > 0").select(
        *keys, "n_positive", (-F.log((F.col("_pos") + 1e-8) / (F.col("_all") + 1e-8))).alias("loss"))


def mean_loss(losses: DataFrame) -> DataFrame:
    """Mean over the examples that have a loss, with a divisor of at least 1."""
    return losses.agg(
        F.count(F.lit(1)).alias("n_valid"),
        (F.coalesce(F.sum("loss"), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("loss"))


def infonce_loss(scored: DataFrame, positive: Column, temperature: float = 0.1, key: str = "example_id") -> DataFrame:
    """Cross-entropy of one positive against the other segments, on plain dot products."""
    logits = scored.select(key, positive.alias("_is_pos"), (dot(F.col("query_vec"), F.col("vec")) / temperature).alias("_x"))
    top = logits.withColumn("_top", F.max("_x").over(Window.partitionBy(key)))
    summed = top.groupBy(key).agg(
        F.first("_top").alias("_top"), F.sum(F.exp(F.col("_x") - F.col("_top"))).alias("_sum"),
        F.max(F.when(F.col("_is_pos"), F.col("_x"))).alias("_pos"))
    return summed.where("_pos is not null").select(key, (F.log("_sum") + F.col("_top") - F.col("_pos")).alias("loss"))


def batch_infonce(pairs: DataFrame, batch: str, temperature: float = 0.1, key: str = "example_id") -> DataFrame:
    """(batch, key, loss) of rows with ``query_vec`` and ``memory_vec``: each query's own memory against those of all others of its batch.

    A batch comes together in one row, as it is of a fixed size, and its products are one matrix product; pairs are no rows. A batch of one has the loss 0.
    """
    row = F.struct(key, "query_vec", "memory_vec")
    batches = pairs.groupBy(batch).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    losses = pooling.batch_losses(temperature)
    with_loss = batches.select(batch, F.col(f"_rows.{key}").alias("_keys"), losses(F.col("_rows.query_vec"), F.col("_rows.memory_vec")).alias("_losses"))
    return with_loss.select(batch, F.inline(F.arrays_zip(F.col("_keys").alias(key), F.col("_losses").alias("loss"))))


def similarity_share(scored: DataFrame, key: str = "example_id") -> DataFrame:
    """Dot product with the query over the sum of all dot products; null when that sum is 0."""
    dots = scored.withColumn("_x", dot(F.col("query_vec"), F.col("vec")))
    return dots.withColumn("share", F.try_divide(F.col("_x"), F.sum("_x").over(Window.partitionBy(key)))).drop("_x")


def allocate_budget(shares: DataFrame, budget: int, key: str = "example_id", order: str = "seg_idx",
                    share: str = "share", out: str = "slots") -> DataFrame:
    """int(share * budget) each, and the last one takes what the others leave."""
    group = Window.partitionBy(key)
    before = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = shares.withColumn("_own", (F.coalesce(F.col(share), F.lit(0.0)) * budget).cast("long"))
    left = F.lit(budget) - F.coalesce(F.sum("_own").over(before), F.lit(0))
    return own.withColumn(out, F.when(F.col(order) == F.max(order).over(group), left).otherwise(F.col("_own"))).drop("_own")
