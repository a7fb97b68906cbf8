"""Queries over pooling, selection and the hybrid sequence."""

from __future__ import annotations

import sys
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import tokens
from ..functions.vectors import l2_normalize
from ..operators import pooling as P, selection as R
from ..operators.assembly import drawn_ratio, pad_memories as pad_lists
from ..operators.segments import PART, VEC, bytes_of, segment_rows, spread, token_rows
from .catalog import query
from .fixtures import (POOLED_SQL, RANK_SQL, RATIOS, SEGMENT, SIM_SQL, VEC_TEXT, VECTOR_SQL, positives, qa, r4, sql_draw, sql_hash, sql_mean,
                       sql_tokens, sql_vec, ten_thousandths, vec_text, vectors)

# what runs inside tasks travels to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEG = "seg_idx"
KEY = ["example_id", "seg_idx"]


# A digest holds every value of a vector: whole ten-thousandths, each times its place.
DIGEST = "list_dot_product(list_transform({0}, lambda x: floor(x * 10000 + 0.5)), range(1, len({0}) + 1)::DOUBLE[])::BIGINT"


def vec_digest(vec) -> Column:
    places = F.transform(vec, lambda x, i: F.floor(x * 10000 + 0.5) * (i + 1))
    return F.aggregate(places, F.lit(0).cast("long"), lambda total, x: total + x)


def row_digest(vec) -> Column:
    """``vec_digest`` of vectors that are a row each, a batch at a time; they have no null values."""
    return F.arrow_udf(_row_digest, T.LongType())(vec)


def _row_digest(vec: pa.Array) -> pa.Array:
    lengths = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + 1
    totals = np.concatenate(([0], np.cumsum(ten_thousandths(vec.flatten()) * places)))
    return pc.if_else(vec.is_valid(), pa.array(totals[ends] - totals[ends - lengths]), None)


ROW_DIGEST = (_row_digest, "bigint")


class Job:
    """The steps of the compression over one set of examples, each built from the one before."""

    def __init__(self, spark, sf):
        self.table = vectors(spark, sf)
        self.examples = qa(spark, sf)
        records = self.examples.select("example_id", "question", "document").where("example_id is not null")
        if self.table.fits_broadcast:
            # what is worked out in the record's row needs no placing
            records = spread(records)
        else:
            self.table = replace(self.table, meets=records.agg(F.sum(bytes_of(records))).first()[0] or 0)
        self.records = records
        self.segments = self.cut(SEGMENT)
        self.tokens = token_rows(self.segments, SEGMENT)

    def cut(self, size: int, beside: bool = False, asked: bool = True) -> DataFrame:
        """The query, where it is ``asked``, as segment -1 and the document in segments of ``size``; ``beside`` the vectors that pooling
        them asks, if the table is not sent."""
        query = "question" if asked else None
        if not beside or self.table.fits_broadcast:
            return segment_rows(self.records, "example_id", query, "document", size)
        texts = ["question", "document"] if asked else ["document"]
        placed = P.in_parts(self.records.select("example_id", *texts), self.table, ["example_id"], texts)
        return segment_rows(placed, "example_id", query, "document", size, [PART, VEC])

    def chosen(self, ratio: float, vecs: str | None = None, reading: P.Reading = P.WHOLE) -> DataFrame:
        """The document segments with their keep flag; ``vecs`` are the vectors that are asked next, by their ``reading``."""
        return R.chosen_segments(self.records, self.table, ratio, SEGMENT, vecs=vecs, reading=reading)

    @property
    def dim(self) -> int:
        return self.table.dim

    @property
    def pooled(self) -> DataFrame:
        return R.pooled_segments(self.cut(SEGMENT, True), self.table)

    @property
    def sims(self) -> DataFrame:
        return R.segment_similarity(self.pooled)

    @property
    def light_sims(self) -> DataFrame:
        """Similarities without vectors."""
        return R.similarities(self.records, self.table, SEGMENT).select(*KEY, "n_tokens", "sim")

    @property
    def ranked(self) -> DataFrame:
        return R.ranked_segments(self.light_sims)

    def chunks(self, merge: int, beside: bool = False) -> DataFrame:
        """The document's chunks: a chunk is a segment of ``merge`` tokens."""
        return self.cut(merge, beside, asked=False).withColumnRenamed("seg_idx", "chunk")

    def chunk_pool(self, merge: int, **how) -> DataFrame:
        """Means of ``merge`` consecutive vectors; the tail is averaged over its own length."""
        return P.pool_groups(self.chunks(merge, True), ["example_id", "chunk"], self.table, F.col("words"), **how)


def flagship(spark, sf) -> DataFrame:
    """Similarity, rank and keep flag of every segment."""
    return Job(spark, sf).ranked.select(
        "example_id", SEG, r4("sim").alias("sim"), F.col("rank").cast("long").alias("rank"),
        R.keep_flag(0.25).alias("keep"))


@query("mean_pool", f"WITH {POOLED_SQL} SELECT example_id, seg_idx::BIGINT AS seg_idx, n_tokens, {sql_vec('vec')} AS vec FROM pooled")
def mean_pool(spark, sf):
    return Job(spark, sf).pooled.select("example_id", SEG, "n_tokens", vec_text(F.col("vec")).alias("vec"))


@query("masked_mean_pool", f"""WITH {VECTOR_SQL}, m AS ({sql_mean('tv', 'example_id, seg_idx', '(len(token) > 3)::INT::DOUBLE')})
SELECT example_id, seg_idx::BIGINT AS seg_idx, {sql_vec('vec')} AS vec FROM m""")
def masked_mean_pool(spark, sf):
    job = Job(spark, sf)
    mask = F.transform("words", lambda w: (F.length(w) > 3).cast("double"))
    pooled = P.pool_groups(job.cut(SEGMENT, True), KEY, job.table, F.col("words"), mask)
    return pooled.select("example_id", SEG, vec_text(F.col("vec")).alias("vec"))


CHUNK_SQL = VECTOR_SQL + """,
ch AS (SELECT example_id, pos // 8 AS chunk, pos, v FROM tv WHERE seg_idx >= 0)"""


def chunk_rows(df):
    return df.select("example_id", F.col("chunk").cast("long").alias("chunk"), vec_text(F.col("vec")).alias("vec"))


@query("chunk_pool", f"WITH {CHUNK_SQL}, m AS ({sql_mean('ch', 'example_id, chunk')}) SELECT example_id, chunk, {sql_vec('vec')} AS vec FROM m")
def chunk_pool(spark, sf):
    job = Job(spark, sf)
    return chunk_rows(job.chunk_pool(8))


@query("chunk_pool_padded", f"WITH {CHUNK_SQL}, m AS ({sql_mean('ch', 'example_id, chunk', '1.0', '8.0')}) SELECT example_id, chunk, {sql_vec('vec')} AS vec FROM m")
def chunk_pool_padded(spark, sf):
    job = Job(spark, sf)
    return chunk_rows(job.chunk_pool(8, fixed=8.0))


@query("pad_memories", f"""WITH {VECTOR_SQL}, ch AS (SELECT example_id, pos // 64 AS chunk, v FROM tv WHERE seg_idx >= 0),
m AS ({sql_mean('ch', 'example_id, chunk')}),
n AS (SELECT example_id, count(*) AS n, sum((chunk + 1) * {DIGEST.format('vec')})::BIGINT AS digest FROM m GROUP BY example_id),
w AS (SELECT *, max(n) OVER (PARTITION BY example_id // 4) AS width FROM n)
SELECT example_id, width::BIGINT AS width, repeat('1', n::INT) || repeat('0', (width - n)::INT) AS mask, digest FROM w""")
def pad_memories(spark, sf):
    """Memories of 64 tokens each as one list per record, padded in batches of four; ``digest`` holds every padded value, each times its places."""
    job = Job(spark, sf)
    pooled = job.chunk_pool(64)
    lists = pooled.groupBy("example_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "vec"))).alias("_l")).select(
        "example_id", F.expr("example_id div 4").alias("batch"), F.col("_l.vec").alias("memories"))
    rows = F.transform("padded", lambda vec, i: vec_digest(vec) * (i + 1))
    return pad_lists(lists, "memories", "batch", job.dim).select(
        "example_id", F.size("padded").cast("long").alias("width"),
        F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"),
        F.aggregate(rows, F.lit(0).cast("long"), lambda total, x: total + x).alias("digest"))


@query("weighted_chunk_pool", f"""WITH {CHUNK_SQL}, q AS ({sql_mean('(SELECT * FROM tv WHERE seg_idx = -1)', 'example_id')}),
d AS (SELECT ch.*, exp(list_dot_product(ch.v, q.vec)) AS e FROM ch JOIN q USING (example_id)),
m AS ({sql_mean('d', 'example_id, chunk', 'e', 'sum(wt)')}) SELECT example_id, chunk, {sql_vec('vec')} AS vec FROM m""")
def weighted_chunk_pool(spark, sf):
    job = Job(spark, sf)
    asked = job.pooled.where("seg_idx = -1").select("example_id", F.col("vec").alias("query_vec"))
    rows = job.chunks(8).join(asked, "example_id")
    return chunk_rows(P.pool_groups(rows, ["example_id", "chunk"], job.table, F.col("words"), query="query_vec", score="dot"))


MEMORY_SQL = VECTOR_SQL + f""",
ch AS (SELECT example_id, seg_idx, (pos - seg_idx * {SEGMENT}) // 8 AS chunk, v FROM tv WHERE seg_idx >= 0),
m AS ({sql_mean('ch', 'example_id, seg_idx, chunk')})"""


@query("cumulative_memory", f"""WITH {MEMORY_SQL} SELECT example_id, seg_idx::BIGINT AS seg_idx,
row_number() OVER (PARTITION BY example_id ORDER BY seg_idx, chunk) - 1 AS mem_pos,
count(*) OVER (PARTITION BY example_id ORDER BY seg_idx) AS visible, {sql_vec('vec')} AS vec FROM m""")
def cumulative_memory(spark, sf):
    """A memory per eight tokens of a segment; after segment i those with mem_pos below its ``visible`` are seen."""
    job = Job(spark, sf)
    chunks = R.visible_memories(job.cut(SEGMENT, True, asked=False), SEGMENT, 8)
    # a vector is printed where it lies, as a row of text is half as long and needs no second pass
    pooled = P.pool_groups(chunks, [*KEY, "chunk", "mem_pos", "visible"], job.table, F.col("words"), reading=VEC_TEXT)
    return pooled.select("example_id", SEG, "mem_pos", "visible", "vec")


@query("minmax_scale", f"""WITH {SIM_SQL} SELECT example_id, seg_idx::BIGINT AS seg_idx,
round(2.0 * (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w + 1e-8), 4) AS scaled FROM sims WINDOW w AS (PARTITION BY example_id)""")
def minmax_scale(spark, sf):
    sims = Job(spark, sf).light_sims
    return P.minmax_scale(sims, "example_id", "sim", 2.0).select("example_id", SEG, r4("scaled").alias("scaled"))


# A block: the first 512 tokens of a segment, of the question or, as one segment, of the document, without the first and the last.
BLOCK_SQL = VECTOR_SQL + f""",
spot AS (SELECT *, pos - greatest(seg_idx, 0) * {SEGMENT} AS r, count(*) OVER (PARTITION BY example_id, seg_idx) AS n FROM tv),
inner_tokens AS (SELECT example_id, seg_idx, v FROM spot WHERE r BETWEEN 1 AND least(n, 512) - 2),
blocks AS MATERIALIZED ({sql_mean('inner_tokens', 'example_id, seg_idx')})"""


@query("block_embedding", f"""WITH {VECTOR_SQL}, n AS (SELECT example_id, least(count(*), 512) AS n FROM tv WHERE seg_idx >= 0 GROUP BY 1),
b AS (SELECT tv.example_id, v FROM tv JOIN n USING (example_id) WHERE seg_idx >= 0 AND pos BETWEEN 1 AND n - 2),
m AS ({sql_mean('b', 'example_id')})
SELECT example_id, coalesce(n_tokens, 0) AS n_tokens, CASE WHEN vec IS NULL
THEN array_to_string(list_transform(range((SELECT max(len(v)) FROM ve)), lambda x: 0), ',') ELSE {sql_vec('vec')} END AS vec
FROM n LEFT JOIN m USING (example_id)""")
def block_embedding(spark, sf):
    """The whole document as one segment, cut to 512 tokens, first and last dropped, mean of the rest; none left: the zero vector."""
    job = Job(spark, sf)
    whole = job.records.select("example_id", F.lit(0).cast("long").alias(SEG), tokens(F.col("document")).alias("words"))
    return R.block_embeddings(whole, job.table).select("example_id", "n_tokens", vec_text(F.col("vec")).alias("vec"))


@query("l2_normalize", f"""WITH {POOLED_SQL}, l AS (SELECT *, greatest(sqrt(list_dot_product(vec, vec)), 1e-12) AS len FROM pooled)
SELECT example_id, seg_idx::BIGINT AS seg_idx, {sql_vec('list_transform(vec, lambda y: y / len)')} AS vec FROM l""")
def l2_normalized(spark, sf):
    job = Job(spark, sf)
    return job.pooled.select("example_id", SEG, vec_text(l2_normalize(F.col("vec"))).alias("vec"))


@query("segment_similarity", f"WITH {SIM_SQL} SELECT example_id, seg_idx::BIGINT AS seg_idx, n_tokens, round(sim, 4) AS sim FROM sims")
def segment_similarity(spark, sf):
    return Job(spark, sf).light_sims.select("example_id", SEG, "n_tokens", r4("sim").alias("sim"))


@query("segment_probs", f"""WITH {SIM_SQL} SELECT example_id, seg_idx::BIGINT AS seg_idx,
round(exp(sim) / sum(exp(sim)) OVER (PARTITION BY example_id), 4) AS prob FROM sims""")
def segment_probs(spark, sf):
    sims = Job(spark, sf).light_sims
    return R.softmax_share(sims, "example_id", "sim", "prob").select("example_id", SEG, r4("prob").alias("prob"))


@query("topk_keep", f"""WITH {RANK_SQL} SELECT example_id, seg_idx::BIGINT AS seg_idx, round(sim, 4) AS sim, rank,
rank <= floor(0.25::DOUBLE * n_segments) AS keep FROM ranked""")
def topk_keep(spark, sf):
    return flagship(spark, sf)


DRAWN_RATIO = f"(1.0::DOUBLE - {sql_draw('example_id // 4', 42, 1 << 24)} / {float(1 << 24)}::DOUBLE)"


@query("topk_keep_drawn", f"""WITH {RANK_SQL} SELECT example_id, seg_idx::BIGINT AS seg_idx, rank,
rank <= floor({DRAWN_RATIO} * n_segments) AS keep FROM ranked""")
def topk_keep_drawn(spark, sf):
    """The selection with a ratio drawn per batch of four, as training takes it."""
    ratio = drawn_ratio(F.expr("example_id div 4"), 42)
    return light_ranked(Job(spark, sf)).select(
        "example_id", SEG, F.col("rank").cast("long").alias("rank"), R.keep_flag(ratio).alias("keep"))


@query("all_compress", f"WITH {RANK_SQL} SELECT example_id, count(*) AS n_segments, 0::BIGINT AS n_kept, count(*) AS comp_len FROM ranked GROUP BY 1")
def all_compress(spark, sf):
    """Keeps nothing: the same pipeline with ratio 0."""
    stats = R.compression_per_example(Job(spark, sf).ranked.select(*KEY, "n_tokens", "n_segments", "rank"), [0.0])
    return stats.select("example_id", "n_segments", "n_kept", "comp_len")


@query("sample_ratio", f"""SELECT doc_id AS example_id, round(1.0 - {sql_draw('doc_id // 4', 42, 1 << 24)} / {float(1 << 24)}, 6)::DOUBLE AS ratio FROM documents""")
def sample_ratio(spark, sf):
    return qa(spark, sf).select("example_id", F.round(drawn_ratio(F.expr("example_id div 4"), 42), 6).alias("ratio"))


# Ranks without vectors, worked out once; the question's vector once per example.
SKIM_SQL = RANK_SQL + f""",
picked AS MATERIALIZED (SELECT example_id, seg_idx, rank <= floor(0.25::DOUBLE * n_segments) AS keep FROM ranked),
att AS (SELECT tv.example_id, tv.seg_idx, tv.v, exp(coalesce(list_cosine_similarity(tv.v, q.vec), 0)) AS e
        FROM tv JOIN picked c ON c.example_id = tv.example_id AND c.seg_idx = tv.seg_idx AND NOT c.keep
        LEFT JOIN (SELECT example_id, vec FROM pooled WHERE seg_idx = -1) q ON q.example_id = tv.example_id),
skim AS MATERIALIZED ({sql_mean('att', 'example_id, seg_idx', 'e', 'sum(wt)')})"""


@query("skim_vector", f"WITH {SKIM_SQL} SELECT example_id, seg_idx::BIGINT AS seg_idx, {sql_vec('vec')} AS vec FROM skim")
def skim_vector(spark, sf):
    job = Job(spark, sf)
    return R.skim_vectors(job.chosen(0.25, "summaries"), job.table).select("example_id", SEG, vec_text(F.col("skim_vec")).alias("vec"))


HYBRID_SQL = SKIM_SQL + """,
hybrid AS (
  SELECT example_id, seg_idx, pos AS src_pos, 'token' AS kind, token FROM tk JOIN picked USING (example_id, seg_idx) WHERE keep
  UNION ALL
  SELECT example_id, seg_idx, -1, 'summary', NULL FROM skim)"""

# a word's digest is worked out once
DIGEST_SQL = SKIM_SQL + f""",
digests AS MATERIALIZED (SELECT vec_id, {DIGEST.format('v')} AS digest FROM ve),
hybrid AS (
  SELECT example_id, seg_idx, pos AS src_pos, 'token' AS kind, token, digest
  FROM tid JOIN picked USING (example_id, seg_idx) JOIN digests USING (vec_id) WHERE keep
  UNION ALL
  SELECT example_id, seg_idx, -1, 'summary', NULL, {DIGEST.format('vec')} FROM skim)"""


@query("hybrid_context", f"""WITH {DIGEST_SQL} SELECT example_id, seg_idx::BIGINT AS seg_idx, src_pos::BIGINT AS src_pos, kind, token,
digest FROM hybrid""")
def hybrid_context(spark, sf):
    """``digest`` holds every value of a row's vector: whole ten-thousandths, each times its place."""
    job = Job(spark, sf)
    # digests are made where the vectors lie: a row with a token's vector would be sixty times its token
    return R.hybrid_vectors(job.chosen(0.25, "all", ROW_DIGEST), job.table, SEGMENT, reading=ROW_DIGEST).select(
        "example_id", SEG, "src_pos", "kind", "token", F.col("vec").alias("digest"))


@query("compact_sequence", f"""WITH {HYBRID_SQL} SELECT example_id, row_number() OVER (PARTITION BY example_id ORDER BY seg_idx, src_pos) - 1 AS new_pos,
seg_idx::BIGINT AS seg_idx, kind, token FROM hybrid""")
def compact_sequence(spark, sf):
    rows = R.hybrid_rows(Job(spark, sf).chosen(0.25), SEGMENT)
    return R.compact(rows, ["seg_idx", "src_pos"]).select("example_id", "new_pos", SEG, "kind", "token")


RATIO_VALUES = ", ".join(f"({r}::DOUBLE)" for r in RATIOS)
STATS_SQL = RANK_SQL + f""",
stats AS (
  SELECT example_id, ratio, count(*) AS n_segments, count(*) FILTER (k) AS n_kept, avg(n_tokens) AS avg_seg_len,
         max(n_tokens) AS max_seg_len, sum(n_tokens)::BIGINT AS org_len, sum(CASE WHEN k THEN n_tokens ELSE 1 END)::BIGINT AS comp_len
  FROM (SELECT r.*, ratio, rank <= floor(ratio * n_segments) AS k FROM ranked r CROSS JOIN (VALUES {RATIO_VALUES}) AS v(ratio))
  GROUP BY example_id, ratio)"""


def light_ranked(job: Job) -> DataFrame:
    """The ranks without vectors, so that what is repeated per ratio stays small."""
    return job.ranked.select(*KEY, "n_tokens", "n_segments", "rank")


@query("compression_stats", f"""WITH {STATS_SQL} SELECT example_id, n_segments, n_kept, n_segments - n_kept AS n_compressed,
round(avg_seg_len, 4) AS avg_seg_len, max_seg_len, org_len, comp_len, round(n_kept / n_segments, 4) AS kept_rate,
round(1 - comp_len / (n_segments * max_seg_len), 4) AS actual_compression FROM stats WHERE ratio = 0.25""")
def compression_stats(spark, sf):
    return R.compression_per_example(light_ranked(Job(spark, sf)), [0.25]).select(
        "example_id", "n_segments", "n_kept", "n_compressed", r4("avg_seg_len").alias("avg_seg_len"), "max_seg_len",
        "org_len", "comp_len", r4("kept_rate").alias("kept_rate"), r4("actual_compression").alias("actual_compression"))


@query("ratio_sweep", f"WITH {STATS_SQL} SELECT example_id, ratio, n_segments, n_kept, org_len, comp_len FROM stats")
def ratio_sweep(spark, sf):
    return R.compression_per_example(light_ranked(Job(spark, sf)), RATIOS).select(
        "example_id", "ratio", "n_segments", "n_kept", "org_len", "comp_len")


LOSS_SQL = SIM_SQL + """,
pos AS (SELECT doc_id AS example_id, unnest(CASE WHEN toxic = 1 THEN [0, 999] WHEN quality = 1 THEN [0] ELSE []::INT[] END) AS seg_idx FROM labels),
z AS (SELECT s.example_id, exp(sim / 0.05) AS e, p.seg_idx IS NOT NULL AS positive FROM sims s LEFT JOIN pos p USING (example_id, seg_idx)),
loss AS (SELECT example_id, count(*) FILTER (positive) AS n_positive,
  -ln((coalesce(sum(e) FILTER (positive), 0) + 1e-8) / (sum(e) + 1e-8)) AS loss FROM z GROUP BY 1 HAVING n_positive > 0)"""


def example_losses(spark, sf):
    return R.contrastive_loss(Job(spark, sf).light_sims, positives(spark, sf))


@query("contrastive_loss", f"WITH {LOSS_SQL} SELECT example_id, n_positive, round(loss, 4) + 0.0 AS loss FROM loss")
def contrastive_loss(spark, sf):
    return example_losses(spark, sf).select("example_id", "n_positive", (r4("loss") + F.lit(0.0)).alias("loss"))


@query("contrastive_loss_mean", f"WITH {LOSS_SQL} SELECT count(*) AS n_valid, round(sum(loss) / greatest(count(*), 1), 4) AS loss FROM loss")
def contrastive_loss_mean(spark, sf):
    return R.mean_loss(example_losses(spark, sf)).select("n_valid", r4("loss").alias("loss"))


# No, one or three queries by example: the question, and the question's halves; the positive of a query is the segment of its number.
MANY_SQL = VECTOR_SQL + f""",
many AS (SELECT example_id, unnest(generate_series(0, len(q) - 1)) AS query_id, unnest(q) AS query FROM (
  SELECT example_id, CASE example_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [question] ELSE [question, answers[1], answers[2]] END AS q FROM qa)),
mt AS (SELECT example_id, query_id, {sql_hash('w')} % (SELECT count(*) FROM embeddings) AS vec_id
       FROM (SELECT example_id, query_id, unnest({sql_tokens('query')}) AS w FROM many)),
mv AS (SELECT example_id, query_id, v FROM mt JOIN ve USING (vec_id)),
mq AS ({sql_mean('mv', 'example_id, query_id')}),
pooled AS ({sql_mean('(SELECT * FROM tv WHERE seg_idx >= 0)', 'example_id, seg_idx')}),
z AS (SELECT m.example_id, m.query_id, exp(list_cosine_similarity(q.vec, p.vec) / 0.05) AS e,
        p.seg_idx = m.query_id AND m.example_id % 5 <> 0 AS positive
      FROM many m JOIN mq q USING (example_id, query_id) JOIN pooled p ON p.example_id = m.example_id),
loss AS (SELECT example_id, query_id, count(*) FILTER (positive) AS n_positive,
  -ln((coalesce(sum(e) FILTER (positive), 0) + 1e-8) / (sum(e) + 1e-8)) AS loss FROM z GROUP BY ALL HAVING n_positive > 0)"""


def many_queries(job: Job) -> DataFrame:
    """Records with no, one or three queries."""
    question, halves = F.array("question"), F.array("question", F.col("answers")[0], F.col("answers")[1])
    queries = F.when(F.col("example_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("example_id") % 3 == 1, question).otherwise(halves)
    records = job.examples.where("example_id is not null").select("example_id", queries.alias("queries"), "document")
    return spread(records) if job.table.fits_broadcast else records


@query("contrastive_loss_queries", f"WITH {MANY_SQL} SELECT example_id, query_id::BIGINT AS query_id, n_positive, round(loss, 4) + 0.0 AS loss FROM loss")
def contrastive_loss_queries(spark, sf):
    """A loss for each of an example's queries."""
    job = Job(spark, sf)
    records = many_queries(job)
    sims = R.query_similarities(records, job.table, SEGMENT)
    # a query meets one segment at least, so that the queries are those of the similarities, which needn't be worked out twice
    asked = records.select("example_id", F.posexplode("queries").alias("query_id", "_query"))
    wanted = asked.select("example_id", F.col("query_id").cast("long").alias("query_id")).distinct().where("example_id % 5 <> 0").withColumn(
        "pos_seg_ids", F.array(F.col("query_id"), F.lit(999_999).cast("long")))
    losses = R.contrastive_loss(sims, wanted, key=["example_id", "query_id"])
    return losses.select("example_id", "query_id", "n_positive", (r4("loss") + F.lit(0.0)).alias("loss"))


@query("infonce_batch", f"""WITH {POOLED_SQL},
q AS (SELECT example_id, vec FROM pooled WHERE seg_idx = -1), m AS (SELECT example_id, vec FROM pooled WHERE seg_idx = 0),
x AS (SELECT q.example_id, m.example_id = q.example_id AS own, list_dot_product(q.vec, m.vec) / 0.1 AS x
      FROM q JOIN m ON m.example_id // 8 = q.example_id // 8)
SELECT example_id, round(ln(sum(exp(x))) - max(x) FILTER (own), 4) + 0.0 AS loss FROM x GROUP BY 1""")
def infonce_batch(spark, sf):
    """A question against the first segments of its batch of eight examples."""
    sides = Job(spark, sf).pooled.where("seg_idx <= 0").groupBy("example_id").agg(
        F.max_by("vec", -F.col("seg_idx")).alias("query_vec"), F.max_by("vec", "seg_idx").alias("memory_vec"))
    losses = R.batch_infonce(sides.withColumn("batch", F.expr("example_id div 8")), "batch")
    return losses.select("example_id", (r4("loss") + F.lit(0.0)).alias("loss"))


@query("infonce_loss", f"""WITH {SIM_SQL}, x AS (SELECT example_id, seg_idx, list_dot_product(vec, query_vec) / 0.1 AS x FROM sims)
SELECT example_id, round(ln(sum(exp(x))) - max(x) FILTER (seg_idx = 0), 4) + 0.0 AS loss FROM x GROUP BY 1""")
def infonce_loss(spark, sf):
    """The first segment is the positive, all others of the example are negatives."""
    job = Job(spark, sf)
    return R.infonce_loss(job.sims, F.col("seg_idx") == 0).select("example_id", (r4("loss") + F.lit(0.0)).alias("loss"))


SHARE_SQL = BLOCK_SQL + """,
x AS (
  SELECT s.example_id, s.seg_idx, coalesce(list_dot_product(b.vec, q.vec), 0) AS x
  FROM (SELECT DISTINCT example_id, seg_idx FROM tk WHERE seg_idx >= 0) s
  LEFT JOIN blocks b ON b.example_id = s.example_id AND b.seg_idx = s.seg_idx
  LEFT JOIN blocks q ON q.example_id = s.example_id AND q.seg_idx = -1),
share AS (SELECT example_id, seg_idx, x / nullif(sum(x) OVER (PARTITION BY example_id), 0) AS share FROM x)"""


def shares(spark, sf):
    """The allocator's first two steps: block embeddings of segments and question, and their dot shares."""
    job = Job(spark, sf)
    return R.similarity_share(R.block_vectors(job.records, job.table, SEGMENT)).select(*KEY, "share")


@query("similarity_share", f"WITH {SHARE_SQL} SELECT example_id, seg_idx::BIGINT AS seg_idx, round(share, 4) + 0.0 AS share FROM share")
def similarity_share(spark, sf):
    return shares(spark, sf).select("example_id", SEG, (r4("share") + F.lit(0.0)).alias("share"))


@query("allocate_budget", f"""WITH {SHARE_SQL},
o AS (SELECT *, trunc(coalesce(share, 0) * 128)::BIGINT AS own, max(seg_idx) OVER (PARTITION BY example_id) AS last FROM share)
SELECT example_id, seg_idx::BIGINT AS seg_idx, CASE WHEN seg_idx = last THEN 128 - (sum(own) OVER (PARTITION BY example_id) - own) ELSE own END::BIGINT AS slots FROM o""")
def allocate_budget(spark, sf):
    """128 slots shared out by the similarity of block embeddings: the whole chain of the allocator."""
    return R.allocate_budget(shares(spark, sf), 128).select("example_id", SEG, "slots")


HOLES_SQL = VECTOR_SQL + f""",
half AS (SELECT example_id, seg_idx, token, CASE WHEN t.vec_id % 3 <> 0 THEN ve.v END AS v FROM tid t JOIN ve USING (vec_id)),
lens AS (SELECT example_id, seg_idx, count(*) AS n_tokens FROM half GROUP BY ALL),
known AS (SELECT example_id, seg_idx, v FROM half WHERE v IS NOT NULL),
m AS ({sql_mean('known', 'example_id, seg_idx')})"""


@query("mean_pool_holes", f"""WITH {HOLES_SQL} SELECT example_id, seg_idx::BIGINT AS seg_idx, l.n_tokens, CASE WHEN vec IS NULL
THEN array_to_string(list_transform(range((SELECT max(len(v)) FROM ve)), lambda x: 0), ',') ELSE {sql_vec('vec')} END AS vec
FROM lens l LEFT JOIN m USING (example_id, seg_idx)""")
def mean_pool_holes(spark, sf):
    """A vector table without every third id: tokens without a vector count in the length and not in the mean."""
    job = Job(spark, sf)
    holed = P.VectorTable(job.table.frame.where("vec_id % 3 <> 0"), job.table.rows, job.table.dim)
    return R.pooled_segments(job.segments, holed, missing="zero").select(
        "example_id", SEG, "n_tokens", vec_text(F.col("vec")).alias("vec"))


EMPTIED = "CASE WHEN example_id % 3 = 0 THEN '' ELSE document END"


@query("compression_stats_empty", f"""WITH {STATS_SQL.replace("read AS (SELECT example_id, " + sql_tokens('document') + " AS w FROM qa)",
"read AS (SELECT example_id, " + sql_tokens('document') + " AS w FROM qa WHERE example_id % 3 <> 0)")}
SELECT example_id, n_segments, n_kept, org_len, comp_len FROM stats WHERE ratio = 1.0
UNION ALL SELECT example_id, 1::BIGINT, 1::BIGINT, 0::BIGINT, 1::BIGINT FROM qa WHERE example_id % 3 = 0""")
def compression_stats_empty(spark, sf):
    """Every third document is empty: one segment without tokens, whose place in the sequence is one memory."""
    job = Job(spark, sf)
    records = job.records.withColumn("document", F.expr(EMPTIED))
    ranked = R.ranked_segments(R.similarities(records, job.table, SEGMENT))
    return R.compression_per_example(ranked.select(*KEY, "n_tokens", "n_segments", "rank"), [1.0]).select(
        "example_id", "n_segments", "n_kept", "org_len", "comp_len")
