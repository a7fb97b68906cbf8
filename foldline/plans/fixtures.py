"""Inputs derived from the test tables, in Spark and, word for word, in DuckDB SQL."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import PUNCTUATION, tokens
from ..operators.conversations import lift_system
from ..operators.pooling import VectorTable, vector_table

# what runs inside tasks travels to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT = 50
RATIOS = [0.25, 0.125, 0.0, 1.0, 0.29]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> VectorTable:
    return vector_table(table(spark, sf_dir, "embeddings"))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example per document: example_id, dataset, document, question, answers.

    The question is a whole benchmark text, the answers are its two halves.
    """
    bench = table(spark, sf_dir, "benchmark")
    words = tokens(F.col("text"))
    items = bench.select("item_id", words.alias("_w"), F.floor(F.size(words) / 2).cast("int").alias("_half"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("example_id"), F.col("lang").alias("dataset"), F.col("text").alias("document"),
        F.pmod("doc_id", F.lit(bench.count())).alias("item_id"))
    return docs.join(items, "item_id").select(
        "example_id", "dataset", "document", F.array_join("_w", " ").alias("question"),
        F.array(F.array_join(F.slice("_w", F.lit(1), F.col("_half")), " "),
                F.array_join(F.slice("_w", F.col("_half") + 1, F.size("_w") - F.col("_half")), " ")).alias("answers"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive documents per example, with titles on the even ones: example_id, ctxs.

    The group is five ids wide, so it holds five documents at most, whatever the data.
    """
    docs = table(spark, sf_dir, "documents")
    ctx = F.struct(
        F.col("doc_id"), F.lit(False).alias("isgold"), F.col("text"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"))
    return docs.groupBy(F.expr("doc_id div 5").alias("example_id")).agg(F.sort_array(F.collect_list(ctx)).alias("ctxs"))


def predictions(examples: DataFrame, *kept: str, shift: Column | None = None) -> DataFrame:
    """A made-up answer per example: near copies, wrapped answers, partial ones, and whole documents, in turn from ``shift`` on."""
    a1, a2 = F.col("answers")[0], F.col("answers")[1]
    kind = (F.col("example_id") + (F.lit(0) if shift is None else shift)) % 4
    said = (
        F.when(kind == 0, F.concat(F.lit("The "), F.upper(a1), F.lit("!")))
        .when(kind == 1, F.concat(F.lit("x "), a2, F.lit(" y")))
        .when(kind == 2, F.concat(F.split(a1, " ")[0], F.lit(" foo bar")))
        .otherwise(F.array_join(tokens(F.col("document")), " "))
    )
    return examples.select("example_id", *kept, said.alias("generation"))


def predictions_by_ratio(examples: DataFrame, ratios: list[float]) -> DataFrame:
    """Predictions that carry the keep ratio they were made at, another kind of answer for each: example_id, ratio, generation."""
    each = examples.select("*", F.posexplode(F.array(*map(F.lit, ratios))).alias("_nth", "ratio"))
    return predictions(each, "ratio", shift=F.col("_nth"))


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive segments per example; 999 has no segment."""
    ids = F.when(F.col("toxic") == 1, F.array(F.lit(0), F.lit(999))).when(F.col("quality") == 1, F.array(F.lit(0))).otherwise(
        F.array().cast("array<int>"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("example_id"), ids.alias("pos_seg_ids"))


def chats(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages and heads of the conversations; with ``names`` each gets a template by its number."""
    messages, heads = lift_system(table(spark, sf_dir, "conversations"))
    if not names:
        return messages, heads
    template = F.array(*[F.lit(n) for n in names])[F.pmod("conv_id", F.lit(len(names))).cast("int")]
    return messages.withColumn("template", template), heads.withColumn("template", template)


def with_images(messages: DataFrame) -> DataFrame:
    """Two image names on every fourth message, none on the others."""
    named = F.array(F.concat(F.lit("img-"), F.col("conv_id")), F.concat(F.lit("img-"), F.col("pos")))
    return messages.withColumn("images", F.when(F.col("pos") % 4 == 0, named).otherwise(F.array().cast("array<string>")))


def vec_text(vec: Column) -> Column:
    """A vector as whole ten-thousandths, so that both engines print it alike."""
    # made for each use, as a function that is kept stays bound to its first session
    return F.arrow_udf(_vec_text, T.StringType())(vec)


def ten_thousandths(values: pa.Array) -> np.ndarray:
    """floor(x * 10000 + 0.5) as whole numbers, as Spark's floor gives them: what is no number is 0, what is too large the largest."""
    x = np.floor(values.to_numpy(zero_copy_only=False) * 10000 + 0.5)
    top = np.iinfo(np.int64).max
    return np.where(x >= 2.0 ** 63, top, np.where(x <= -2.0 ** 63, -top - 1, np.where(np.abs(x) < 2.0 ** 63, x, 0)).astype(np.int64))


def _vec_text(vec: pa.Array) -> pa.Array:
    flat, lengths = vec.flatten(), vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    words = pc.if_else(flat.is_valid(), pa.array(ten_thousandths(flat.fill_null(0.0))).cast(pa.string()), None)
    if flat.null_count:
        # a value that is null is left out
        ends = np.concatenate(([0], np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False))))[ends].astype(np.int32)
        words = words.drop_null()
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words), ",")
    return pc.if_else(vec.is_valid(), text, None)


VEC_TEXT = (_vec_text, "string")


def r4(value: Column | str) -> Column:
    return F.round(value, 4)


# ---- the same in SQL -------------------------------------------------------------------------------

def sql_text(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_tokens(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda w: w <> '')"


def sql_norm_tokens(expr: str) -> str:
    return (f"list_filter(string_split_regex(translate(lower({expr}), {sql_text(PUNCTUATION)}, ''), '\\s+'), "
            "lambda w: w NOT IN ('', 'a', 'an', 'the'))")


def sql_norm(expr: str) -> str:
    return f"array_to_string({sql_norm_tokens(expr)}, ' ')"


def sql_vec(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: floor(x * 10000 + 0.5)::BIGINT), ',')"


def sql_hash(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


def sql_draw(key: str, seed: int, n: int) -> str:
    return f"({sql_hash(f'concat({sql_text(str(seed) + chr(58))}, ({key})::VARCHAR)')} % {n})"


QA_SQL = f"""
items AS (SELECT item_id, {sql_tokens('text')} AS w FROM benchmark),
qa AS (
  SELECT d.doc_id AS example_id, d.lang AS dataset, d.text AS document,
         array_to_string(i.w, ' ') AS question,
         [array_to_string(i.w[1:len(i.w) // 2], ' '), array_to_string(i.w[len(i.w) // 2 + 1:], ' ')] AS answers
  FROM (SELECT *, doc_id % n AS item_id FROM documents CROSS JOIN (SELECT count(*) AS n FROM benchmark)) d
  JOIN items i ON i.item_id = d.item_id)"""

BUNDLE_SQL = """
ctx AS (
  SELECT doc_id // 5 AS example_id, doc_id, text, CASE WHEN doc_id % 2 = 0 THEN source END AS title,
         row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) - 1 AS ord,
         CASE WHEN doc_id % 2 = 0 THEN source || ' ' || text ELSE text END AS formatted
  FROM documents)"""

TOKEN_SQL = QA_SQL + f""",
asked AS (SELECT example_id, {sql_tokens('question')} AS w FROM qa),
read AS (SELECT example_id, {sql_tokens('document')} AS w FROM qa),
tk AS MATERIALIZED (
  SELECT example_id, -1 AS seg_idx, unnest(generate_series(0, len(w) - 1)) AS pos, unnest(w) AS token FROM asked
  UNION ALL
  SELECT example_id, pos // {SEGMENT} AS seg_idx, pos, token FROM (
    SELECT example_id, unnest(generate_series(0, len(w) - 1)) AS pos, unnest(w) AS token FROM read))"""

VECTOR_SQL = TOKEN_SQL + f""",
ve AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
tid AS (
  SELECT t.*, {sql_hash('t.token')} % n AS vec_id FROM tk t CROSS JOIN (SELECT count(*) AS n FROM embeddings)),
tv AS MATERIALIZED (
  SELECT t.example_id, t.seg_idx, t.pos, t.token, ve.v FROM tid t JOIN ve ON ve.vec_id = t.vec_id)"""


def sql_mean(source: str, keys: str, weight: str = "1.0", divisor: str = "greatest(sum(wt), 1.0)") -> str:
    """Weighted mean vector per group as (keys, n_tokens, vec)."""
    return f"""
  SELECT {keys}, max(n) AS n_tokens, list(m ORDER BY d) AS vec FROM (
    SELECT {keys}, d, count(*) AS n, sum(x * wt) / {divisor} AS m FROM (
      SELECT {keys}, {weight} AS wt, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM {source})
    GROUP BY {keys}, d)
  GROUP BY {keys}"""


POOLED_SQL = VECTOR_SQL + f""",
pooled AS MATERIALIZED ({sql_mean('tv', 'example_id, seg_idx')})"""

SIM_SQL = POOLED_SQL + """,
sims AS (
  SELECT s.example_id, s.seg_idx, s.n_tokens, s.vec, q.vec AS query_vec,
         coalesce(list_cosine_similarity(s.vec, q.vec), 0) AS sim
  FROM pooled s LEFT JOIN pooled q ON q.example_id = s.example_id AND q.seg_idx = -1
  WHERE s.seg_idx >= 0)"""

RANK_SQL = SIM_SQL + """,
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY example_id) AS n_segments,
         row_number() OVER (PARTITION BY example_id ORDER BY round(sim, 9) DESC, seg_idx) AS rank
  FROM sims)"""

PREDICTION_SQL = QA_SQL + f""",
predictions AS (
  SELECT example_id, CASE example_id % 4
    WHEN 0 THEN 'The ' || upper(answers[1]) || '!'
    WHEN 1 THEN 'x ' || answers[2] || ' y'
    WHEN 2 THEN string_split(answers[1], ' ')[1] || ' foo bar'
    ELSE array_to_string({sql_tokens('document')}, ' ') END AS generation FROM qa),
normed AS (
  SELECT example_id, dataset, {sql_norm_tokens('generation')} AS p,
         list_transform(answers, lambda a: {sql_norm('a')}) AS g, {sql_norm_tokens('answers[1]')} AS t
  FROM qa JOIN predictions USING (example_id)),
overlap AS (
  SELECT *, array_to_string(p, ' ') AS ps, array_to_string(t, ' ') AS ts,
         coalesce(list_sum(list_transform(list_distinct(t), lambda w:
           least(len(list_filter(p, lambda x: x = w)), len(list_filter(t, lambda y: y = w))))), 0)::DOUBLE AS same
  FROM normed),
scores AS (
  SELECT example_id, dataset,
         (len(list_filter(g, lambda a: contains(ps, a))) > 0)::INT::DOUBLE AS accuracy,
         (len(list_filter(g, lambda a: ps = a)) > 0)::INT::DOUBLE AS em,
         CASE WHEN (ps IN ('yes', 'no', 'noanswer') OR ts IN ('yes', 'no', 'noanswer')) AND ps <> ts THEN 0.0
              WHEN same = 0 THEN 0.0
              ELSE 2 * (same / len(p)) * (same / len(t)) / (same / len(p) + same / len(t)) END::DOUBLE AS f1
  FROM overlap)"""

CHAT_SQL = """
msgs AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
  FROM conversations WHERE role <> 'system'),
heads AS (
  SELECT conv_id, min_by(text, turn) FILTER (role = 'system') AS system FROM conversations GROUP BY conv_id)"""
