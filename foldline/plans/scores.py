"""Queries over answer metrics, averages and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.metrics import METRICS
from ..functions.text import normalize_text
from ..operators import scoring as M, selection as R
from ..operators.assembly import assign_batches
from ..session import new_folder, stored
from ..sources import jsonl as S
from ..streaming.averages import PREDICTIONS, last_averages, start_running_scores
from .catalog import ORACLES, query
from .compression import Job, STATS_SQL, light_ranked
from .fixtures import PREDICTION_SQL, QA_SQL, predictions, predictions_by_ratio, qa, r4, sql_norm, table

REPORT_RATIOS = [0.25, 0.125]


def scores(spark, sf, names: list[str] | None = None) -> DataFrame:
    examples = qa(spark, sf)
    return M.score_predictions(predictions(examples), examples.select("example_id", "dataset", "answers"), names)


@query("normalize_text", f"""SELECT 'doc-' || doc_id AS id, {sql_norm('text')} AS norm FROM documents
UNION ALL SELECT 'item-' || item_id, {sql_norm('text')} FROM benchmark
UNION ALL SELECT 'turn-' || conv_id || '-' || turn, {sql_norm('text')} FROM conversations""")
def normalized(spark, sf):
    norm = normalize_text(F.col("text")).alias("norm")
    return (
        table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), norm)
        .unionByName(table(spark, sf, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("id"), norm))
        .unionByName(table(spark, sf, "conversations").select(F.concat(F.lit("turn-"), "conv_id", F.lit("-"), "turn").alias("id"), norm)))


for _key, _metric in (("score_accuracy", "accuracy"), ("score_em", "em"), ("score_f1", "f1")):
    @query(_key, f"WITH {PREDICTION_SQL} SELECT example_id, round({_metric}, 4) AS {_metric} FROM scores")
    def _one_score(spark, sf, name=_metric):
        return scores(spark, sf, [name]).select("example_id", r4(name).alias(name))


@query("metric_by_name", f"""WITH {PREDICTION_SQL} SELECT example_id, metric, round(value, 4) AS value
FROM scores UNPIVOT (value FOR metric IN (accuracy, em, f1))""")
def metric_by_name(spark, sf):
    long = M.metrics_long(scores(spark, sf), ["example_id"], list(METRICS))
    return long.select("example_id", "metric", r4("value").alias("value"))


@query("score_predictions", f"WITH {PREDICTION_SQL} SELECT example_id, generation, accuracy, em, round(f1, 4) AS f1 FROM scores JOIN predictions USING (example_id)")
def score_predictions(spark, sf):
    return scores(spark, sf).select("example_id", "generation", "accuracy", "em", r4("f1").alias("f1"))


@query("metric_averages", f"""WITH {PREDICTION_SQL} SELECT dataset, count(*) AS n, round(avg(accuracy), 4) AS accuracy, round(avg(em), 4) AS em,
round(avg(f1), 4) AS f1 FROM scores GROUP BY dataset""")
def metric_averages(spark, sf):
    return M.metric_averages(scores(spark, sf), ["dataset"]).select("dataset", "n", *[r4(m).alias(m) for m in METRICS])


@query("running_metrics", f"""WITH {PREDICTION_SQL},
b AS (SELECT *, (row_number() OVER (PARTITION BY dataset ORDER BY example_id) - 1) // 8 AS batch_id FROM scores),
s AS (SELECT dataset, batch_id, count(*) AS n, sum(accuracy) AS a, sum(em) AS e, sum(f1) AS f FROM b GROUP BY ALL)
SELECT dataset, batch_id, sum(n) OVER w::BIGINT AS n_so_far, round(sum(a) OVER w / sum(n) OVER w, 4) AS accuracy,
round(sum(e) OVER w / sum(n) OVER w, 4) AS em, round(sum(f) OVER w / sum(n) OVER w, 4) AS f1
FROM s WINDOW w AS (PARTITION BY dataset ORDER BY batch_id)""")
def running_metrics(spark, sf):
    """The scores are stored, because batches and running sums read them several times."""
    scored = stored(scores(spark, sf).select("example_id", "dataset", *METRICS), "scores")
    batched = assign_batches(scored, "dataset", "example_id", F.lit(8))
    return M.running_metrics(batched, "dataset", "batch_id").select(
        "dataset", "batch_id", "n_so_far", *[r4(m).alias(m) for m in METRICS])


def lengths(spark, sf, told: DataFrame | None = None) -> DataFrame:
    """Original and compressed length per example and ratio, with the data set, or with what ``told`` says of each example."""
    job = Job(spark, sf)
    per_example = R.compression_per_example(light_ranked(job), REPORT_RATIOS)
    return per_example.join(job.examples.select("example_id", "dataset") if told is None else told, "example_id")


CORPUS_SQL = STATS_SQL + """,
corpus AS (SELECT dataset, ratio, round(sum(org_len) / sum(comp_len), 1) AS compression_ratio
           FROM stats JOIN qa USING (example_id) WHERE ratio IN (0.25, 0.125) GROUP BY dataset, ratio)"""


@query("corpus_compression", f"WITH {CORPUS_SQL} SELECT * FROM corpus")
def corpus_compression(spark, sf):
    return M.corpus_compression(lengths(spark, sf), ["dataset", "ratio"])


REPORT_SQL = CORPUS_SQL + "," + PREDICTION_SQL.replace(QA_SQL + ",", "", 1)


@query("summary_report", f"""WITH {REPORT_SQL}, a AS (SELECT dataset, avg(accuracy) AS accuracy, avg(em) AS em, avg(f1) AS f1 FROM scores GROUP BY dataset),
j AS (SELECT * FROM corpus JOIN a USING (dataset))
SELECT dataset, ratio, 0::BIGINT AS line, 'compression_ratio' AS metric, round(compression_ratio, 4) AS value FROM j
UNION ALL SELECT dataset, ratio, 1, 'accuracy', round(accuracy, 4) FROM j
UNION ALL SELECT dataset, ratio, 2, 'em', round(em, 4) FROM j
UNION ALL SELECT dataset, ratio, 3, 'f1', round(f1, 4) FROM j""")
def summary_report(spark, sf):
    averages = M.metric_averages(scores(spark, sf), ["dataset"])
    report = M.summary_report(averages, M.corpus_compression(lengths(spark, sf), ["dataset", "ratio"]), ["dataset", "ratio"])
    return report.select("dataset", "ratio", F.col("line").cast("long").alias("line"), "metric", r4("value").alias("value"))


RATIO_REPORT_SQL = (
    REPORT_SQL.replace("SELECT example_id, CASE example_id % 4", "SELECT example_id, ratio, CASE (example_id + nth) % 4")
    .replace("AS generation FROM qa)", "AS generation FROM qa CROSS JOIN (VALUES (0, 0.25), (1, 0.125)) AS v(nth, ratio))")
    .replace("SELECT example_id, dataset,", "SELECT example_id, dataset, ratio,"))


@query("ratio_report", f"""WITH {RATIO_REPORT_SQL}, a AS (
  SELECT dataset, ratio, avg(accuracy) AS accuracy, avg(em) AS em, avg(f1) AS f1 FROM scores GROUP BY dataset, ratio),
j AS (SELECT * FROM corpus JOIN a USING (dataset, ratio))
SELECT dataset, ratio::DOUBLE AS ratio, unnest([0, 1, 2, 3])::BIGINT AS line, unnest(['compression_ratio', 'accuracy', 'em', 'f1']) AS metric,
round(unnest([compression_ratio, accuracy, em, f1]), 4) AS value FROM j""")
def ratio_report(spark, sf):
    """Predictions are made at a keep ratio: each ratio's report has the scores of its own."""
    examples, groups = qa(spark, sf), ["dataset", "ratio"]
    told = predictions_by_ratio(examples, REPORT_RATIOS)
    scored = M.score_predictions(told, examples.select("example_id", "dataset", "answers"))
    report = M.summary_report(M.metric_averages(scored, groups), M.corpus_compression(lengths(spark, sf), groups), groups)
    return report.select("dataset", F.col("ratio").cast("double").alias("ratio"), F.col("line").cast("long").alias("line"), "metric",
                         r4("value").alias("value"))


RESULT_SQL = STATS_SQL + "," + PREDICTION_SQL.replace(QA_SQL + ",", "", 1) + """,
rows AS (
  SELECT example_id, ratio, dataset, org_len / 1000.0 AS compression_time, (example_id % 7) / 10.0 AS infer_time, generation, answers, org_len, comp_len
  FROM stats JOIN qa USING (example_id) JOIN predictions USING (example_id) WHERE ratio IN (0.25, 0.125))
SELECT example_id, dataset, ratio, generation, array_to_string(answers, '|') AS answers, round(compression_time, 4)::DOUBLE AS compression_time,
round(infer_time, 4)::DOUBLE AS infer_time, round(compression_time + infer_time, 4)::DOUBLE AS latency, 0.0::DOUBLE AS memory, org_len, comp_len FROM rows"""


def benchmark_rows(spark, sf) -> DataFrame:
    """Timings are inputs; here they stand in for measured ones."""
    rows = lengths(spark, sf, predictions(qa(spark, sf), "dataset", "answers"))
    return M.result_rows(rows, F.col("org_len") / 1000.0, (F.col("example_id") % 7) / 10.0, F.lit(0.0), ["dataset", "ratio"])


def flat_results(df: DataFrame) -> DataFrame:
    return df.select(
        "example_id", "dataset", F.col("ratio").cast("double").alias("ratio"), F.col("generation")[0].alias("generation"),
        F.array_join(F.col("answers")[0], "|").alias("answers"), r4("compression_time").alias("compression_time"),
        r4("infer_time").alias("infer_time"), r4("latency").alias("latency"), "memory", "org_len", "comp_len")


@query("result_rows", f"WITH {RESULT_SQL}")
def result_rows(spark, sf):
    return flat_results(benchmark_rows(spark, sf))


@query("write_results", f"WITH {RESULT_SQL}")
def write_results(spark, sf):
    """Written, and written again for one ratio, as a rerun does: each row is there once. The rows are stored, as both writes read them."""
    path, rows = new_folder(spark, "results"), stored(benchmark_rows(spark, sf), "rows")
    S.write_results(rows, path)
    S.write_results(rows.where("ratio = 0.25"), path)
    return flat_results(S.read_results(spark, path, rows.schema))


def streamed(spark, sf) -> DataFrame:
    """Running scores of a stream that reads a folder twice: the second time it has grown, and the state goes on."""
    examples = qa(spark, sf)
    said = predictions(examples).join(examples.select("example_id", "dataset", "answers"), "example_id")
    rows = stored(assign_batches(said, "dataset", "example_id", F.lit(8)), "said")
    paths = {name: new_folder(spark, f"stream-{name}") for name in ("in", "out", "state")}
    for part in ("batch_id < 3", "batch_id >= 3"):
        rows.where(part).select(*PREDICTIONS.names).write.mode("append").json(paths["in"])
        start_running_scores(spark, paths["in"], paths["out"], paths["state"]).awaitTermination()
    return spark.read.parquet(paths["out"])


@query("streaming_metrics", ORACLES["running_metrics"])
def streaming_metrics(spark, sf):
    """The running means by a stream with a state per data set."""
    return streamed(spark, sf).select("dataset", "batch_id", "n_so_far", *[r4(m).alias(m) for m in METRICS])


@query("streaming_averages", ORACLES["metric_averages"])
def streaming_averages(spark, sf):
    """The averages as the stream's last word on each data set."""
    return last_averages(streamed(spark, sf)).select("dataset", "n", *[r4(m).alias(m) for m in METRICS])
