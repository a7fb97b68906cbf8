"""Scores of predictions, their averages, compression ratio and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metrics import METRICS, scored
from .ordering import running_totals

REPORT_ORDER = ("compression_ratio", "accuracy", "em", "f1")


def score_predictions(predictions: DataFrame, examples: DataFrame, names: list[str] | None = None,
                      key: str = "example_id") -> DataFrame:
    """Pairs predictions with answers by example and computes the metrics."""
    return scored(predictions.join(examples, key), names)


def metric_averages(scores: DataFrame, groups: list[str], names: list[str] | None = None) -> DataFrame:
    """Mean of each score; partial sums combine on the map side, so a hot group is no burden."""
    return scores.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in (names or list(METRICS))])


def running_metrics(scores: DataFrame, group: str, batch: str, names: list[str] | None = None) -> DataFrame:
    """Score means over all batches so far, after each batch. Batches are summed first, and the running sums go
    block-wise, so that a data set holding most of the rows is still spread out."""
    names = names or list(METRICS)
    sums = scores.groupBy(group, batch).agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names])
    run = running_totals(sums, [group], batch, {"_n": F.col("n"), **{f"_r_{n}": F.col(n) for n in names}})
    return run.select(group, batch, F.col("_n").alias("n_so_far"), *[(F.col(f"_r_{n}") / F.col("_n")).alias(n) for n in names])


def corpus_compression(lengths: DataFrame, groups: list[str]) -> DataFrame:
    """Sum of original over sum of compressed lengths, one decimal."""
    return lengths.groupBy(*groups).agg(
        F.round(F.try_divide(F.sum("org_len"), F.sum("comp_len")), 1).alias("compression_ratio"))


def summary_report(averages: DataFrame, compression: DataFrame, groups: list[str]) -> DataFrame:
    """Four rows per group in report order: compression ratio, accuracy, EM, F1."""
    wide = compression.join(averages, [c for c in groups if c in averages.columns])
    values = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                       for i, n in enumerate(REPORT_ORDER)])
    return wide.select(*groups, F.inline(values))


def metrics_long(scores: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return scores.unpivot(keys, names, "metric", "value")


def result_rows(df: DataFrame, compression_time: Column, infer_time: Column, memory: Column, groups: list[str]) -> DataFrame:
    """Benchmark rows; latency is compression plus inference time."""
    return df.select(
        "example_id", *groups, compression_time.alias("compression_time"), infer_time.alias("infer_time"),
        F.array("generation").alias("generation"), F.array("answers").alias("answers"),
        (compression_time + infer_time).alias("latency"), memory.alias("memory"),
        F.col("org_len").cast("long").alias("org_len"), F.col("comp_len").cast("long").alias("comp_len"))
