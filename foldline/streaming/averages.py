"""Running scores as a stream of prediction files.

Predictions are scored and summed by (data set, batch) where they are read, so a data set that holds most of the rows sends a few sums to
its state and no rows. The state is one row per data set: how many examples so far, and the sum of each score. After each batch the means
over all so far go to a file sink, which writes every trigger's rows once, also after a restart from the same checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.metrics import METRICS, scored

# what runs inside tasks travels to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREDICTIONS = T.StructType([
    T.StructField("example_id", T.LongType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("generation", T.StringType()),
    T.StructField("answers", T.ArrayType(T.StringType())),
])


def running_scores(predictions: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(dataset, batch_id, n_so_far, means) after each batch of a stream of predictions, in the order of the batches in a trigger.

    A batch whose rows come with several triggers has a row for each; the one with the largest ``n_so_far`` is its last.
    """
    names = names or list(METRICS)
    sums = ", ".join(f"{n} double" for n in names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).group_by(["dataset", "batch_id"]).aggregate(
                [("n", "sum"), *[(n, "sum") for n in names]])
            rows = rows.select(["dataset", "batch_id", "n_sum", *[f"{n}_sum" for n in names]]).rename_columns(
                ["dataset", "batch_id", "n", *names])
            yield from rows.to_batches()

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total = list(state.get) if state.exists else [0] + [0.0] * len(names)
        parts = pd.concat(list(frames)).groupby("batch_id", sort=True)[["n", *names]].sum()
        rows = []
        for part in parts.itertuples():
            total = [total[0] + int(part[1]), *[t + float(x) for t, x in zip(total[1:], part[2:])]]
            rows.append((key[0], int(part[0]), total[0], *[t / total[0] for t in total[1:]]))
        state.update(tuple(total))
        yield pd.DataFrame(rows, columns=["dataset", "batch_id", "n_so_far", *names])

    values = scored(predictions, names).select("dataset", "batch_id", F.lit(1).cast("long").alias("n"), *names)
    parts = values.mapInArrow(summed, f"dataset string, batch_id long, n long, {sums}")
    return parts.groupBy("dataset").applyInPandasWithState(
        advance, f"dataset string, batch_id long, n_so_far long, {sums}", f"n long, {sums}", "append", "NoTimeout")


def start_running_scores(spark: SparkSession, folder: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Reads all files that are new in the folder, writes the running scores as Parquet, and ends."""
    rows = spark.readStream.schema(PREDICTIONS).json(folder)
    return running_scores(rows).writeStream.outputMode("append").format("parquet").option("path", sink).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_averages(running: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(dataset, n, means): what the stream said last of each data set."""
    names = names or list(METRICS)
    last = running.groupBy("dataset").agg(F.max_by(F.struct("n_so_far", *names), "n_so_far").alias("last"))
    return last.select("dataset", F.col("last.n_so_far").alias("n"), *[f"last.{n}" for n in names])
