"""Small helpers that several operators of this package share."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone, a null text as the empty one, so that no other column can clash by name."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def lower_ascii(text: Column | str) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def id_remainder(n: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task turns fewer texts into Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
