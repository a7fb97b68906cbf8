"""JSON-lines input and output with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

RAW_QA = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("answer", T.ArrayType(T.StringType())),
    T.StructField("input", T.StringType()),
])

CONTEXT = T.StructType([
    T.StructField("isgold", T.BooleanType()),
    T.StructField("text", T.StringType()),
    T.StructField("title", T.StringType()),
])

QA_RECORD = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("ctxs", T.ArrayType(CONTEXT)),
    T.StructField("answers", T.ArrayType(T.StringType())),
])


def with_fields(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """The schema with further columns, such as an example id kept through a file."""
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields.items()]])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line; blank lines are skipped and a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_raw_qa(spark: SparkSession, path: str, **fields: T.DataType) -> DataFrame:
    return read_json_lines(spark, path, with_fields(RAW_QA, **fields))


def read_qa_records(spark: SparkSession, path: str, **fields: T.DataType) -> DataFrame:
    return read_json_lines(spark, path, with_fields(QA_RECORD, **fields))


def to_qa_record(raw: DataFrame) -> DataFrame:
    """prompt -> question, input -> the only context, answer -> answers; other columns stay."""
    rest = [c for c in raw.columns if c not in RAW_QA.names]
    ctx = F.struct(F.lit(False).alias("isgold"), F.col("input").alias("text"), F.lit("").alias("title"))
    return raw.select(*rest, F.col("prompt").alias("question"), F.array(ctx).alias("ctxs"), F.col("answer").alias("answers"))


def write_json_lines(df: DataFrame, path: str, partitions: list[str] | None = None, mode: str = "errorifexists") -> None:
    """UTF-8, non-ASCII characters as they are."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partitions) if partitions else writer).json(path)


def _batch_folder(path: str, batch: str | int) -> str:
    name = str(batch)
    if not name or any(c in name for c in "/=\\%:") or name.startswith((".", "_")):
        raise ValueError(f"{batch!r} can't name a batch")
    return f"{path}/batch={name}"


def append_json_lines(df: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Appends to a log. With a ``batch``, its name or number, a repeated append replaces what the earlier one has left:
    the batch is in the log once, or, where its write failed, not at all."""
    if batch is None:
        df.write.mode("append").json(path)
    else:
        df.write.mode("overwrite").json(_batch_folder(path, batch))


def append_text(lines: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Appends a one-column frame of strings; ``batch`` as in ``append_json_lines``."""
    if batch is None:
        lines.write.mode("append").text(path)
    else:
        lines.write.mode("overwrite").text(_batch_folder(path, batch))


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches of a log."""
    return read_json_lines(spark, path, schema).select(*schema.names)


RESULT_PARTS = ["dataset", "ratio", "index"]


def write_results(rows: DataFrame, path: str, index: int = 0) -> None:
    """Benchmark rows in one folder per data set, ratio and index of the run. A rerun replaces the folders that it has rows for and leaves
    all others as they are."""
    rows.withColumn("index", F.lit(index)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *RESULT_PARTS).json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Result rows of all runs, with their ``index``; ``schema`` is that of the rows that were written."""
    return read_json_lines(spark, path, with_fields(schema, index=T.IntegerType()))


def dataset_from_path(path: Column) -> Column:
    """The text after the last '-' up to the next '.'."""
    return F.substring_index(F.substring_index(path, "-", -1), ".", 1)
