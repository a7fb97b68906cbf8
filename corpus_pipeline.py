"""A corpus pipeline made of the operators in ``foldline.llm``.

``STAGES`` are (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet below the shared folder and reads them back as the next one's ``docs``. All stages but the last
return the columns of their input.

No SQL is given: byte context trees, linked fingerprints and the packing search aren't queries. The tests hold each stage against
a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldline.llm import language, mixing, packing, personal, simhash
from foldline.llm.queries import tokenizer_file
from foldline.session import stored

REPEAT_LIMIT = 2.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text, without a letter, or without a language that is clearly ahead go."""
    return language.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id."""
    return simhash.keep_one(docs)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; no document goes."""
    return personal.redacted(docs, personal.trained(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources' documents are repeated, twice at most; every document stays once at least."""
    return mixing.remixed(docs, repeat_limit=REPEAT_LIMIT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("language", identify_language),
    ("near_dedup", near_dedup),
    ("personal", redact_personal),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
