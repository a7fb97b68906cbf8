"""The queries of this package: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bytepairs, ctw, language, licenses, mixing, neighbours, packing, personal, repair, secrets, simhash, sketches, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file() -> str:
    """Where the public tokenizer's vocabulary lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into pieces and packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by fixed patterns and by entropy."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketches of all documents and of their edited texts."""
    return sketches.digest(sketches.compare_with_edits(table(spark, sf_dir, "documents")))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, by code length."""
    return language.predict(table(spark, sf_dir, "documents"))


@query
def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of all documents by context-tree weighting, and the unigram base."""
    return ctw.score(table(spark, sf_dir, "documents"))


@query
def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every twentieth one."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to flattened source weights: every copy taken and its place in its source's stream."""
    taken, exponent = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.withColumn("exponent", F.lit(exponent))


@query
def op2_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, by fixed patterns and a skip-chain field."""
    docs = table(spark, sf_dir, "documents")
    return personal.detect(docs, personal.trained(docs))


@query
def op11_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by byte-level BPE and decoded again, as digests."""
    import public_tokenizers

    return bytepairs.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened to 32 components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged, and the cheapest repair of each."""
    return repair.repair(table(spark, sf_dir, "conversations"))
