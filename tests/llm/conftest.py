import pytest
from pyspark.sql import types as T

from foldline.llm.queries import tokenizer_file

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *[T.StructField(n, T.StringType()) for n in (
        "fp", "score", "size", "block", "bucket", "word", "n", "spans", "tokens", "copy", "lang_pred", "component_id", "node")],
])
EXTRA = len(DOCUMENT) - 5


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table of (doc_id, text, lang, source) rows, with more columns that clash by name."""
    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t)) + ("x",) * EXTRA for i, t, lang, source in rows]
        return spark.createDataFrame(full, DOCUMENT).repartition(3)

    return make


LONG = " ".join(f"word{i % 977} and" for i in range(40_000))

EDGES = [
    (1, None, "en", "a"), (2, "", None, None), (3, "   \n\t ", "en", "a"), (4, LONG, "en", "a"), (5, "same text here and there", "en", "b"),
    (6, "same text here and there", "en", "b"), (6, "same text here and there", "en", "b"), (7, "é ü ñ 漢字 😀", "fr", None),
    (None, "no id at all", "en", "a"), (None, None, None, None), (8, "x", "en", "c"), (-9, "!!! ??? 123", "de", "c"),
    (2**40, "far away id with some words in it", "en", "a"),
]


@pytest.fixture(scope="session")
def edges(documents):
    return documents(EDGES)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])


@pytest.fixture(scope="session")
def tokenizer():
    return tokenizer_file()


@pytest.fixture(scope="session")
def plain_rows(spark, sf):
    """The small documents table as (doc_id, text, lang, source) tuples."""
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
