import numpy as np
import pytest
from pyspark.sql import types as T

from foldline.llm import whitening
from foldline.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       *[T.StructField(n, T.StringType()) for n in ("x", "n", "component", "width", "count", "task", "data")]])


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) + ("z",) * 7 for i, v in rows], SCHEMA).repartition(3)

    return make


def plain(vectors, keep=32):
    """Whole numbers, exact deviations, eigenvalues and vectors in long double where numpy has it."""
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(np.float64)).astype(object) + 1_000_000
    x = np.array([[int(c) for c in row] for row in x], dtype=object)
    n = len(x)
    exact = n * x - x.sum(axis=0)
    rows = (exact.astype(np.longdouble) / n)
    cov = (rows.T @ rows / n).astype(np.float64)
    _, singular, turn = np.linalg.svd(rows.astype(np.float64), full_matrices=False)
    return (exact**2).sum(axis=1), singular**2 / n, turn, float(np.trace(cov)), rows.astype(np.float64)


def compare(got, ids, vectors, kept, tolerance=1e-7):
    deviations, values, turn, trace, rows = plain(vectors)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(ids) * kept
    whitened = np.array([[by[i, c + 1].whitened for c in range(kept)] for i in ids])
    want = rows @ turn[:kept].T / np.sqrt(values[:kept])
    for c in range(kept):
        away = min(np.abs(whitened[:, c] - want[:, c]).max(), np.abs(whitened[:, c] + want[:, c]).max())
        assert away < tolerance * max(1, np.abs(want[:, c]).max())
        assert abs(by[ids[0], c + 1].explained - values[c] / trace) <= 1e-9 * values[c] / trace + 1e-18
    for i, deviation in zip(ids, deviations):
        assert by[i, 1].deviation == deviation and by[i, 1].n == len(ids)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    assert np.abs(np.cov(whitened.T, bias=True) - np.eye(kept)).max() < 1e-6


def test_against_singular_values_of_all_rows(table):
    draw = np.random.default_rng(1)
    vectors = (draw.standard_normal((300, 6)) * [100, 30, 9, 3, 1, .4] @ draw.standard_normal((6, 6))).astype(np.float32)
    got = whitening.whiten(table([(i, v) for i, v in enumerate(vectors)])).collect()
    compare(got, list(range(300)), vectors, 6)


def test_badly_conditioned(table):
    """Nearly dependent columns, whose smallest variances a plain covariance gives with few right digits."""
    draw = np.random.default_rng(2)
    base = draw.integers(-2**23, 2**23, 40) / 64
    vectors = np.column_stack((base, base + draw.integers(-4, 5, 40) / 64, draw.integers(-9, 10, 40) / 64)).astype(np.float32)
    got = whitening.whiten(table([(i, v) for i, v in enumerate(vectors)])).collect()
    deviations, values, turn, trace, rows = plain(vectors)
    assert values[2] / values[0] < 1e-12
    compare(got, list(range(40)), vectors, 3, tolerance=1e-6)


def test_dependent_columns_give_fewer_components(table):
    draw = np.random.default_rng(3)
    a, b = draw.standard_normal((2, 200))
    vectors = np.column_stack((np.round(a * 64) / 64, np.round(b * 64) / 64, np.full(200, 7.5)))
    vectors = np.column_stack((vectors, vectors[:, 0] * 2, vectors[:, 0] + vectors[:, 1])).astype(np.float32)
    got = whitening.whiten(table([(i, v) for i, v in enumerate(vectors)])).collect()
    compare(got, list(range(200)), vectors, 2)


def test_rows_that_take_no_part(table, spark):
    good = [(i, [i * 1.0, (i * i) % 7, 1.5]) for i in range(20)]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 1.0, 2.0]), (55, [1.0, 2.0]), (56, [9.0])]
    got = whitening.whiten(table(good + bad)).collect()
    assert {r.vec_id for r in got} == set(range(20)) and len(got) == 40
    assert whitening.whiten(table([])).collect() == []
    assert whitening.whiten(table([(1, [1.0, 2.0])] * 5)).collect() == []  # no variance
    assert whitening.whiten(table(bad[:2])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_and_null_ids_stay(table):
    rows = [(1, [1.0, 5.0]), (1, [1.0, 5.0]), (None, [3.0, 2.0]), (2, [0.0, 0.0]), (None, [8.0, 1.0])]
    got = whitening.whiten(table(rows)).collect()
    assert len(got) == 10 and sum(r.vec_id is None for r in got) == 4 and {r.n for r in got} == {5}


def test_deviation_beyond_a_long(table):
    with pytest.raises(Exception, match="not fit a long"):
        whitening.whiten(table([(i, [1e12 * (i % 2), 1.0 * i]) for i in range(50)])).collect()


def test_query(spark, sf):
    got = QUERIES["op13_whitening"](spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    kept = min(32, len(rows[0].embedding))
    compare(got, [r.vec_id for r in rows], [r.embedding for r in rows], kept)
