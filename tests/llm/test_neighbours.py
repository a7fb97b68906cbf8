import numpy as np
import pytest

from foldline.llm import neighbours


def plain(ids, rows, i, k=20):
    own = rows[np.flatnonzero(ids == i)[0]]
    scores = (rows * own).sum(axis=1)
    order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i]
    return [(ids[j], scores[j]) for j in order[:k]]


@pytest.fixture(scope="module")
def table(spark):
    found = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = found.select("vec_id", "embedding").collect()
    return found, np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def test_recall_and_exact_scores(table):
    frame, ids, rows = table
    got = neighbours.nearest(frame, shard_rows=700, query_rows=60).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {i for i in ids if i % 20 == 0}
    at = {i: k for k, i in enumerate(ids)}
    hits = 0
    for i, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[2] == pytest.approx((rows[at[i]] * rows[at[f[1]]]).sum(), abs=1e-13) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & {j for j, _ in plain(ids, rows, i)})
    assert hits >= 0.9 * 20 * len(by)


def test_recall_of_the_partial_search(table):
    frame, ids, rows = table
    assert len(rows) > 200

    def hits(share):
        by = {}
        for r in neighbours.nearest(frame, share=share, least_met=0).collect():
            by.setdefault(r.query_id, set()).add(r.vec_id)
        return sum(len(by[i] & {j for j, _ in plain(ids, rows, i)}) for i in by) / (20 * len(by))

    partial = hits(neighbours.SHARE)
    assert 0.9 <= partial < 1 == hits(1.0)


def test_forest_search_is_partial_and_good(table):
    _, ids, rows = table
    asked = ids % 20 == 0
    key = neighbours.keys(neighbours.plant(np.column_stack((rows, np.zeros(len(rows)))), 16, 32, 5), len(rows),
                          np.column_stack((rows[asked], np.zeros(asked.sum()))))
    assert (key[np.arange(asked.sum()), np.flatnonzero(asked)] == 0).all()  # a row falls into its own leaves
    assert (key == 0).mean() < 0.5


def test_lengths_differ(spark):
    draw = np.random.default_rng(2)
    rows = draw.normal(size=(400, 8)) * draw.exponential(2, (400, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, k=5).collect()
    for i in range(0, 400, 20):
        found = sorted((r["rank"], r.vec_id) for r in got if r.query_id == i)
        assert [f[1] for f in found] == [j for j, _ in plain(np.arange(400), rows, i, 5)]


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (40, [0.5, 0.5, 0.5]), (60, None)]
    shape = "vec_id long, embedding array<double>, shard string, block string, size string, score string"
    frame = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], shape)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(frame).collect())
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (20, 1, 2, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0), (40, 1, 9, 1.5)]
    assert neighbours.nearest(frame.where("vec_id < 0")).count() == 0


def test_equal_vectors_fill_no_tree_forever(spark):
    frame = spark.range(300).selectExpr("id as vec_id", "array(1.0D, 2.0D) as embedding")
    got = neighbours.nearest(frame).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))
