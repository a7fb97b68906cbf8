"""Pooling by gathering, and by a join where the table is too large to be sent."""

import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.functions.text import tokens
from foldline.operators import pooling as P, selection as R
from foldline.plans.catalog import QUERIES

DIM = 5


@pytest.fixture(scope="module")
def drawn():
    draw = random.Random(1)
    vectors = {i * 3: [draw.uniform(-1, 1) for _ in range(DIM)] for i in range(40)}
    groups = [(g, [draw.choice(list(vectors)) for _ in range(draw.choice((0, 1, 2, 9, 60)))]) for g in range(50)]
    rows = [(g, ids, [draw.choice((0.0, 1.0, 2.5)) for _ in ids], [draw.uniform(-1, 1) for _ in range(DIM)] if g % 9 else None) for g, ids in groups]
    return vectors, rows


def plain(vectors, ids, weights, query, score, guard, fixed):
    weights = list(weights) if weights is not None else [1.0] * len(ids)
    if score:
        q = query or [0.0] * DIM
        dots = [sum(a * b for a, b in zip(vectors[i], q)) for i in ids]
        if score == "cosine":
            lengths = [max(math.dist(vectors[i], [0.0] * DIM), 1e-12) * max(math.dist(q, [0.0] * DIM), 1e-12) for i in ids]
            dots = [d / n for d, n in zip(dots, lengths)]
        weights = [w * math.exp(d - max(dots)) for w, d in zip(weights, dots)]
    by = fixed if fixed is not None else max(sum(weights), 1e-300 if score else guard)
    return [sum(w * vectors[i][d] for w, i in zip(weights, ids)) / by for d in range(DIM)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("how", [{}, {"weights": True}, {"score": "cosine"}, {"score": "dot", "weights": True}, {"fixed": 4.0}, {"guard": 3.0}])
def test_both_ways_give_the_plain_sums(spark, drawn, monkeypatch, limit, how):
    monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
    vectors, rows = drawn
    table = P.vector_table(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
    df = spark.createDataFrame(rows, "g long, ids array<long>, w array<double>, q array<double>").repartition(4)
    named = {k: v for k, v in how.items() if k != "weights"}
    got = P.pool_groups(df, ["g"], table, F.col("ids"), F.col("w") if "weights" in how else None,
                        query="q" if "score" in how else None, **named).collect()
    found = {r.g: r for r in got}
    assert len(got) == len(rows)
    for g, ids, weights, query in rows:
        want = plain(vectors, ids, weights if "weights" in how else None, query, how.get("score"), how.get("guard", 1.0), how.get("fixed"))
        assert found[g].n_tokens == len(ids) and found[g].vec == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_tokens_without_a_vector(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
    table = P.vector_table(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>"))
    df = spark.createDataFrame([(1, [1, 7, 7]), (2, []), (3, [7])], "g long, ids array<long>")
    with pytest.raises(Exception, match="no vector for id 7"):
        P.pool_groups(df, ["g"], table, F.col("ids")).collect()
    got = {r.g: (r.n_tokens, r.vec) for r in P.pool_groups(df, ["g"], table, F.col("ids"), missing="zero").collect()}
    assert got == {1: (3, [1.0, 0.0]), 2: (0, [0.0, 0.0]), 3: (1, [0.0, 0.0])}


def test_vectors_of_other_widths_are_an_error(spark):
    table = P.vector_table(spark.createDataFrame([(1, [1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>").coalesce(1))
    with pytest.raises(Exception, match="does not have"):
        P.pool_groups(spark.createDataFrame([(1, [1])], "g long, ids array<long>"), ["g"], table, F.col("ids")).collect()


def test_gathering_neither_shuffles_nor_makes_rows(spark, drawn):
    vectors, rows = drawn
    table = P.vector_table(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
    df = spark.createDataFrame([r[:2] for r in rows], "g long, ids array<long>")
    plan = P.pool_groups(df, ["g"], table, F.col("ids"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_time_per_value_is_flat(monkeypatch):
    """Widths 64 and 2560 over the same number of values: the wide sums take no more than three times as long."""
    seconds = {}
    for width in (64, 2560):
        tokens = (1 << 25) // width
        vectors = np.random.default_rng(0).standard_normal((500, width))
        places = np.random.default_rng(1).integers(0, 500, tokens)
        owner = np.arange(tokens) // 50
        runs = []
        for _ in range(3):
            begun = time.perf_counter()
            P._sums(vectors, places, owner, np.ones(tokens), owner[-1] + 1)
            runs.append(time.perf_counter() - begun)
        seconds[width] = min(runs)
    assert seconds[2560] < 3 * seconds[64]


def test_slices_of_a_long_group(monkeypatch):
    vectors = np.random.default_rng(0).standard_normal((20, 3))
    places, owner, weights = np.arange(1000) % 20, np.repeat([0, 2, 3], [700, 1, 299]), np.linspace(0, 1, 1000)
    whole = P._sums(vectors, places, owner, weights, 5)
    monkeypatch.setattr(P, "VALUES_AT_ONCE", 21)
    assert np.allclose(P._sums(vectors, places, owner, weights, 5), whole) and not whole[[1, 4]].any()


def test_batches_are_worked_on_in_parts(spark, drawn, monkeypatch):
    """Parts of a few tokens give what whole batches give, in all gathered forms."""
    import pyarrow as pa

    vectors, rows = drawn
    table = P.vector_table(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
    asked = [(g, ids, w, q or [0.0] * DIM, [ids[:3], ids[3:]], g % 2 == 0) for g, ids, w, q in rows]
    df = spark.createDataFrame(asked, "g long, ids array<long>, w array<double>, q array<double>, segs array<array<long>>, keep boolean").coalesce(1)

    def results():
        both = df.select("g", P.gather_or_pool(table)("ids", "keep", "q").alias("both"), P.gather_similarities(table)("ids", "segs").alias("sims"),
                         P.gather_products(table)("segs", "segs").alias("products"), P.gather_pool(table, "cosine")(F.col("ids"), F.col("w"), F.col("q")).alias("one"))
        return both.orderBy("g").collect()

    flat = lambda x: [v for y in x for v in flat(y)] if isinstance(x, (list, tuple)) else [x]
    whole = results()
    assert P._cuts(np.array([len(r[1]) for r in rows]), DIM) == [(0, len(rows))]
    monkeypatch.setattr(P, "VALUES_AT_ONCE", 20 * DIM)
    assert len(P._cuts(np.array([len(r[1]) for r in rows]), DIM)) > 5 and P._cuts(np.array([], int), DIM) == []
    parts = results()
    assert [len(flat(r)) for r in parts] == [len(flat(r)) for r in whole] and flat(parts) == pytest.approx(flat(whole), abs=1e-12)
    held = []
    lists = pa.array([ids for _, ids, _, _ in rows], pa.list_(pa.int64()))
    P._in_parts(lambda ids: held.append(len(ids)) or ids, DIM, lists, tokens=P._tokens(lists))
    assert sum(held) == len(rows) and max(held) < len(rows) / 2
    nested = pa.array([[[1, 2], []], None, [], [[3]]], pa.list_(pa.list_(pa.int64())))
    assert P._tokens(nested).tolist() == [2, 0, 0, 1]


def test_a_segment_carries_its_own_words_only(spark, drawn):
    """Rows of a record's segments, which meet Python next, don't have the record's words each."""
    import re

    from foldline.operators import selection as R

    table = P.vector_table(spark.createDataFrame(list(drawn[0].items()), "vec_id long, embedding array<double>"))
    records = spark.createDataFrame([(1, "a b", "c d e f")], "example_id long, question string, document string")
    plan = R.chosen_segments(records, table, 0.5, 2)._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r"Generate inline\(.*\), \[([^\]]*)\], false, \[", plan)
    assert carried and not any("words" in c for c in carried)


def test_vectors_as_text_and_digest(spark):
    from foldline.plans.compression import row_digest, vec_digest
    from foldline.plans.fixtures import vec_text

    rows = [(0, [0.12345, -0.00005, 1e300, -1e300, float("nan"), float("inf"), -0.0]), (1, []), (2, None), (3, [1.0, None, 2.00004999]), (4, [0.1] * 40)]
    df = spark.createDataFrame(rows, "k long, v array<double>").coalesce(1)
    plain = F.array_join(F.transform("v", lambda x: F.floor(x * 10000 + 0.5).cast("string")), ",")
    assert all(r.a == r.b for r in df.select(vec_text(F.col("v")).alias("a"), plain.alias("b")).collect())
    digests = df.where("k <> 3 and k <> 0").union(spark.createDataFrame([(5, [0.12345, -0.00005, -7.5])], df.schema))
    got = digests.select("v", row_digest("v").alias("a"), vec_digest("v").alias("b")).collect()
    assert all(r.a == r.b for r in got if r.v is not None) and len(got) == 4


TEXTS = [(1, "b  a", "a b c\u00a0d\x1ce f g a a"), (2, None, None), (3, "", " \u3000 "), (4, "é 中 a", "x y\u2028é 中 b b b zz a b c\x85d e f g h"), (5, "a", "a")]


def read_plainly(vectors, rows, words, cap):
    words = words if cap is None else words[:cap][1:-1]
    ids = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) % rows for w in words]
    known = [vectors[i] for i in ids if i in vectors]
    return len(words), [sum(v[d] for v in known) / max(len(known), 1) for d in range(DIM)]


@pytest.mark.parametrize("at_once", [1 << 21, 6])
@pytest.mark.parametrize("cap", [None, 4])
def test_records_are_read_as_by_columns(spark, monkeypatch, at_once, cap):
    """Texts cut, hashed and summed in a batch are as words, ids and means by columns; ids 3 and 5 of seven have no vector."""
    monkeypatch.setattr(P, "VALUES_AT_ONCE", at_once)
    monkeypatch.setattr(P, "WORDS_KNOWN", 2)
    vectors = {i: [float(i + 1), float(i * i % 5), -1.0 * i][:DIM] + [1.0] * max(0, DIM - 3) for i in range(7) if i not in (3, 5)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    table = P.VectorTable(P.vector_table(frame).frame, 7, DIM)
    records = spark.createDataFrame(TEXTS, "example_id long, question string, document string").coalesce(1)
    if cap is None:
        found = R.record_similarities(records, table, 5, missing="zero").collect()
        rows = {(r.example_id, i): (n, sim, r.query_vec) for r in found for i, (n, sim) in enumerate(zip(r.n_tokens, r.sims))}
    else:
        rows = {(r.example_id, r.seg_idx): (r.n_tokens, r.vec, r.query_vec) for r in R.block_vectors(records, table, 5, cap, missing="zero").collect()}
    wanted = {}
    for key, question, document in TEXTS:
        words, (_, asked) = (document or "").split(), read_plainly(vectors, 7, (question or "").split(), cap)
        for i, at in enumerate(range(0, max(len(words), 1), 5)):
            n, vec = read_plainly(vectors, 7, words[at:at + 5], cap)
            size = math.hypot(*vec) * math.hypot(*asked)
            wanted[key, i] = (n, vec if cap else (sum(a * b for a, b in zip(vec, asked)) / size if size else 0.0), asked)
    assert rows.keys() == wanted.keys()
    for at, (n, value, asked) in wanted.items():
        assert rows[at][0] == n and rows[at][1] == pytest.approx(value) and rows[at][2] == pytest.approx(asked), at
    with pytest.raises(Exception, match="no vector for id [35]"):
        R.record_similarities(records, table, 5).collect()


def test_words_are_hashed_as_by_columns(spark):
    """The task's hash is the column's, for words in lists and by themselves."""
    import pyarrow as pa

    words = ["", "a", "é", "中文", "a" * 70, "\U0001f600"]
    columns = [r.i for r in spark.createDataFrame([(w,) for w in words], "w string").select(P.token_vector_id(F.col("w"), 1001).alias("i")).collect()]
    assert P.word_ids([w.encode() for w in words], 1001).tolist() == columns
    ids, lengths = P._ids(pa.array([words[:2], None, [], words[2:] + words[:1]], pa.list_(pa.string())), 1001)
    assert ids.tolist() == [*columns, columns[0]] and lengths.tolist() == [2, 0, 0, 5]
    assert P.word_ids([], 7).tolist() == []


def test_white_space_is_that_of_the_columns(spark):
    """Every code point parts words in a task where it does in a column."""
    points = [(c, f"a{chr(c)}b") for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    cut = spark.createDataFrame(points, "c int, t string").select("c", F.size(tokens(F.col("t"))).alias("n")).where("n <> 1")
    assert {r.c: r.n for r in cut.collect()} == {c: len(t.split()) for c, t in points if len(t.split()) != 1}


@pytest.mark.parametrize("name", ["corpus_compression", "similarity_share", "mean_pool", "weighted_chunk_pool"])
def test_words_arent_hashed_one_by_one_by_columns(spark, sf, name):
    """the base conversion of each token's hash was half of the time."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and "md5(" not in plan


def test_block_vectors_stay_in_the_records_row(spark, sf):
    """no vector is shuffled or sorted to meet the question's."""
    plan = QUERIES["similarity_share"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(example_id"):].split("\n")[1]
    assert "first(" not in plan and plan.count("Exchange hashpartitioning(example_id") == 1 and "vec#" not in below.split("[", 1)[1].split("aggregate")[0], below
