"""Hand-computed cases."""

import pytest
from pyspark.sql import Row, functions as F

from foldline.functions import metrics
from foldline.functions.text import prefix_sums, let, normalize_text, runs, tokens
from foldline.functions.vectors import cosine, dot, l2_normalize
from foldline.operators import assembly as A, pooling as P, selection as R
from foldline.operators.segments import inner_words, segment_count, segment_slots, slices, split_segments, tail_slots, valid_tokens
from foldline.sources.jsonl import dataset_from_path

C = F.col


@pytest.mark.parametrize("text, expected", [
    ("The  Cat, an (old) one!", "cat old one"),
    ("a.n", ""),
    ("Théa an éa the\x1cx", "théa éa x"),
    ("", ""),
])
def test_normalize(one, text, expected):
    assert one(lambda: normalize_text(C("t")), t=text) == expected


@pytest.mark.parametrize("said, answers, accuracy, em, f1", [
    ("x", ["the"], 1.0, 0.0, 0.0),
    ("a", ["the"], 1.0, 1.0, 0.0),
    ("yes sir", ["yes"], 1.0, 0.0, 0.0),
    ("yes", ["yes"], 1.0, 1.0, 1.0),
    ("red red blue", ["red blue blue"], 0.0, 0.0, 2 / 3),
    ("x", ["y", "x"], 1.0, 1.0, 0.0),
])
def test_metrics(one, said, answers, accuracy, em, f1):
    values = [one(lambda n=n: metrics.metric(n)(C("p"), C("a")), p=said, a=answers) for n in ("accuracy", "em", "f1")]
    assert values == pytest.approx([accuracy, em, f1])


def test_no_answers_score_zero(spark):
    row = spark.createDataFrame([("x", [])], "p string, a array<string>")
    assert [row.select(f(C("p"), C("a"))).first()[0] for f in metrics.METRICS.values()] == [0.0, 0.0, 0.0]


def test_metric_names():
    with pytest.raises(KeyError):
        metrics.metric("rouge")
    with pytest.raises(ValueError):
        metrics.register_metric("f1", metrics.token_f1)
    metrics.register_metric("f1", metrics.token_f1, override=True)


def test_whitespace_is_pythons(one):
    text = "a\x1cb\x1fc\x85d　e​f g"
    assert one(lambda: tokens(C("t")), t=text) == text.split()
    assert one(lambda: tokens(C("t")), t=" \n ") == []


def test_slices(one):
    assert [len(s) for s in one(lambda: slices(C("a"), 50), a=list(range(101)))] == [50, 50, 1]
    assert one(lambda: slices(tokens(C("t")), 50), t="") == []


def test_segments_put_back_together(spark):
    df = spark.range(40).select("id", F.sequence(F.lit(0), C("id").cast("int")).alias("w"))
    for size in (1, 7, 1000):
        parts = split_segments(df, "w", size).orderBy("id", "seg_idx").collect()
        for row in df.collect():
            mine = [p for p in parts if p.id == row.id]
            assert [x for p in mine for x in p.tokens] == row.w
            assert all(p.seg_len == size for p in mine[:-1])


def test_segment_count_needs_tokens(spark):
    with pytest.raises(Exception, match="at least one token"):
        spark.range(1).select(segment_count(C("id").cast("int"), 50)).collect()


def test_documents_without_tokens_have_no_segments(spark, tmp_path):
    """empty and blank texts, and one that is null, among others: the query gives what its SQL gives."""
    import duckdb
    from foldline.plans.catalog import ORACLES, QUERIES

    texts = [(1, "a b"), (2, ""), (3, " \t\n "), (4, None), (5, "w " * 1001)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["segment_count"](spark, str(tmp_path)).collect())
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(ORACLES["segment_count"]).fetchall())
    assert got == [(1, 1, 1, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, None, None, None), (5, 21, 143, 2)]


def test_slots_are_all_given_out(spark):
    df = spark.createDataFrame([(1, list(range(120))), (2, list(range(9000)))], "id long, w array<int>")
    rows = segment_slots(df, "w", 50, 500, 128).orderBy("id", "seg_idx").collect()
    assert [len(r.slots) for r in rows if r.id == 1] == [43, 43, 42]
    assert [s for r in rows if r.id == 2 for s in r.slots] == list(range(500, 628))


def test_tail_and_valid(one):
    assert one(lambda: tail_slots(C("a"), 90, 3), a=[1, 2]) == [1, 2, 90, 91, 92]
    assert one(lambda: valid_tokens(C("a"), C("m")), a=[5, 6, 7], m=[1, 0, 1]) == [5, 7]


def test_labels(one):
    labels = one(lambda: A.label_ids(F.lit(5), C("t"), C("m")), t=[7, 8, 0], m=[1, 1, 0])
    assert labels == [-100, -100, 7, 8, -100]


def test_next_tokens(one):
    pairs = one(lambda: A.next_token_pairs(C("i"), C("l")), i=[4, 5, 6], l=[-100, 5, 6])
    assert [tuple(p) for p in pairs] == [(0, 4, 5), (1, 5, 6)]


def test_nested_replacement(spark):
    row = spark.createDataFrame([([[1, 2], [2, 3]],)], "x array<array<int>>")
    assert row.select(A.replace_nested(C("x"), 2, 0, 2)).first()[0] == [[1, 0], [0, 3]]


def test_title_rules(spark):
    ctx = spark.createDataFrame([(("b", ""),), (("b", None),), (("b", "t"),)], "c struct<text: string, title: string>")
    assert [r[0] for r in ctx.select(A.document_text(C("c"))).collect()] == [" b", "b", "t b"]


def test_unknown_name_is_an_error(spark):
    names = spark.createDataFrame([("GOV",)], "d string")
    assert names.select(A.lookup(A.MAX_NEW_TOKENS, C("d"), True)).first()[0] == 512
    assert names.select(A.lookup(A.BATCH_SIZES, C("d"))).first()[0] is None
    with pytest.raises(Exception, match="unknown data set: GOV"):
        names.select(A.lookup(A.BATCH_SIZES, C("d"), True, "data set")).collect()


def test_draws_stay_in_range_and_repeat(spark):
    ids = spark.range(500)
    draw = [A.drawn_cap(C("id"), 2, 5, 7), A.drawn_choice(C("id"), "2,4,8,16,32", 7), A.drawn_ratio(C("id"), 7)]
    first = ids.select("id", *draw).orderBy("id").collect()
    assert first == ids.repartition(5).select("id", *draw).orderBy("id").collect()
    assert {r[1] for r in first} == {2, 3, 4, 5} and {r[2] for r in first} == {2, 4, 8, 16, 32}
    assert all(0 < r[3] <= 1 for r in first)


def test_dataset_name(one):
    assert one(lambda: dataset_from_path(C("p")), p="/data/test-NQ.jsonl") == "NQ"


def test_let_evaluates_the_body_on_the_value(one):
    assert one(lambda: let(C("x") + 1, lambda v: v * v), x=3) == 16


def test_vectors(one):
    assert one(lambda: dot(C("a"), C("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == 11.0
    assert one(lambda: cosine(C("a"), C("b")), a=[0.0, 0.0], b=[3.0, 4.0]) == 0.0
    assert one(lambda: l2_normalize(C("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])


def scalar_rows(spark):
    rows = [(1, i, 1, 1, [float(i + 1)]) for i in range(5)]
    return spark.createDataFrame(rows, "example_id long, pos int, cnt long, live long, vec array<double>").withColumn("chunk", F.expr("pos div 2"))


def test_chunk_pools(spark):
    def means(padded):
        return [r.vec[0] for r in P.chunk_pool(scalar_rows(spark), "example_id", 2, 1, padded).orderBy("chunk").collect()]

    assert means(False) == [1.5, 3.5, 5.0]
    assert means(True) == [1.5, 3.5, 2.5]


def test_masked_mean_without_valid_tokens(spark):
    empty = P.masked_mean(scalar_rows(spark), ["example_id"], 1, F.lit(False)).first()
    assert empty.vec == [0.0]


def test_softmax_pool_with_large_scores(spark):
    pooled = P.softmax_pool(scalar_rows(spark), ["example_id"], C("pos") * 1000.0, 1).first()
    assert pooled.vec == pytest.approx([5.0])


def test_padded_memories(spark):
    lists = spark.createDataFrame([(1, 0, [[1.0], [2.0]]), (2, 0, [[0.0]])], "id long, batch long, m array<array<double>>")
    rows = {r.id: r for r in A.pad_memories(lists, "m", "batch", 1).collect()}
    assert rows[1]["mask"] == [1, 1] and rows[2]["mask"] == [0, 0] and rows[2].padded == [[0.0], [0.0]]


@pytest.mark.parametrize("n, ratio, kept", [(7, 0.125, 0), (100, 0.29, 28), (8, 0.125, 1), (5, 1.0, 5), (5, 0.0, 0)])
def test_kept_by_ratio(spark, n, ratio, kept):
    sims = spark.range(n).select(F.lit(1).alias("example_id"), C("id").alias("seg_idx"), (C("id") % 3 / 10.0).alias("sim"))
    flags = R.ranked_segments(sims).withColumn("keep", R.keep_flag(ratio)).orderBy("seg_idx").collect()
    best = sorted(range(n), key=lambda i: (-(i % 3), i))[:kept]
    assert [r.seg_idx for r in flags if r.keep] == sorted(best)


def test_budget(spark):
    shares = spark.createDataFrame([Row(example_id=1, seg_idx=i, share=s) for i, s in enumerate([0.5, 0.3, 0.2])])
    assert [r.slots for r in R.allocate_budget(shares, 7).orderBy("seg_idx").collect()] == [3, 2, 2]


def test_contrastive_loss_skips_examples_without_positives(spark):
    sims = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.4), (2, 0, 0.1)], "example_id long, seg_idx long, sim double")
    wanted = spark.createDataFrame([(1, [0, 9]), (2, [9])], "example_id long, pos_seg_ids array<int>")
    rows = R.contrastive_loss(sims, wanted).collect()
    assert [(r.example_id, r.n_positive) for r in rows] == [(1, 1)]
    from math import exp, log
    assert rows[0].loss == pytest.approx(-log(exp(10) / (exp(10) + exp(8))))


def test_runs(one):
    assert [tuple(r) for r in one(lambda: runs(C("a")), a=["b", "a", "b", "c", "b"])] == [("a", 1), ("b", 3), ("c", 1)]
    assert one(lambda: runs(tokens(C("t"))), t=" ") == []


def test_inner_words(one):
    assert one(lambda: inner_words(C("a"), 4), a=list("abcdef")) == ["b", "c"]
    assert one(lambda: inner_words(C("a")), a=["a", "b"]) == [] == one(lambda: inner_words(C("a")), a=["a"])


@pytest.mark.parametrize("dim", [1, 64, 65, 512])
def test_means_of_any_width(spark, dim):
    rows = [(k % 2, 1, 1, [float(k * i % 7) for i in range(dim)]) for k in range(6)]
    df = spark.createDataFrame(rows, "example_id long, cnt long, live long, vec array<double>")
    for row in P.masked_mean(df, ["example_id"], dim).collect():
        mine = [r[3] for r in rows if r[0] == row.example_id]
        assert row.n_tokens == 3 and row.vec == pytest.approx([sum(x) / 3 for x in zip(*mine)])


def vector_table_with_holes(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    return P.vector_table(frame)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_a_token_without_a_vector(spark, limit, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_BYTES", limit)
    rows = spark.createDataFrame([(1, 1, 2), (1, 7, 3), (2, None, 0)], "example_id long, vec_id long, cnt long")
    with pytest.raises(Exception, match="no vector for id 7"):
        P.attach_vectors(rows, vector_table_with_holes(spark)).collect()
    got = P.attach_vectors(rows, vector_table_with_holes(spark), "zero")
    assert set(got.columns) == {"example_id", "vec_id", "cnt", "vec", "norm", "live"}
    means = {r.example_id: (r.n_tokens, r.vec) for r in P.masked_mean(got, ["example_id"], 2).collect()}
    assert means == {1: (5, [1.0, 0.0]), 2: (0, [0.0, 0.0])}


def test_words_outside_the_vocabulary_keep_their_place(spark):
    vocab = A.vocabulary(spark.createDataFrame([("a c",)], "t string"), "t")
    rows = A.encode(spark.createDataFrame([(1, "a b c d")], "k long, t string"), "k", "t", vocab).orderBy("pos").collect()
    assert [r.pos for r in rows] == [0, 1, 2, 3] and [r.token_id == -1 for r in rows] == [False, True, False, True]


def test_f1_of_long_answers(one):
    said, truth = " ".join(f"w{i % 700}" for i in range(3000)), " ".join(f"w{i % 900}" for i in range(3000))
    from collections import Counter
    shared = sum((Counter(said.split()) & Counter(truth.split())).values())
    assert one(lambda: metrics.token_f1(C("p"), C("a")), p=said, a=[truth]) == pytest.approx(2 * shared / 6000)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_prefix_sums(spark, n):
    from itertools import accumulate
    values = [(i * 7) % 5 for i in range(n)]
    got = spark.createDataFrame([(values,)], "v array<long>").select(prefix_sums(C("v"))).first()[0]
    assert got == list(accumulate(values))


def test_spans_of_many_turns(spark):
    """Time grows with the turns and not with their square; 8,000 turns in one prompt."""
    import time
    from foldline.operators.conversations import masked_spans
    seconds = []
    for n in (1000, 8000):
        prompt = "".join(f"[INST] question {i} [/INST] an answer </s><s>" for i in range(n))
        df = spark.createDataFrame([("llama-2", prompt)], "t string, p string")
        begun = time.perf_counter()
        spans = df.select(masked_spans(C("p"), C("t"))).first()[0]
        seconds.append(time.perf_counter() - begun)
        assert len(spans) > 0.8 * n  # the last ones lie behind the end, where the separator is no word of its own
        assert all(a.stop <= b.start + 4 for a, b in zip(spans, spans[1:]))
    assert seconds[1] < 12 * seconds[0] + 2
