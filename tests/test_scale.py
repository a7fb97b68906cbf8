"""Hot keys, large tables and other partitionings give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from foldline.operators import lookup as L, ordering as O, pooling as P, segments as S
from foldline.plans import compression
from foldline.plans.catalog import QUERIES

C = F.col


def hot_rows(spark):
    """One key holds most rows; order values are sparse 62-bit numbers, in runs and at random."""
    draw = random.Random(3)
    orders = list(range(70000)) + [draw.randrange(1 << 62) for _ in range(2000)]
    rows = [("hot", o, o % 5) for o in set(orders)] + [(k, o, 1) for k in "ab" for o in (5, 1 << 50, 9)]
    return rows, spark.createDataFrame(rows, "k string, o long, v long")


def test_running_totals_match_a_plain_loop(spark):
    rows, df = hot_rows(spark)
    expected, seen = {}, {}
    for key, order, value in sorted(rows):
        n, total = seen.get(key, (0, 0))
        seen[key] = (n + 1, total + value)
        expected[key, order] = (n, total + value)
    ranked = O.positions(O.running_totals(df, ["k"], "o", {"total": C("v")}), ["k"], "o")
    assert {(r.k, r.o): (r.pos, r.total) for r in ranked.collect()} == expected


def test_a_join_with_hot_keys(spark):
    """A third of the rows has one key; key 99 is in the rows only, key 9999 in the table only."""
    rows = spark.range(30000).select("id", F.when(C("id") % 3 == 0, F.lit(7)).otherwise(C("id") % 5000).alias("k"))
    table = spark.range(5000).where("id <> 99").select(C("id").alias("k"), (C("id") * 2).alias("twice")).union(
        spark.createDataFrame([(9999, 0)], "k long, twice long"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert {r.k for r in L.hot_keys(counts, "k").collect()} == {7}
    joined = {tuple(r) for r in L.skew_join(rows, table, "k").collect()}
    assert joined == {tuple(r) for r in rows.join(table, "k").select("id", "k", "twice").collect()}


def test_hashed_ranks_are_dense(spark):
    words = spark.range(5000).select(C("id").cast("string").alias("w"))
    ranks = sorted(r.n for r in O.hashed_ranks(words, "w", "n").collect())
    assert ranks == list(range(5000))


def test_long_text_is_put_together_in_order(spark):
    pieces = spark.range(5000).select(F.lit(1).alias("k"), C("id").alias("pos"), F.concat(C("id"), F.lit(" ")).alias("p")).repartition(7)
    text = O.assemble_text(pieces, ["k"], "pos", "p", "text").first().text
    assert text == "".join(f"{i} " for i in range(5000))


@pytest.mark.parametrize("name", ["mean_pool", "skim_vector", "hybrid_context", "weighted_chunk_pool", "block_embedding"])
def test_a_table_too_large_to_broadcast_gives_the_same(spark, sf, name, monkeypatch):
    small = sorted(map(str, QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    assert sorted(map(str, QUERIES[name](spark, sf).collect())) == small


@pytest.mark.parametrize("name", ["topk_keep", "running_metrics", "token_ids", "turn_label_spans"])
def test_the_number_of_partitions_does_not_matter(spark, sf, name):
    many = sorted(map(str, QUERIES[name](spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, QUERIES[name](spark, sf).collect())) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if " Exchange hashpartitioning" in line or line.strip().startswith("Exchange hashpartitioning")]


@pytest.mark.parametrize("name", ["topk_keep", "segment_probs", "compression_stats"])
def test_the_compression_shuffles_light_rows_once(spark, sf, name):
    moved = [line for line in exchanges(QUERIES[name](spark, sf)) if "example_id" in line]
    assert len(moved) == 1 and "REPARTITION" not in moved[0], moved


@pytest.mark.parametrize("name", ["skim_vector", "hybrid_context", "mean_pool", "chunk_pool"])
def test_a_record_keeps_to_its_row(spark, sf, name):
    """With a vector table that is sent to the workers, nothing is shuffled by example, and no vector or text is."""
    assert not [line for line in exchanges(QUERIES[name](spark, sf)) if "example_id" in line]


@pytest.mark.parametrize("name", ["topk_keep", "segment_probs", "compression_stats"])
def test_with_a_large_table_records_are_placed_once(spark, sf, name, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    moved = ran_exchanges(QUERIES[name](spark, sf))
    assert len({line.split("[plan_id")[-1] for line in moved}) == 1, moved


def ran_exchanges(df):
    """Shuffles of whole records in the plan that ran; a reused one is not listed again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.split("\n") if "REPARTITION_BY_NUM" in line and "Exchange" in line and "Reused" not in line]


@pytest.mark.parametrize("name", ["skim_vector", "compact_sequence", "hybrid_context"])
def test_with_a_large_table_the_second_pass_reads_the_same_shuffle(spark, sf, name, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    moved = ran_exchanges(QUERIES[name](spark, sf))
    assert len({line.split("[plan_id")[-1] for line in moved}) == 1, moved


def test_partitions_grow_with_the_bytes_placed(spark):
    """Fifty times the input has fifty times the partitions, whatever number the session's shuffles have."""
    def parts(rows):
        df = spark.range(rows).select(F.when(C("id") % 10 > 0, C("id")).alias("k"), F.repeat(F.lit("é"), 500).alias("text"),
                                      F.array(F.lit("ab"), F.lit(None).cast("string")).alias("more"))
        return S.placed(df, "k", part_bytes=9 * 1010).rdd.getNumPartitions()

    assert (parts(0), parts(10), parts(1000), parts(50_000)) == (8, 8, 100, 5000)


def test_labels_stay_in_the_row(spark):
    from foldline.functions.text import stable_hash
    from foldline.operators.conversations import token_labels
    prompts = spark.createDataFrame([(1, "llama-2", "[INST] a [/INST] b ")], "conv_id long, template string, prompt string")
    assert "Exchange" not in token_labels(prompts, stable_hash)._jdf.queryExecution().executedPlan().toString()


def test_records_are_scanned_with_few_columns(spark, sf):
    plan = compression.flagship(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_memories_are_numbered_without_a_shuffle(spark, sf):
    """Positions and prefixes follow from a segment's own row; segments of 10 with memories of 4 words, 23 words in all."""
    from foldline.operators import selection as R

    words = [f"w{i}" for i in range(23)]
    segments = spark.createDataFrame([(1, 2, words[20:]), (1, 0, words[:10]), (2, 0, []), (1, 1, words[10:20])], "example_id long, seg_idx long, words array<string>")
    found = sorted((r.mem_pos, r.seg_idx, r.chunk, r.visible, r.words) for r in R.visible_memories(segments, 10, 4).collect())
    parts = [(i, k, words[i * 10:(i + 1) * 10][k * 4:k * 4 + 4]) for i in range(3) for k in range(3)]
    parts = [p for p in parts if p[2]]
    assert found == [(n, i, k, sum(p[0] <= i for p in parts), w) for n, (i, k, w) in enumerate(parts)]
    plan = QUERIES["cumulative_memory"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("name", ["topk_keep", "corpus_compression", "write_results", "similarity_share", "compression_stats_empty"])
def test_a_table_too_large_to_send_is_read_by_parts(spark, sf, name, monkeypatch):
    """F16, F17, F19: six times the larger tables have one; tokens are no rows then, and the rows are the same."""
    small = sorted(map(str, QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    large = QUERIES[name](spark, sf)
    assert sorted(map(str, large.collect())) == small
    assert name == "write_results" or "explode(" not in str(compression.Job(spark, sf).light_sims._jdf.queryExecution().optimizedPlan().toString()).replace("posexplode(arrays_zip", "")


@pytest.mark.parametrize("cap", [None, 4])
def test_records_by_parts_equal_those_in_rows(spark, monkeypatch, cap):
    """Words without a vector, texts without words, nulls, and records that aren't placed."""
    from foldline.operators import selection as R

    frame = spark.createDataFrame([(i, [float(i), 1.0, -0.5 * i]) for i in range(7) if i not in (3, 5)], "vec_id long, embedding array<double>")
    table = P.VectorTable(P.vector_table(frame).frame, 7, 3)
    texts = [(i, "a b  c"[: i % 7] if i % 5 else None, " ".join(f"w{i * k % 41}" for k in range(i % 23)) if i % 11 else None) for i in range(60)]
    records = spark.createDataFrame(texts + [(None, "a", "b")], "example_id long, question string, document string").repartition(5)

    def rows():
        found = R.records_in_parts(records, table, 6, cap, missing="zero").collect()
        return sorted((r[0], [round(x, 9) for x in r[1]], list(r[2]), [[round(v, 9) for v in (x if cap else [x])] for x in r[3]]) for r in found)

    whole = rows()
    assert len(whole) == 60
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    assert rows() == whole
    with pytest.raises(Exception, match="no vector for id [35]"):
        R.records_in_parts(records, table, 6, cap).collect()


@pytest.fixture(params=["all vectors to each part", "those of its words"])
def enlarge(request, monkeypatch):
    """A function after which a vector table is too large to be sent, or too large for a task to hold all of it either, with parts of a few records."""
    def done():
        monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
        if request.param == "those of its words":
            monkeypatch.setattr(P, "HELD_BYTES", 0)
            monkeypatch.setattr(P, "PLACED_BYTES", 20_000)
        return request.param

    return done


@pytest.fixture
def large(enlarge):
    return enlarge()


def kept_to_parts(df, large):
    """The plan that ran has no vector or row per token, and shuffles the records once; a second time where parts name their words first."""
    rows = sorted(map(str, df.collect()))
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "posexplode(words" not in plan and "_is_hot" not in plan and "collect_list" not in plan
    moved = [line for line in plan.split("\n") if "REPARTITION_BY_NUM" in line and "Exchange" in line and "Reused" not in line]
    assert len({line.split("[plan_id")[-1] for line in moved}) == (1 if large == "all vectors to each part" else 2), moved
    return rows, plan


def test_the_hybrid_sequence_is_made_in_one_pass_over_parts(spark, sf, enlarge):
    """with a table too large to send, similarity, choice, vectors and digests are one task's; no row has a vector."""
    sent = QUERIES["hybrid_context"](spark, sf)
    rows = sorted(map(str, sent.collect()))
    # where it is sent, digests are made with the vectors too
    assert sent._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("ArrowEvalPython") == 2
    large = enlarge()
    found, plan = kept_to_parts(QUERIES["hybrid_context"](spark, sf), large)
    assert found == rows and plan.count("MapInArrow") == (1 if large == "all vectors to each part" else 2)
    assert "ArrowEvalPython" not in plan and "Window" not in plan


def test_choices_of_parts_are_those_of_columns(spark, large):
    """Ties at nine digits, halves of the ninth, records of one segment."""
    import numpy as np

    from foldline.operators import selection as R

    sims = [0.1234567885, 0.1234567885, 0.123456789, 0.12345678849, -0.5, 0.5, 0.5000000004, 0.0, -0.0, 1.0, 0.25, -1e-12, 1e-12]
    of_record = np.array([4, 3, 1, 5])
    rows = [(r, i, s) for r, n in enumerate(of_record.tolist()) for i, s in enumerate(sims[sum(of_record[:r]):sum(of_record[:r + 1])])]
    ranked = R.ranked_segments(spark.createDataFrame(rows, "example_id int, seg_idx int, sim double"))
    for ratio in (0.0, 0.25, 0.29, 0.5, 2 / 3, 1.0):
        wanted = {(r.example_id, r.seg_idx): r.keep for r in ranked.select("example_id", "seg_idx", R.keep_flag(ratio).alias("keep")).collect()}
        assert dict(zip([r[:2] for r in rows], P._best(np.array(sims), of_record, ratio, R.TIE_DIGITS).tolist())) == wanted


def test_a_part_s_long_texts_nulls_and_missing_vectors(spark, monkeypatch, large):
    """Parts of a few tokens at once; texts without words and null ones, words without a vector."""
    from foldline.operators import selection as R

    frame = spark.createDataFrame([(i, [float(i), 1.0, -0.5 * i]) for i in range(7) if i not in (3, 5)], "vec_id long, embedding array<double>")
    table = P.VectorTable(P.vector_table(frame).frame, 7, 3)
    texts = [(i, "a b  c"[: i % 7] if i % 5 else None, " ".join(f"w{i * k % 41}" for k in range(i % 23)) if i % 11 else None) for i in range(60)]
    records = spark.createDataFrame(texts + [(None, "a", "b")], "example_id long, question string, document string").repartition(5)

    def rows():
        segments = R.chosen_segments(records, table, 0.4, 6, missing="zero", vecs="all")
        hybrid = [(r.example_id, r.seg_idx, r.src_pos, r.kind, r.token or "", *(round(x, 9) + 0.0 for x in r.vec)) for r in
                  R.hybrid_vectors(segments, table, 6, missing="zero").collect()]
        skims = [(r.example_id, r.seg_idx, *(round(x, 9) + 0.0 for x in r.skim_vec)) for r in R.skim_vectors(
            R.chosen_segments(records, table, 0.4, 6, missing="zero", vecs="summaries"), table, missing="zero").collect()]
        return sorted(hybrid), sorted(skims)

    monkeypatch.setattr(P, "VALUES_AT_ONCE", 30)
    parts = rows()
    monkeypatch.setattr(P, "BROADCAST_BYTES", 1 << 20)
    assert rows() == parts and len(parts[0]) > 100
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    with pytest.raises(Exception, match="no vector for id [35]"):
        R.chosen_segments(records, table, 0.4, 6).collect()


def test_memories_are_pooled_in_their_records_parts(spark, sf, enlarge):
    """with a table too large to send, records are shuffled once, beside the vectors, and tokens are no rows."""
    rows = sorted(map(str, QUERIES["cumulative_memory"](spark, sf).collect()))
    large = enlarge()
    found, plan = kept_to_parts(QUERIES["cumulative_memory"](spark, sf), large)
    # memories are printed where they lie
    assert found == rows and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["mean_pool", "chunk_pool", "weighted_chunk_pool", "pad_memories", "mean_pool_holes"])
def test_pooling_by_parts_gives_the_same(spark, sf, name, enlarge):
    rows = sorted(map(str, QUERIES[name](spark, sf).collect()))
    enlarge()
    assert sorted(map(str, QUERIES[name](spark, sf).collect())) == rows


def test_a_part_has_its_vectors_first(spark, large):
    """As many parts as the bytes ask, of about one size; in a partition they lie one after the other."""
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    table = P.vector_table(frame)
    words = spark.range(3000).select("id", F.array(*[F.concat(F.lit("w"), (C("id") * k % 50).cast("string")) for k in range(4)]).alias("words"))
    parted = P.in_parts(words, table, ["id"], ["words"])
    found = parted.select(F.spark_partition_id().alias("at"), F.monotonically_increasing_id().alias("n"), S.PART, "id", f"{S.VEC}.vec_id").orderBy("n").collect()
    assert [(r.at, r[S.PART], r.vec_id is None) for r in found] == sorted((r.at, r[S.PART], r.vec_id is None) for r in found)
    assert sorted(r.id for r in found if r.vec_id is None) == list(range(3000)) and all(r.id is None for r in found if r.vec_id is not None)
    brought = {}
    for r in found:
        brought.setdefault(r[S.PART], []).append(r.vec_id)
    for ids in brought.values():
        own = [i for i in ids if i is not None]
        assert own == sorted(set(own)) and own
    if large == "all vectors to each part":
        rows = [sum(i is None for i in ids) for ids in brought.values()]
        assert len(rows) > 8 and len({r.at for r in found}) == len(brought) and max(rows) < 3 * 3000 / len(rows)


def test_many_queries_meet_their_segments_in_parts(spark, sf, enlarge):
    """with a table too large to send, products are made where the record lies, once, and not for a row per token."""
    rows = sorted(map(str, QUERIES["contrastive_loss_queries"](spark, sf).collect()))
    large = enlarge()
    found, plan = kept_to_parts(QUERIES["contrastive_loss_queries"](spark, sf), large)
    assert found == rows and plan.count("MapInArrow") == (1 if large == "all vectors to each part" else 2)


def test_similarities_are_worked_out_once(spark, sf):
    """the queries that have a loss are the records', so that products aren't made a second time to name them."""
    plan = QUERIES["contrastive_loss_queries"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_products_by_parts_equal_those_in_rows(spark, monkeypatch, large):
    from foldline.operators import selection as R

    frame = spark.createDataFrame([(i, [float(i), 1.0, -0.5 * i]) for i in range(7) if i not in (3, 5)], "vec_id long, embedding array<double>")
    table = P.VectorTable(P.vector_table(frame).frame, 7, 3)
    texts = [(i, [["a b"], [], None, ["", "c  a", None], ["w1 w2"] * 5][i % 5], " ".join(f"w{i * k % 41}" for k in range(i % 23)) if i % 11 else None) for i in range(60)]
    records = spark.createDataFrame(texts, "example_id long, queries array<string>, document string").repartition(5)
    records = records.withColumn("queries", F.transform("queries", lambda q: F.coalesce(q, F.lit(""))))

    def rows():
        found = R.query_similarities(records, table, 6, missing="zero").collect()
        return sorted((r.example_id, r.query_id, r.seg_idx, round(r.sim, 9) + 0.0) for r in found)

    monkeypatch.setattr(P, "VALUES_AT_ONCE", 30)
    parts = rows()
    monkeypatch.setattr(P, "BROADCAST_BYTES", 1 << 20)
    assert rows() == parts and len({r[0] for r in parts}) == 36
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    with pytest.raises(Exception, match="no vector for id [35]"):
        R.query_similarities(records, table, 6).collect()
