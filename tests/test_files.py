"""Files in and out, and the stream."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from foldline.operators.scoring import metric_averages
from foldline.plans.catalog import QUERIES
from foldline.plans.scores import scores
from foldline.plans.fixtures import predictions, qa
from foldline.session import _delete, new_folder, shared_folder
from foldline.sources import jsonl as S
from foldline.streaming.averages import last_averages, start_running_scores


def test_raw_lines(spark, tmp_path):
    path = tmp_path / "raw.jsonl"
    line = json.dumps({"prompt": "qué?", "answer": ["é"], "input": "x"}, ensure_ascii=False)
    path.write_text(f"{line}\n\n   \n{line}\n", encoding="utf-8")
    rows = S.to_qa_record(S.read_raw_qa(spark, str(path))).collect()
    assert len(rows) == 2 and rows[0].question == "qué?" and rows[0].ctxs[0].title == "" and rows[0].ctxs[0].isgold is False


def test_a_broken_line_is_an_error(spark, tmp_path):
    path = tmp_path / "raw.jsonl"
    path.write_text('{"prompt": "q"\n')
    with pytest.raises(Exception):
        S.read_raw_qa(spark, str(path)).collect()


def test_text_is_written_as_it_is(spark, tmp_path):
    S.write_json_lines(spark.createDataFrame([("é→",)], "t string").coalesce(1), str(tmp_path / "o"))
    assert "é→" in next((tmp_path / "o").glob("part-*")).read_text(encoding="utf-8")


def test_the_shared_folder_stays_the_same(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder == shared_folder(spark) and (named is None or folder == named.rstrip("/"))
    mine, other = new_folder(spark, "x"), new_folder(spark, "x")
    assert mine.startswith(folder + "/" + spark.sparkContext.applicationId) and "/x-" in mine and mine != other


def test_scratch_folders_can_be_deleted(spark):
    path = new_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    _delete(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def said(spark, sf):
    examples = qa(spark, sf)
    rows = predictions(examples).join(examples.select("example_id", "dataset", "answers"), "example_id")
    return rows.withColumn("batch_id", F.expr("example_id div 30")).select("example_id", "dataset", "batch_id", "generation", "answers")


def test_the_stream_ends_with_the_batch_averages(spark, sf, tmp_path):
    folder, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ("batch_id < 2", "batch_id >= 2"):
        said(spark, sf).where(part).repartition(3).write.mode("append").json(folder)
        start_running_scores(spark, folder, sink, state).awaitTermination()
    start_running_scores(spark, folder, sink, state).awaitTermination()  # nothing is new: nothing is added
    rows = spark.read.parquet(sink)
    streamed = {r.dataset: r for r in last_averages(rows).collect()}
    for row in metric_averages(scores(spark, sf), ["dataset"]).collect():
        assert streamed[row.dataset].n == row.n
        assert streamed[row.dataset].f1 == pytest.approx(row.f1)
    assert rows.groupBy("dataset", "batch_id").count().where("count > 1").count() == 0


LINE = T.StructType([T.StructField("k", T.LongType())])


def test_an_append_that_is_repeated_is_there_once(spark, tmp_path):
    path = str(tmp_path / "log")
    S.append_json_lines(spark.range(5).withColumnRenamed("id", "k"), path, batch="a")
    for _ in range(2):
        S.append_json_lines(spark.range(5, 9).withColumnRenamed("id", "k"), path, batch="b")
    assert sorted(r.k for r in S.read_log(spark, path, LINE).collect()) == list(range(9))
    with pytest.raises(ValueError, match="name a batch"):
        S.append_json_lines(spark.range(1), path, batch="../x")


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    S.append_json_lines(spark.range(5).withColumnRenamed("id", "k"), path, batch=1)
    broken = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("k"))
    with pytest.raises(Exception, match="broken"):
        S.append_json_lines(broken, path, batch=2)
    assert sorted(r.k for r in S.read_log(spark, path, LINE).collect()) == list(range(5))


def test_a_rerun_replaces_its_own_results(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("a", 0.5, 1), ("a", 0.25, 2), ("b", 0.5, 3)], "dataset string, ratio double, value long")
    S.write_results(rows, path)
    S.write_results(rows, path, index=1)
    S.write_results(rows.where("dataset = 'a'").withColumn("value", F.col("value") * 10), path)
    got = {(r.dataset, r.ratio, r["index"], r.value) for r in S.read_results(spark, path, rows.schema).collect()}
    assert got == {("a", 0.5, 0, 10), ("a", 0.25, 0, 20), ("b", 0.5, 0, 3), ("a", 0.5, 1, 1), ("a", 0.25, 1, 2), ("b", 0.5, 1, 3)}


def test_results_are_worked_out_once(spark, sf, monkeypatch):
    """F16: the rerun's write reads the rows that the first one made; it doesn't compress and predict again."""
    plans, write = [], S.write_results

    def watched(rows, path, index=0):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        write(rows, path, index)

    monkeypatch.setattr(S, "write_results", watched)
    assert QUERIES["write_results"](spark, sf).count() == 2 * qa(spark, sf).count()
    assert len(plans) == 2 and not any(word in plan for plan in plans for word in ("Join", "ArrowEval", "Window")), plans
