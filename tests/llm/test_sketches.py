import hashlib

import pytest
from pyspark.sql import functions as F

from foldline.llm import sketches


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_whole_table(spark, sf, plain_rows):
    rows = {r.doc_id: r for r in sketches.digest(sketches.compare_with_edits(spark.read.parquet(f"{sf}/documents.parquet"))).collect()}
    ordered = sorted(plain_rows, reverse=True)
    off = []
    for k, (i, text, *_) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 3
        edit = text[:len(text) - cut] + after[:cut]
        row = rows[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        a, b = shingles(text), shingles(edit)
        off.append(abs(row.near_edited - len(a & b) / len(a | b)))
        assert row.n_shingles == pytest.approx(len(a), rel=0.5)
    assert sum(off) / len(off) < 0.04 and max(off) < 0.2
    same = {}
    for i, text, *_ in plain_rows:
        assert same.setdefault(text, rows[i].fingerprint) == rows[i].fingerprint


def test_order_over_many_blocks_and_gaps(spark):
    ids = [0, 1, 255, 256, 1000, 70_000, 70_001, 2**33, 2**33 + 5, -3, -70_000, 2**62]
    frame = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    found = {r.doc_id: r.next_text for r in sketches.with_next(frame).collect()}
    down = sorted(ids, reverse=True)
    assert found == {i: f"text {down[(k + 1) % len(down)]}" for k, i in enumerate(down)}


def test_sketches_merge_and_estimate(spark):
    a, b = (" ".join(f"w{i}" for i in range(lo, lo + 900)) for lo in (0, 300))
    frame = spark.createDataFrame([(1, a), (2, b)], "part long, text string").withColumn("s", sketches.sketch(F.col("text")))
    both = sketches.merged(frame.withColumn("key", F.lit(0)), ["key"], "s").first().s
    x, y = (r.s for r in frame.orderBy("part").collect())
    assert both == sorted(set(x) | set(y))[:sketches.K]
    row = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(
        sketches.resemblance(F.col("x"), F.col("y")), sketches.containment(F.col("x"), F.col("y")),
        sketches.distinct_shingles(F.col("x"))).first()
    assert row[0] == pytest.approx(596 / 1196, abs=0.15) and row[1] == pytest.approx(596 / 896, abs=0.2)
    assert row[2] == pytest.approx(896, rel=0.3)


def test_edges(edges, empty, spark):
    rows = sketches.digest(sketches.compare_with_edits(edges)).collect()
    assert len(rows) == 11
    blank = next(r for r in rows if r.doc_id == 1)
    assert blank.n_chars == 0 and blank.fingerprint == "" == blank.edited_fingerprint and blank.near_edited == 1.0
    assert sketches.digest(sketches.compare_with_edits(empty)).count() == 0
    one = sketches.digest(sketches.compare_with_edits(edges.where("doc_id = 5"))).first()
    assert one.near_next == 1.0  # its own next
