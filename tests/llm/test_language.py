import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foldline.llm import bytegrams, language

DATA = [bytes(random.Random(k).choices(b"abcdef", k=random.Random(k + 99).randint(0, 60))) for k in range(40)]


def model(order=3):
    codes = np.concatenate([c for c, _ in bytegrams.pieces(DATA, order)])
    code, n = np.unique(codes, return_counts=True)
    return language.tree(code, n, order)


def plain_bits(context, byte, order=3):
    """One byte's code length, from counts in dictionaries and sets of excluded bytes."""
    counts = [Counter() for _ in range(order + 1)]
    for d in DATA:
        padded = b"\xff" * order + d + b"\xff"
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[k][padded[i - k:i], padded[i]] += 1
    excluded, bits = set(), 0.0
    for k in range(order, -1, -1):
        own = {b: n for (c, b), n in counts[k].items() if c == context[len(context) - k:]}
        if not own:
            continue
        left = {b: n for b, n in own.items() if b not in excluded}
        total = sum(left.values()) + len(left)
        if byte in left:
            return bits - math.log2(left[byte] / total)
        if total:
            bits -= math.log2(len(left) / total)
        excluded |= set(own)
    return bits + math.log2(256 - len(excluded))


@pytest.mark.parametrize("context", [b"abc", b"zzz", b"\xff\xff\xff", b"zza", b"faf", b"zab"])
def test_code_lengths(context):
    codes = np.array([int.from_bytes(context, "big") << 8 | b for b in range(256)], np.uint64)
    bits = language.code_lengths(model(), codes)
    assert np.exp2(-bits).sum() == pytest.approx(1)
    for b in (ord("a"), ord("f"), ord("z"), 255):
        assert bits[b] == pytest.approx(plain_bits(context, b))


def test_pieces_cut_anywhere():
    whole = [np.concatenate(x) for x in zip(*bytegrams.pieces(DATA, 3))]
    cut = [np.concatenate(x) for x in zip(*bytegrams.pieces(DATA, 3, chunk=11))]
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert len(whole[0]) == sum(len(d) + 1 for d in DATA)


def test_held_out_accuracy(spark, sf, plain_rows):
    rows = {r.doc_id: r for r in language.predict(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    asked = [(i, lang) for i, _, lang, _ in plain_rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in rows.items() if r.held_out} == {i for i, _ in asked}
    assert sum(rows[i].lang_pred == lang for i, lang in asked) >= 0.97 * len(asked)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_labels_of_asked_rows_are_no_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from pyspark.sql import functions as F

    from foldline.llm.common import id_remainder

    hidden = docs.withColumn("lang", F.when(id_remainder(4) != 2, F.col("lang"))).withColumn("source", F.lit("?"))
    a, b = ({(r.doc_id, r.lang_pred, r.score) for r in language.predict(x).collect()} for x in (docs, hidden))
    assert a == b


def test_long_documents_do_not_fill_the_sample(spark):
    from pyspark.sql import functions as F

    rows = [(i, "en", f"short text {i}") for i in range(300)]
    order = [r.doc_id for r in spark.createDataFrame(rows, "doc_id long, lang string, text string").orderBy(
        F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))).collect()]
    for place in (0, 1, 150):
        rows[order[place]] = (order[place], "en", "long é " * 700_000)  # 5.6 MB
    got = language.sample(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()
    assert len(got) == 300 and sum(len(r.text.encode()) for r in got) <= language.SAMPLE_BYTES
    assert {r.text for r in got} >= {f"short text {i}" for i in range(300) if i not in (order[0], order[1], order[150])}


def test_repeated_ids_keep_the_sample_bounded(spark):
    rows = [(7, "en", "the same text")] * 3000 + [(7, "en", "another text of it")] * 500 + [(i, "en", f"text {i}") for i in range(100, 150)]
    got = language.sample(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5), docs=30).collect()
    assert len(got) == 30 == len({r.text for r in got})
    got = language.sample(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)).collect()
    assert len(got) == 51 and {r.text for r in got} > {f"text {i}" for i in range(100, 150)}


def test_edges(edges, empty):
    rows = language.predict(edges).collect()
    assert len(rows) == edges.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, -9)} == {"und"}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.predict(empty).count() == 0
    kept = language.known_language(edges)
    assert kept.columns == edges.columns
    assert {r.doc_id for r in kept.collect()} >= {4, 5, 6} and not {r.doc_id for r in kept.collect()} & {1, 2, 3, -9}
    from pyspark.sql import functions as F

    unlabelled = language.predict(edges.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_many_languages_share_the_bounds(spark, monkeypatch):
    """300 labels: the sample's bytes and documents stay within the bounds over all; the most frequent labels are learned."""
    rows = [(1000 * k + i, f"l{k:03}", f"{chr(97 + k % 26) * 9}{chr(97 + k // 26) * 5} word {i}") for k in range(300) for i in range(3 + (k < 40))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.sample(docs, all_docs=600, all_bytes=300 * 64).collect()
    assert len({r.lang for r in got}) == 300 and len(got) <= 600 and sum(len(r.text) for r in got) <= 300 * 64
    kept = language.sample(docs, most_languages=40).collect()
    assert {r.lang for r in kept} == {f"l{k:03}" for k in range(40)} and len(kept) == 160

    def pred():
        counts = language.gram_counts(language.sample(docs))
        return {r.doc_id: (r.lang_pred, r.score, r.bits_per_byte) for r in language.identify(docs.select("doc_id", "text"), counts).collect()}

    whole = pred()
    assert sum(whole[i][0] == lang for i, lang, _ in rows) > 0.9 * len(rows)
    monkeypatch.setattr(language, "KEPT_VALUES", 300 * 40)  # now and then more grams than are kept, and kept ones given up
    assert pred() == whole


def test_equal_code_lengths_take_the_first_name(spark):
    docs = spark.createDataFrame([(1, "b", "same text"), (3, "a", "same text")], "doc_id long, lang string, text string")
    got = language.identify(docs, language.gram_counts(docs)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("a", 0.5)}


def test_a_worker_holds_what_it_works_out_for_a_piece_only(spark, monkeypatch):
    docs = spark.createDataFrame([(k, n, d.decode()) for k, d in enumerate(DATA) for n in "ab"], "doc_id long, lang string, text string")
    counts = language.gram_counts(docs)
    asked = docs.select("doc_id", "text")
    monkeypatch.setattr(type(asked), "mapInArrow", lambda self, run, shape: run)
    monkeypatch.setattr(language, "KEPT_VALUES", 1 << 19)  # 4 MB
    run = language.identify(asked, counts)
    texts = ["".join(random.Random(k).choices("abcdefghijklmnopqrst ", k=8000)) for k in range(500)]  # 4 MB
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "text": texts})
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert rows == 500 and peak < 64e6
