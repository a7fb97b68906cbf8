import corpus_pipeline
import pytest

from foldline.llm import language, personal
from foldline.session import stored
from test_packing import holds, plain_pieces
from test_personal import plain as personal_data
from test_simhash import plain_components, plain_print


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Each stage's input and output rows over the small table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf), name)
        out[name] = (docs, after)
        docs = after
    return out


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns(stages):
    assert list(stages) == ["language", "near_dedup", "personal", "mixing", "packing"]
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(stages):
    before, after = stages["language"]
    said = by_id(language.predict(before))
    assert set(by_id(after)) == {i for i, r in said.items() if r.lang_pred != "und" and r.score >= 0.5 and r.bits_per_byte <= 7}
    assert after.count() > 0.98 * before.count()


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    groups = plain_components({i: plain_print(r.text) for i, r in by_id(before).items()})
    assert set(by_id(after)) == set(groups.values()) and after.count() == len(set(groups.values()))


def test_personal(stages):
    before, after = (by_id(x) for x in stages["personal"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert personal_data(r.text) == [] and r.n_chars == len(r.text)
        if not personal_data(before[i].text):
            assert r == before[i]


def test_mixing(stages):
    before, after = stages["mixing"]
    texts = by_id(before)
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r == texts[r.doc_id] for r in rows)


def test_packing(stages, tokenizer):
    before, after = stages["packing"]
    rows = after.collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == plain_pieces(
        [(r.doc_id, r.text) for r in before.collect()], tokenizer)
    assert holds(rows) == -(-sum(r.length for r in rows) // 2048)


def test_edges_go_through(spark, edges, empty, sf):
    for docs in (edges, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf), name)
        docs.count()
