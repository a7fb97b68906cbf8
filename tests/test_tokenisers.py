"""Subword and white-space tokenisers through the steps that take one."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldline.functions.text import first_tokens, tokens
from foldline.functions.tokenisers import WHITESPACE, Subwords
from foldline.operators import conversations as C
from foldline.operators.segments import segment_rows
from foldline.plans.catalog import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello, world", "  two  spaces\n", "naïve café 漢字 😀 <|endoftext|> x", None, "word " * 3000]


@pytest.fixture(scope="module")
def plain():
    codec = Tokenizer.from_file(PATH)
    codec.encode_special_tokens = True
    return codec


@pytest.fixture(scope="module")
def codec(spark):
    return Subwords(spark, PATH)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string").repartition(3)


def test_ids_pieces_offsets_and_back(df, codec, plain):
    t = F.col("t")
    rows = df.select("k", codec.ids(t).alias("ids"), codec.pieces(t).alias("pieces"), codec.offsets(t).alias("offsets"),
                     codec.text(codec.ids(t)).alias("back"), codec.counts(F.array(t, F.lit("a b"))).alias("counts"), first_tokens(t, 3, codec).alias("head"))
    for r in rows.collect():
        text = TEXTS[r.k]
        if text is None:
            assert r.ids is None and r.pieces is None and r.back is None and r.counts == [0, 2]
            continue
        want = plain.encode(text, add_special_tokens=False)
        assert r.ids == want.ids and [tuple(o) for o in r.offsets] == want.offsets
        assert r.pieces == [text[a:b] for a, b in want.offsets] and r.back == text
        assert r.counts == [len(want.ids), 2] and r.head == plain.decode(want.ids[:3], skip_special_tokens=False)


def test_words_by_white_space(df):
    t = F.col("t")
    for r in df.where("t is not null").select("k", WHITESPACE.pieces(t).alias("pieces"), WHITESPACE.offsets(t).alias("offsets"),
                                              WHITESPACE.counts(F.array(t)).alias("counts"), tokens(t).alias("words")).collect():
        text = TEXTS[r.k]
        assert r.pieces == r.words == text.split() and r.counts == [len(text.split())]
        assert [text[a:b] for a, b in r.offsets] == text.split()


def test_segments_of_subwords(spark, codec, plain):
    records = spark.createDataFrame([(1, "what is it?", "some longer words, unbelievably so, " * 9), (2, "q", "")], "example_id long, question string, document string")
    rows = segment_rows(records, "example_id", "question", "document", 7, tokeniser=codec).collect()
    text = "some longer words, unbelievably so, " * 9
    pieces = [text[a:b] for a, b in plain.encode(text, add_special_tokens=False).offsets]
    found = {(r.example_id, r.seg_idx): r.words for r in rows}
    assert sum((found[1, i] for i in range(len(pieces) // 7 + 1)), []) == pieces
    assert all(len(found[1, i]) == 7 for i in range(len(pieces) // 7)) and found[2, 0] == []
    assert "".join(found[1, -1]) == "what is it?"


def labels_by_hand(plain, template, prompt):
    """Tokens' labels, by the same rules written out as a loop."""
    rule = C.LABEL_RULES[template]
    size = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    ids = [0, *plain.encode(prompt, add_special_tokens=False).ids]
    labels, at, total = list(ids), 0, size(prompt) + rule["bos"]

    def mask(start, stop):
        for i in range(max(start, 0), min(stop, total)):
            labels[i] = C.IGNORED

    for i, turn in enumerate(prompt.split(rule["turn_sep"])):
        parts = turn.split(rule["role_sep"])
        if turn == "" or len(parts) != 2:
            break
        first = rule["bos"] if i == 0 else 0
        mask(at + rule["left"], at + size(parts[0] + rule["role_sep"]) + first)
        at += size(turn) + first + size(rule["turn_sep"])
    mask(at + rule["left"], total)
    return labels


PROMPTS = [
    ("llama-2", "[INST] What's that? [/INST] An unbelievable thing. </s><s>[INST] Sure? [/INST] Quite so </s><s>"),
    ("llama-2", "[INST] one [/INST] two </s><s>[INST] three"),
    ("mistral", "[INST] naïve question [/INST] réponse</s>[INST] b [/INST] c</s>"),
    ("llama-3", "<|start_header_id|>user<|end_header_id|>\n\nHi<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nYo there"
                "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nAnd?<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nNo."),
]


def test_labels_by_subwords(spark, codec, plain):
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(PROMPTS)], "conv_id long, template string, prompt string")
    found = {}
    for r in C.token_labels(df, tokeniser=codec).orderBy("conv_id", "pos").collect():
        found.setdefault(r.conv_id, []).append(r.label)
    for i, (template, prompt) in enumerate(PROMPTS):
        assert found[i] == labels_by_hand(plain, template, prompt)


def test_a_file_too_large(spark, monkeypatch):
    monkeypatch.setattr(Subwords, "LIMIT", 1000)
    with pytest.raises(ValueError, match="1000 bytes at most"):
        Subwords(spark, PATH)


def test_queries_over_the_tables(spark, sf, plain):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids, cut = {}, {r.doc_id: r.first20 for r in QUERIES["trunc_subwords"](spark, sf).collect()}
    for r in QUERIES["tokenize_subwords"](spark, sf).collect():
        ids.setdefault(r.doc_id, {})[r.pos] = r.id
    for doc_id, text in docs.items():
        want = plain.encode(text, add_special_tokens=False).ids
        assert [ids.get(doc_id, {})[i] for i in range(len(want))] == want and len(ids.get(doc_id, {})) == len(want)
        assert cut[doc_id] == plain.decode(want[:20], skip_special_tokens=False)
    segments = QUERIES["segments_subwords"](spark, sf).where("seg_idx >= 0").groupBy("example_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.example_id: r.n for r in segments} == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    assert QUERIES["label_spans_subwords"](spark, sf).where("label <> -100").count() > 0


def test_a_batch_is_encoded_in_parts(spark, plain, monkeypatch):
    """Parts of some bytes, a text longer than that, empty texts and nulls: the same ids, pieces and places, and no part of the whole batch."""
    import pyarrow as pa

    from foldline.functions import tokenisers as S

    texts = TEXTS * 3
    assert [len(p) for p in S.parts_of(pa.array(texts, pa.string()), 100)] != [len(texts)]
    assert sum((p.to_pylist() for p in S.parts_of(pa.array(texts, pa.string()), 100)), []) == texts
    lists = [["a" * 90, None], None, [], ["b"], ["c" * 300]]
    assert sum((p.to_pylist() for p in S.parts_of(pa.array(lists, pa.list_(pa.string())), 100)), []) == lists
    assert list(S.parts_of(pa.array([], pa.string()), 100)) == []
    monkeypatch.setattr(Subwords, "PART", 100)
    codec, t = Subwords(spark, PATH), F.col("t")
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1).select(
        "k", codec.encoded(t).alias("e"), codec.text(codec.ids(t)).alias("back"), codec.counts(F.array(t, t)).alias("counts")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.k]
        want = plain.encode(text or "", add_special_tokens=False)
        assert r.back == text and r.counts == [len(want.ids)] * 2
        if text is None:
            assert r.e.ids is None and r.e.pieces is None and r.e.offsets is None
        else:
            assert r.e.ids == want.ids and [tuple(o) for o in r.e.offsets] == want.offsets and r.e.pieces == [text[a:b] for a, b in want.offsets]


def test_texts_are_encoded_once(spark, sf):
    """A query's plan has one pass for the tokens, and labels one more for all counts."""
    for name, passes in (("tokenize_subwords", 1), ("segments_subwords", 2), ("label_spans_subwords", 2)):
        assert QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == passes
