import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foldline.llm import packing


def plain_pieces(rows, path):
    tokenizer = Tokenizer.from_file(path)
    out = {}
    for i, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            out[i, k // 2048] = (k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes()))
    return out


def holds(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_whole_table(spark, sf, plain_rows, tokenizer):
    rows = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), tokenizer).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == plain_pieces(plain_rows, tokenizer)
    assert holds(rows) == -(-sum(r.length for r in rows) // 2048)  # nothing can be less
    assert {(r.n_sequences, r.least_sequences) for r in rows} == {(holds(rows), holds(rows))}


@pytest.mark.parametrize("text", [
    "it's we'll 'S don''t rock'n'roll!!'s", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "É, é! ÀÉÎÕÜ. Straße; ΣΑΣ İstanbul ǅ",
    "é É, a≠ b ̸", "3.14 v2.0, x1! ½ ²", "漢字かな交じり文。 😀😀!", "a\x1cb\x85c\xa0d e", "...,,,!!! --- a.", "foo_bar-baz/qux",
    "ª º µ ß ŉ ǆ", "x" * 300 + ", " + "é" * 200 + "!"])
def test_ids_are_the_tokenizer_s(spark, tokenizer, text):
    rows = packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer).collect()
    ids = np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4").tolist()
    assert ids == Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False).ids + [0]


def least_bins(lengths, size):
    """Exact, by trying every bin for every piece."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= size:
                go(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1:])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_search_finds_the_least_number(seed):
    draw = np.random.default_rng(seed)
    lengths = sorted(draw.integers(1, 25, draw.integers(1, 10)).tolist(), reverse=True)
    counts = np.bincount(lengths, minlength=25).tolist()
    found = packing.patterns(counts, 24)
    held = np.zeros(25, int)
    for own, times in found:
        assert sum(own) <= 24
        for a in own:
            held[a] += times
    assert held.tolist() == counts
    assert sum(t for _, t in found) == least_bins(lengths, 24) >= packing.least_sequences(counts, 24)


def test_dominance_by_pairs():
    have = [0] * 25
    for a in (3, 4, 5, 7, 9):
        have[a] += 1
    have[4] += 1
    left_of = {(4, 3): False, (7,): True, (4, 4): True, (5, 4): False, (9,): True, (4, 5, 3): False}
    for filling, good in left_of.items():
        assert packing._undominated(filling, 0, have) == good, filling
    assert not packing._undominated((4, 4), 1, have)  # the 9 fits in their place


@pytest.mark.parametrize("seed", range(10))
def test_the_first_filling_is_never_dominated(seed):
    draw = np.random.default_rng(seed)
    have = np.bincount(draw.integers(1, 40, 60), minlength=65).tolist()
    largest = max(a for a, n in enumerate(have) if n)
    every = list(packing.fillings(largest, 64, have, 64, width=1))
    assert len(every) == 1


def test_hot_length_and_round_trip(spark, documents, tokenizer):
    docs = documents([(i, "one two three four five" if i % 3 else f"text number {i} " * (i % 40), "en", "a") for i in range(600)])
    held = packing.token_pieces(docs, tokenizer).cache()
    packed = packing.pack(held).cache()
    holds(packed.collect())
    ids = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert ids[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)


def test_edges(edges, empty, tokenizer):
    rows = packing.pack_documents(edges, tokenizer).collect()
    assert len({(r.doc_id, r.piece) for r in rows if r.doc_id == 4}) > 10
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 6 for r in rows) == 2
    assert [r.length for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    holds(rows)
    assert packing.pack_documents(empty, tokenizer).count() == 0


@pytest.mark.parametrize("text", ["it's  two spaces\nÉ İ ", "<|endoftext|> a.b 3.14", "漢字 😀"])
def test_a_file_with_other_rules_encodes_texts_whole(spark, tokenizer, text):
    other = str(Path(tokenizer).with_name("byte_bpe_50k.json"))
    rules = Tokenizer.from_file(tokenizer).to_str(), Tokenizer.from_file(other).to_str()
    assert [packing.encodes_words_apart(r) for r in rules] == [True, False]
    rows = packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), other).collect()
    assert np.frombuffer(bytes(rows[0].ids), "<u4").tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids + [0]


def test_the_gap_to_the_bound_is_told(spark):
    """No search at all after the first descent: pieces are whole, and the two numbers say what is not proven."""
    lengths = [12, 12, 11, 9, 9, 8, 7, 7, 6, 6, 5, 4, 3] * 3
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = packing.pack(pieces, 24, most_nodes=0, width=1).collect()
    n = len({r.sequence_id for r in rows})
    assert {(r.n_sequences, r.least_sequences) for r in rows} == {(n, -(-sum(lengths) // 24))} and len(rows) == len(lengths)


def awkward(lengths, size):
    """A histogram that no packing brings to the bound, so that the search goes on and back."""
    draw = np.random.default_rng(7)
    return [0 if a < size // 3 else int(n) for a, n in enumerate(draw.integers(1, 50, lengths + 1))] + [0] * (size - lengths)


def test_a_deep_search_holds_few_enumerations(monkeypatch):
    """On check_h a branch has over 2000 nodes, and each one's enumeration took the driver's memory."""
    held, most, plain = 0, 0, packing.fillings

    def counted(*args):
        nonlocal held, most
        held, most = held + 1, max(most, held + 1)
        try:
            yield from plain(*args)
        finally:
            held -= 1

    monkeypatch.setattr(packing, "fillings", counted)
    found = packing.patterns(awkward(600, 600), 600)
    assert len(found) > 300 and sum(times for _, times in found) > packing.least_sequences(awkward(600, 600), 600)
    assert most <= 16


@pytest.mark.parametrize("size", [40, 90, 200])
def test_enumerations_begun_again_go_on_where_they_were(monkeypatch, size):
    counts = awkward(size * 3 // 4, size)
    monkeypatch.setattr(packing, "KEPT_NODES", 1 << 30)
    whole = packing.patterns(counts, size)
    monkeypatch.setattr(packing, "KEPT_NODES", 1)
    again = 0

    class Counted(packing.islice):
        def __new__(cls, ways, given, stop):
            nonlocal again
            again += given > 0
            return super().__new__(cls, ways, given, stop)

    monkeypatch.setattr(packing, "islice", Counted)
    assert packing.patterns(counts, size) == whole
    assert again


def test_words_of_a_packing_do_not_stay_with_the_workers(spark, documents, tokenizer):
    docs = documents([(k, f"word{k} and w{k * k} of document {k}", "en", "a") for k in range(300)])
    assert packing.token_pieces(docs, tokenizer).agg({"length": "sum"}).first()[0] > 300

    def left(batches):  # another query's task in the same workers
        import gc

        gc.collect()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(type(o).__name__ == "Parts" for o in gc.get_objects())], pa.int64())})

    found = [r.n for _ in range(3) for r in spark.range(0, 64, 1, 8).mapInArrow(left, "n long").collect()]
    assert max(found) == 0
