import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from foldline.llm import bytepairs
from foldline.llm.queries import QUERIES, RANKS

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def codec():
    return bytepairs._codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def drawn(kind, draw):
    n = draw.randrange(1, 40)
    if kind == 0:
        return "".join(draw.choice("abc et") for _ in range(n))
    if kind == 1:
        return "".join(chr(draw.randrange(0x3000)) for _ in range(n))
    if kind == 2:
        return "".join(chr(c) for c in (draw.randrange(0x110000) for _ in range(n)) if not 0xD800 <= c < 0xE000)
    if kind == 3:
        return "".join(draw.choice(["the", "ing", "an", "  ", "\n", "Ö", "ü", "漢", "字", "is", "tion", "e", "r", "'s", "1"]) for _ in range(n))
    return draw.choice("aA=-. \nе漢") * draw.randrange(1, 300)


@pytest.mark.parametrize("kind", range(5))
def test_random_strings_as_the_library(codec, library, kind):
    draw = random.Random(kind)
    for _ in range(4000):
        text = drawn(kind, draw)
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_every_character_as_the_library(codec, library):
    for block in range(0, 0x110000, 256):
        text = "".join(f"a{chr(c)}뱳{chr(c)}1 " for c in range(block, block + 256) if not 0xD800 <= c < 0xE000)
        assert codec.encode(text) == library.encode_ordinary(text)


def test_other_vocabulary(library):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    other = bytepairs._codec(path, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=other.ranks, special_tokens={})
    draw = random.Random(9)
    for _ in range(3000):
        text = drawn(draw.randrange(5), draw)
        assert other.encode(text) == theirs.encode_ordinary(text)


def bytes_and(*more):
    ranks = {bytes([b]): b for b in range(256)}
    return ranks | {token: 256 + k for k, token in enumerate(more)}


def test_small_vocabularies_against_merges():
    draw = random.Random(3)
    compared = 0
    for _ in range(400):
        tokens, parts = [], [b"a", b"b", b"c"]
        for _ in range(draw.randrange(1, 12)):  # merges of what is there, as a trained file has them
            token = draw.choice(parts) + draw.choice(parts)
            if token not in parts:
                tokens.append(token)
                parts.append(token)
        try:
            codec = bytepairs.Codec(bytes_and(*tokens), r"(?s).+")
        except ValueError:  # a later token comes into an earlier one, which no trained file has
            continue
        compared += 1
        for _ in range(30):
            data = "".join(draw.choice("abc") for _ in range(draw.randrange(1, 25)))
            want = codec._merged(data.encode()) if data.encode() not in codec.ranks else [data.encode()]
            assert [codec.tokens[i] for i in codec.encode(data)] == want
    assert compared > 200


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="no token"):
        bytepairs.Codec({b"a": 0}, ".+")
    with pytest.raises(ValueError, match="come after"):
        bytepairs.Codec(bytes_and(b"abc", b"ab"), ".+")
    with pytest.raises(ValueError, match="share a rank"):
        bytepairs.Codec(bytes_and() | {b"ab": 5}, ".+")


def test_a_token_no_merge_reaches_is_given_to_its_own_piece():
    codec = bytepairs.Codec(bytes_and(b"abc"), r"\S+|\s")
    assert codec.encode("abc") == [256]
    assert codec.encode("abcabc") == list(b"abcabc")


def test_one_long_piece_takes_linear_time(codec, library):
    draw = random.Random(5)
    text = "".join(draw.choice("abcdefgh") for _ in range(300_000))
    steps = 0
    stands = codec._can_follow

    def counted(left, right):
        nonlocal steps
        steps += 1
        return stands(left, right)

    codec._can_follow = counted
    try:
        for piece in (text, "a" * 300_000, "ab" * 150_000):
            steps = 0
            ids = codec.piece(piece)
            assert codec.decode(ids) == piece.encode() and steps < 6 * len(piece)
    finally:
        del codec._can_follow
    assert list(codec.piece(text[:20_000])) == library.encode_ordinary(text[:20_000])


def test_bounded_memory_of_pieces(codec, monkeypatch):
    monkeypatch.setattr(bytepairs, "KEPT", 8)
    known = bytepairs.Pieces(codec.piece)
    for i in range(100):
        assert codec.decode(known[f"word{i % 30}"]) == f"word{i % 30}".encode()
        assert len(known) <= 4 and len(known.older) <= 4
    assert known["x" * 500] and "x" * 500 not in known


def test_edges(edges, empty, library):
    got = bytepairs.round_trip(edges, PATH, public_tokenizers.PATTERN)
    rows = {(r.doc_id, r.decoded_sha256): r for r in got.collect()}
    want = edges.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert got.count() == len(want)
    for doc_id, text in want:
        row = rows[doc_id, hashlib.sha256(text.encode()).hexdigest()]
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bytepairs.round_trip(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_and_back(edges):
    ids = bytepairs.encode(edges, PATH, public_tokenizers.PATTERN)
    back = bytepairs.decode(ids, PATH, public_tokenizers.PATTERN).select("doc_id", F.col("data").cast("string").alias("text"))
    want = edges.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))


def test_query(spark, sf, library, plain_rows):
    got = QUERIES["op11_bytepairs"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = set()
    for doc_id, text, *_ in plain_rows:
        ids = library.encode_ordinary(text or "")
        want.add((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert {tuple(r) for r in got.collect()} == want
