"""Byte-level BPE by backtracking: texts to ids and back, with the merges' own result in linear time.

A text is split by a pattern, and each match is a piece of its own. A piece that is a token as a whole gets that token's id. Of
another piece, bytes become Latin-1 characters, and one pass of an Aho-Corasick automaton over it gives the longest token that
begins at each position. From left to right the longest one is taken; where its end is known to lead nowhere, or it can't stand
after the token before it, the next shorter token at that place is tried, and where there is none, the token before it is taken back.
A position that was left that way is never entered again, so a piece costs a bounded number of steps a byte.

Two tokens can stand side by side if merging their joint bytes gives just these two. That is found by undoing merges from both sides
of the seam, the later one first, and looking whether a merge across the seam would have come earlier; answers are kept by pair. A text
in which all neighbours can stand side by side is the one that the merges give, and there is only one.

Ranks must be those of merges: all 256 bytes are tokens, and each longer one comes after the two that it is merged from. Tokens that
no merge reaches are only given to pieces that equal them. Other files are refused with a ValueError.

Defined results: a null text is the empty one, and that has no ids; rows are kept as they are, with null or repeated ids too, and other columns
don't matter; an empty table gives an empty one. A text's ids are a list of its row, as long as the text needs; the answers kept for
short pieces and pairs are bounded by ``KEPT``. Text that isn't valid Unicode can't come out of a string column. Null ids decode to
null; an id that the file doesn't have is an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import small, texts

KEPT = 1 << 19
KEPT_LENGTH = 48
AT_ONCE = 256

# Letters and numbers that Unicode has had since version 17, as hexadecimal ranges. The pattern's other
# implementation goes by version 16, to which they are neither.
SINCE_17 = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
UNASSIGNED = "\u0378"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a file that has a token in base 64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def _newer() -> regex.Pattern:
    ranges = ("-".join(chr(int(end, 16)) for end in part.split("-")) for part in SINCE_17.split())
    return regex.compile(f"[{''.join(ranges)}]")


class Pieces(dict):
    """Ids by piece. What isn't there is worked out, and kept unless it is long; when there are too many, those not asked for lately go."""

    def __init__(self, work: Callable[[str], tuple[int, ...]]) -> None:
        self.work, self.older = work, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece) or self.work(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Codec:
    """Encodes and decodes by ranks, a token's rank being its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for {len(missing)} bytes, the first of them {missing[0]}")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        if len(self.tokens) != len(ranks):
            raise ValueError("two tokens share a rank")
        self.pattern, self.newer = regex.compile(pattern), _newer()
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int | None] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.known = Pieces(self.piece)
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._add(token, rank)
        # a prefix may have a later rank than the token that it begins
        for rank in self.halves:
            self.shorter[rank] = self._prefix(self.tokens[rank])
        for rank in self.halves:
            token = self.tokens[rank]
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.beside.clear()

    def _prefix(self, token: bytes) -> int | None:
        """The longest shorter token that the merges reach and that this one begins with."""
        for end in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:end])
            if rank in self.halves:
                return rank
        return None

    def _add(self, token: bytes, rank: int) -> None:
        if len(token) == 1:
            self.halves[rank] = (rank, rank)
            return
        later = False
        for end in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:end]), self.ranks.get(token[end:])
            if left is None or right is None:
                continue
            if left in self.halves and right in self.halves and self._stands(left, right):
                self.pairs[left, right] = rank
                self.halves[rank] = (left, right)
                return
            later |= left > rank or right > rank
        if later and self._merged(token) == [token]:
            raise ValueError(f"token {rank} is merged from tokens that come after it")

    def _merged(self, data: bytes) -> list[bytes]:
        """The merges done one after the other, for the few tokens that have no halves."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while True:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not found:
                return parts
            at = min(found)[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _stands(self, left: int, right: int) -> bool:
        """Whether no merge across the seam of two tokens comes before the merges that made them."""
        halves, pairs = self.halves, self.pairs
        limit = float("inf")  # the rank of the merge that was undone last
        while True:
            across = pairs.get((left, right))
            if across is not None and across < limit:
                return False
            inner_left, inner_right = halves[left][1], halves[right][0]
            if inner_left == left and inner_right == right:
                return True
            # of the two, the one that was merged later is undone first; at the right, a merge of the same rank comes later
            if inner_right == right or (inner_left != left and left > right):
                limit, left = left, inner_left
            else:
                limit, right = right + 1, inner_right

    def _can_follow(self, left: int, right: int) -> bool:
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) >= KEPT:
                self.beside.clear()
            known = self.beside[left, right] = self._stands(left, right)
        return known

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece."""
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        size = len(data)
        longest = [0] * size
        for end, (back, rank) in self.automaton.iter(data.decode("latin-1")):
            longest[end - back] = rank  # longer ones come later
        tokens, shorter, can_follow = self.tokens, self.shorter, self._can_follow
        dead = bytearray(size + 1)
        ids: list[int] = []
        at, rank = 0, longest[0]
        while True:
            end = at + len(tokens[rank])
            if not dead[end] and (not ids or can_follow(ids[-1], rank)):
                ids.append(rank)
                at = end
                if at == size:
                    return tuple(ids)
                rank = longest[at]
                continue
            smaller = shorter[rank]
            while smaller is None:  # nothing fits here: the token before it goes
                dead[at] = 1
                before = ids.pop()
                at -= len(tokens[before])
                smaller = shorter[before]
            rank = smaller

    def split(self, text: str) -> list[str]:
        """The pattern's matches."""
        try:
            text.encode("latin-1")  # far faster than a search, and true of most texts
        except UnicodeEncodeError:
            if self.newer.search(text):
                return [text[m.start():m.end()] for m in self.pattern.finditer(self.newer.sub(UNASSIGNED, text))]
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as file:
        return Codec(read_ranks(file.read()), pattern)


def _by_codec(rows: DataFrame, path: str, pattern: str, schema: str, work: Callable[[Codec, pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``work`` on small batches; the file is read by each task, as it lies at the same path on every machine."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in small(batches, AT_ONCE):
            codec = codec or _codec(path, pattern)
            yield work(codec, batch)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every text."""
    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.array([codec.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _by_codec(rows, path, pattern, "doc_id long, ids array<int>", work)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes that lists of ids stand for."""
    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        data = pa.array([None if ids is None else codec.decode(ids) for ids in batch.column("ids").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), data], names=["doc_id", "data"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return _by_codec(rows, path, pattern, "doc_id long, data binary", work)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, its ids decoded, and digests of both."""
    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column("text").to_pylist():
            ids = codec.encode(text)
            found.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(codec.decode(ids)).hexdigest()))
        counts, of_ids, of_bytes = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _by_codec(rows, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
