"""Best-fit packing of token pieces into sequences by bin completion with branch and bound.

What the search needs of a corpus is how many pieces there are of each length: at most ``size`` numbers, whatever
the number of documents. It runs on that histogram. A node takes the largest length that is left and enumerates the
undominated fillings (by single pieces and by pairs) around it, those of least waste first; a filling is used as often as the counts allow, so a node
uses up one length at least. The first descent is a best-fit solution, the incumbent; a branch ends when the sequences
so far and the waste bound of what is left cannot beat the incumbent, and the search ends at the lower bound or after
``most_nodes`` more nodes, each of which looks at ``width`` fillings. The nodes of a branch are thousands; only the last ``KEPT_NODES``
hold their enumeration, the others their place in it, and begin again when the search comes back. It gives patterns (lengths, times). The result says how many sequences
there are and the lower bound: where the two are equal the packing is the best there is, else their difference is what the two limits may have cost. Pieces get their places by their rank among the pieces of the same
length, a distributed numbering in which no length is a hot key.

Defined results: a null text counts as the empty one and has the closing id alone; rows with a null doc_id keep it and
are packed like any other; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from .common import small, texts

SIZE = 2048
END_ID = 0
KEPT_PARTS = 250_000  # of about 200 bytes each, for each Python worker
KEPT_LENGTH = 48
PUNCTUATION = b'.,!?;:"()[]{}#$%&*+-/=@_~'
# Fixed values of the vocabulary file whose words are encoded apart: how it normalises and splits a text.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MOST_NODES = 2_000  # after the first descent, of about 2 ms each
WIDTH = 64  # fillings that a node may try
KEPT_NODES = 8  # that hold an enumeration, up to about 1 MB each
MOST_BUCKETS = 1 << 16
BUCKET_ROWS = 64


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): a document's ids and the closing one, cut where they are more than ``size``.

    ``ids`` are unsigned little-endian 32-bit numbers. A tokenizer with the rules above drops white space and never joins what it
    separates, so the ids of a text are those of its parts between white space; a worker keeps the ids of parts that come again,
    and the vocabulary, in its copy of a broadcast: Spark drops it there when the worker's next task is another query's.
    A file with any other rules encodes texts whole.
    """
    learned = docs.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(tokenizer_path, end_id, learned.value)
        step = 4 * size
        for batch in small(batches):
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                whole = ids_of(text.as_py())
                out += [(doc_id, k, k * size, len(cut) // 4, cut)
                        for k, cut in enumerate(whole[i:i + step] for i in range(0, len(whole), step))]
                held += len(whole)
                if held > 1 << 24:
                    yield as_batch(out)
                    out, held = [], 0
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [dict(zip(PIECES.names, row)) for row in rows], schema=PIECES)

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary")


def encodes_words_apart(file: str) -> bool:
    """Whether a tokenizer's JSON has the rules by which words are encoded one by one, and special tokens that match as they are written."""
    rules = json.loads(file)
    special = all(t["content"] in ("<|startoftext|>", "<|endoftext|>") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
                  for t in rules["added_tokens"])
    return special and rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER


def _encoder(tokenizer_path: str, end_id: int, kept: dict) -> Callable[[str], bytes]:
    """A function from a text to its ids and the closing one, as little-endian bytes.

    What it learns about words is put into ``kept``, and serves all tasks of the query in a worker process.
    """
    import os
    import struct

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not kept:
        loaded = Tokenizer.from_file(tokenizer_path)
        kept.update(tokenizer=loaded, ids={}, apart=encodes_words_apart(loaded.to_str()))
    tokenizer, model = kept["tokenizer"], kept["tokenizer"].model
    closing = struct.pack("<I", end_id)
    if not kept["apart"]:
        def whole_ids_of(text: str) -> bytes:
            ids = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            return struct.pack(f"<{len(ids)}I", *ids) + closing

        return whole_ids_of
    # the vocabulary is written in a letter for each byte: printable ones stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    letters = {b: 256 + k for k, b in enumerate(others)}

    class Parts(dict):
        """Ids of strings without white space; what isn't there is worked out, and kept unless it is long."""

        def __missing__(self, part: bytes) -> bytes:
            # punctuation after an ASCII letter or digit is always a token of its own
            head = part.rstrip(PUNCTUATION)
            if head[-1:].isalnum() and len(head) < len(part):
                found = self[head] + self[part[len(head):]]
            else:
                text = part.decode()
                low = text.lower()
                # a word of Latin letters is one token before merging, whatever stands around it
                if low.isalpha() and max(low) < "\u0250" and "\u0130" not in text:
                    if not low.isascii():
                        low = low.encode().decode("latin-1").translate(letters)
                    ids = [t.id for t in model.tokenize(low)]
                else:
                    ids = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(part) <= KEPT_LENGTH:
                self[part] = found
            return found

    parts = kept["ids"] = Parts(kept["ids"])

    def ids_of(text: str) -> bytes:
        data = text.encode("utf-8", "replace")
        if len(parts) > KEPT_PARTS:
            parts.clear()
        # special tokens are written <|so|>, the only strings in which case matters
        return b"".join(map(parts.__getitem__, (data if b"<|" in data else data.lower()).split())) + closing

    return ids_of


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids", pa.binary())])


def least_sequences(counts: list[int], size: int) -> int:
    """A lower bound: the best of the volume bound and, for each k, of what pieces beyond size - k leave to those of k or more."""
    lengths = np.arange(size + 1)
    have = np.asarray(counts, np.int64)
    volume = have * lengths
    bound = -(-int(volume.sum()) // size)
    above, volume_above = np.cumsum(have[::-1])[::-1], np.cumsum(volume[::-1])[::-1]
    for k in range(1, size // 2 + 1):
        large = int(above[size - k + 1])  # meets no piece of length k or more
        middle = int(above[size // 2 + 1]) - large
        free = size * middle - int(volume_above[size // 2 + 1] - volume_above[size - k + 1])
        small = int(volume_above[k] - volume_above[size // 2 + 1])
        bound = max(bound, large + middle + max(0, -(-(small - free) // size)))
    return bound


def _reachable(have: list[int], lengths: list[int], room: int) -> list[int]:
    """For each prefix of the ascending lengths, the sums up to ``room`` that its pieces can make, as bits of a number."""
    whole, sums, found = (1 << (room + 1)) - 1, 1, [1]
    for a in lengths:
        left, step = min(have[a], room // a), 1
        while left:  # 1, 2, 4, ... pieces and the rest make every number of them
            take = min(step, left)
            sums |= (sums << (a * take)) & whole
            left, step = left - take, 2 * step
        found.append(sums)
    return found


def _exactly(total: int, have: list[int], lengths: list[int], reach: list[int]) -> Iterator[tuple[int, ...]]:
    """Multisets of the pieces at hand that add up to ``total``, large pieces first; no branch of it ends in vain."""
    waiting = [(total, len(lengths), ())]
    while waiting:
        rest, i, chosen = waiting.pop()
        while rest and i:
            i -= 1
            a = lengths[i]
            fits = [m for m in range(min(have[a], rest // a) + 1) if reach[i] >> (rest - m * a) & 1]
            waiting += [(rest - m * a, i, chosen + (a,) * m) for m in fits[:-1]]
            rest, chosen = rest - fits[-1] * a, chosen + (a,) * fits[-1]
        yield chosen


def _undominated(filling: tuple[int, ...], waste: int, have: list[int]) -> bool:
    """No piece at hand fits into the waste, none that is larger could take the place of one in the filling, and none could take that of
    two. What would dominate is looked at before: it wastes less, or its pieces are larger and so come first."""
    left = have.copy()
    for a in filling:
        left[a] -= 1
    if waste and any(left[b] > 0 for a in {0, *filling} for b in range(a + 1, a + waste + 1) if b < len(left)):
        return False
    return not any(left[c] > 0 for s in {a + b for a, b in combinations(_by_twos(filling), 2)} for c in range(s, s + waste + 1) if c < len(left))


def _by_twos(filling: tuple[int, ...]) -> list[int]:
    """The pieces, of equal ones two at most: all different pairs are among them."""
    return [a for a in set(filling) for _ in range(min(2, filling.count(a)))]


def fillings(largest: int, size: int, counts: list[int], most_waste: int, width: int = WIDTH) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, filling) around one piece of the largest length; least waste first, no more than ``most_waste``; no more than
    ``width`` are looked at."""
    have, room = list(counts), size - largest
    have[largest] -= 1
    lengths = [a for a, n in enumerate(have) if n and 0 < a <= room]
    reach = _reachable(have, lengths, room)
    looked = 0
    for waste in range(min(most_waste, room) + 1):
        if reach[-1] >> (room - waste) & 1:
            for filling in _exactly(room - waste, have, lengths, reach):
                looked += 1
                if _undominated(filling, waste, have):
                    yield waste, filling
                if looked >= width:
                    return


@dataclass(slots=True)
class _Node:
    """A step of the search: its largest length, the waste it may have, how many fillings it gave, and the others as long as they are kept."""

    largest: int
    spare: int
    given: int = 0
    ways: Iterator[tuple[int, tuple[int, ...]]] | None = None


def patterns(counts: list[int], size: int = SIZE, most_nodes: int = MOST_NODES, width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): sequences that hold every piece of the histogram ``counts`` (index: length) once."""
    left, total = list(counts), sum(a * n for a, n in enumerate(counts))
    floor = least_sequences(left, size)
    best: list[tuple[tuple[int, ...], int]] | None = None
    best_n = sum(left) + 1
    path: list[tuple[tuple[int, ...], int]] = []
    used = volume = nodes = 0
    choices: list[_Node] = []

    def open_node() -> None:
        largest = next((a for a in range(size, 0, -1) if left[a]), 0)
        # sequences that may still be used if the incumbent is to be beaten, in tokens, less what is left to place
        spare = (best_n - 1 - used) * size - (total - volume) if best else size
        choices.append(_Node(largest, spare))
        if len(choices) > KEPT_NODES:
            choices[-1 - KEPT_NODES].ways = None

    def next_filling(node: _Node) -> tuple[int, ...] | None:
        if not node.largest:
            return None
        if node.ways is None:  # ``left`` is again what it was when the node was opened
            node.ways = islice(fillings(node.largest, size, left, node.spare, width), node.given, None)
        _, filling = next(node.ways, (0, None))
        node.given += 1
        return None if filling is None else (node.largest, *filling)

    def undo() -> None:
        nonlocal used, volume
        lengths, times = path.pop()
        for a in lengths:
            left[a] += times
        used, volume = used - times, volume - times * sum(lengths)

    open_node()
    while choices:
        if volume == total:
            if used < best_n:
                best, best_n = list(path), used
            if best_n <= floor:
                break
        hopeless = best and used + -(-(total - volume) // size) >= best_n
        lengths = None if hopeless else next_filling(choices[-1])
        if lengths is None:
            choices.pop()
            if path:
                undo()
            continue
        nodes += 1
        if best and nodes > most_nodes:
            break
        times = min(left[a] // lengths.count(a) for a in set(lengths))
        for a in lengths:
            left[a] -= times
        path.append((lengths, times))
        used, volume = used + times, volume + times * sum(lengths)
        open_node()
    return best or []


def places(solution: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """One row per length and run of ranks: the sequences and the offset that these pieces get. Sorted by length and rank."""
    rows, ranks, base = [], {}, 0
    for lengths, times in solution:
        offset = 0
        for a in lengths:
            first = ranks.get(a, 0)
            rows.append((a, first, base, offset))
            ranks[a] = first + times
            offset += a
        base += times
    rows.sort()
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(("length", "rank", "base", "offset"))}


def pack(pieces: DataFrame, size: int = SIZE, most_nodes: int = MOST_NODES, width: int = WIDTH) -> DataFrame:
    """Adds sequence_id, offset, and for all rows alike n_sequences and least_sequences, to pieces (doc_id, piece, length and more).

    Reads ``pieces`` more than once.
    """
    counted = pieces.groupBy("length").count().collect()  # at most ``size`` rows
    counts = [0] * (size + 1)
    for row in counted:
        counts[row["length"]] = row["count"]
    solution = patterns(counts, size, most_nodes, width)
    n_sequences, floor = sum(times for _, times in solution), least_sequences(counts, size)
    found = places(solution)
    rows = sum(counts)
    buckets = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1).join(starts, ["length", "_bucket"]).select(
        *pieces.columns, (F.col("_in") + F.col("_before")).cast("long").alias("_rank"))
    key, names = found["length"] * (rows + 1) + found["rank"], pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "_rank"))
            at = np.searchsorted(key, length * (rows + 1) + rank, side="right") - 1
            own = [batch.column(n) for n in names]
            more = [pa.array(found["base"][at] + rank - found["rank"][at]), pa.array(found["offset"][at])]
            yield pa.RecordBatch.from_arrays(own + more, [*names, "sequence_id", "offset"])

    shape = ranked.drop("_rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(run, shape).withColumns(
        {"n_sequences": F.lit(n_sequences).cast("long"), "least_sequences": F.lit(floor).cast("long")})


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, most_nodes: int = MOST_NODES,
                   width: int = WIDTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences, least_sequences) for every piece of every document."""
    pieces = stored(token_pieces(docs, tokenizer_path, size, end_id).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(pieces, size, most_nodes, width)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the ids of each sequence, from pieces with ``ids``, sequence_id and offset.

    A group is one sequence and so holds no more than its size.
    """
    parts = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids", "length"))).alias("_parts"))
    return parts.select(
        "sequence_id", F.aggregate("_parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))
