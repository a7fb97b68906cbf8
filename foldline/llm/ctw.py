"""Context-tree weighting over bytes: the code length of a text under frozen counts.

A byte is eight binary decisions, each at a node (the bits before it, 255 nodes). Each node has a tree of byte contexts, 0 to
``DEPTH`` bytes long. At every context the decisions of the learned texts have counts, and a Krichevsky-Trofimov estimate
Pe = G(a + 1/2) G(b + 1/2) / (G(1/2)^2 G(a + b + 1)) with its next-decision form (b + 1/2) / (a + b + 1). Weights run up from the
longest contexts, Pw = (Pe + product of the children's Pw) / 2, with Pw = Pe at full depth, and the mix runs down: at a context the
weight Pe / 2 Pw goes to its own estimate, the rest to the longer contexts. A context that was never seen gives one half.
255, which no UTF-8 text holds, ends a text, so every text has a proper probability.

How it is spread out. Texts are dealt into blocks of about ``BLOCK_BYTES``. A block gives its distinct grams (a byte after
``DEPTH`` others) and words with their learned counts, packed in one row per bucket of their hash; there are as many buckets as blocks, so
a bucket of all blocks is about as large as a block. Beyond ``FAN`` blocks pieces go in two steps, for blocks by buckets would be too many:
a block gives a row per range of buckets, a root of the blocks many; as many blocks make a bundle, in which a range's pieces are summed and
cut by bucket, and what comes back for a bundle is dealt to its blocks the same way. So pieces grow as the blocks to the power of one and
a half, and each is read in a task that holds about a block. Buckets are summed over the corpus. The two longest levels of the
trees are worked out in parts of the distinct grams that share their nearest ``DEPTH`` - 2 bytes; the shorter ones are tables keyed by
(context, node), in which a parent has at most 256 children, so neither sums up nor joins down have a hot key. Each
distinct gram's value then goes back by bucket to the blocks that hold it, and meets their texts there. No task holds more of the
model than its block or part needs, nothing of it is broadcast, and only totals come to the driver. The unigram base takes the same way.

Defined results: A to Z in lower case; a null text counts as the empty one, which has its end alone; rows with a null doc_id are
scored, not learned from and not held out; repeated rows are learned from and scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .bytegrams import pieces
from .common import id_remainder

DEPTH = 5
LOCAL = 2  # levels that are worked out inside a part
BLOCK_BYTES = 1 << 23
FAN = 1024  # blocks whose pieces go straight to the buckets
MOST_TASKS = 1 << 15
PART_GRAMS = 200_000
LN_HALF = math.log(0.5)
END_WORD = b""  # no word is empty: it stands for the end of a text


def log_gamma(x: Any, log: Callable[[Any], Any]) -> Any:
    """ln G(x) for x >= 1/2, of a column or an array: Stirling's series at x + 7, less the logarithms of the seven factors between."""
    y = x + 7
    series = (1 / 12 - (1 / 360 - 1 / 1260 / (y * y)) / (y * y)) / y
    factors = x
    for k in range(1, 7):
        factors = factors * (x + k)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - log(factors)


def log_kt(zeros: Any, ones: Any, log: Callable[[Any], Any]) -> Any:
    """ln Pe of so many zeros and ones."""
    return log_gamma(zeros + 0.5, log) + log_gamma(ones + 0.5, log) - log_gamma(zeros + ones + 1.0, log) - math.log(math.pi)


def spread(rows: DataFrame, groups: int, key: str) -> DataFrame:
    """Rows by key in as many partitions as there are groups, so that a task's share doesn't grow with the corpus."""
    return rows.repartition(max(1, min(groups, MOST_TASKS)), key)


# ---- inside a part: levels of ``DEPTH`` down to DEPTH - LOCAL, for all grams with the same nearest bytes

Level = dict[str, np.ndarray]


def local_levels(codes: np.ndarray, counts: np.ndarray, depth: int, shortest: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """(levels from ``shortest`` to ``depth``, node of each gram's eight decisions at full depth, their bits).

    A level has its nodes' keys, the weight of their own estimate, that estimate, ln Pw, and the place of their parent in the level before.
    """
    byte, context = codes & np.uint64(255), codes >> np.uint64(8) << np.uint64(8)
    at = np.arange(8, dtype=np.uint64)
    bits = (byte[:, None] >> (np.uint64(7) - at) & np.uint64(1)).astype(np.int8)
    node = np.uint64(1) << at | byte[:, None] >> (np.uint64(8) - at)
    keys, place = np.unique(context[:, None] | node, return_inverse=True)
    place = place.reshape(bits.shape)
    every = np.repeat(counts, 8)
    ones = np.bincount(place.ravel(), every * bits.ravel(), len(keys))
    zeros = np.bincount(place.ravel(), every, len(keys)) - ones
    log_pw = log_kt(zeros, ones, np.log)
    level = {"key": keys, "zeros": zeros, "ones": ones, "weight": np.ones(len(keys)), "log_pw": log_pw}
    levels = [level]
    for length in range(depth - 1, shortest - 1, -1):
        keys, parent = np.unique(level["key"] & np.uint64((1 << 8 * (length + 1)) - 1), return_inverse=True)
        level["parent"] = parent
        zeros, ones, children = (np.bincount(parent, level[c], len(keys)) for c in ("zeros", "ones", "log_pw"))
        own = log_kt(zeros, ones, np.log)
        level = {"key": keys, "zeros": zeros, "ones": ones, "log_pw": np.logaddexp(own, children) + LN_HALF,
                 "weight": 1 / (1 + np.exp(np.minimum(children - own, 700)))}
        levels.append(level)
    return levels[::-1], place, bits


def local_values(codes: np.ndarray, counts: np.ndarray, depth: int, shortest: int, keys: np.ndarray, sure: np.ndarray,
                 rest: np.ndarray) -> np.ndarray:
    """log10 of each gram's last byte's probability, from what the shorter levels leave to the nodes ``keys`` of the shortest one."""
    levels, place, bits = local_levels(codes, counts, depth, shortest)
    order = np.argsort(keys)
    at = order[np.searchsorted(keys, levels[0]["key"], sorter=order)]
    sure, rest = sure[at], rest[at]
    for level in levels:
        if "parent" in level and level is not levels[0]:
            sure, rest = sure[level["parent"]], rest[level["parent"]]
        one = (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1)
        sure, rest = sure + rest * level["weight"] * one, rest * (1 - level["weight"])
    chance = sure[place]
    return np.log10(np.where(bits == 1, chance, 1 - chance)).sum(axis=1)


# ---- the shorter levels, as tables

def parent(length: int) -> Column:
    """The key of a node's context cut to ``length`` bytes."""
    return F.col("key").bitwiseAND(F.lit((1 << 8 * (length + 1)) - 1))


def shorter_levels(longest: DataFrame, length: int) -> list[DataFrame]:
    """For context lengths 0 to ``length`` - 1: (key, zeros, ones, weight, log_pw), from (key, zeros, ones, log_pw) of ``length``."""
    found, now = [], longest
    for n in range(length - 1, -1, -1):
        up = now.groupBy(parent(n).alias("key")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_pw").alias("children"))
        up = up.withColumn("own", log_kt(F.col("zeros"), F.col("ones"), F.log)).withColumn("gap", F.col("children") - F.col("own"))
        now = stored(up.select("key", "zeros", "ones", (1 / (1 + F.exp("gap"))).alias("weight"), (
            F.greatest("own", "children") + F.log1p(F.exp(-F.abs("gap"))) + LN_HALF).alias("log_pw")), "level")
        found.append(now)
    return found[::-1]


def left_by(levels: list[DataFrame]) -> DataFrame:
    """(key, sure, rest) of the last level's nodes: what they and their parents estimate, and the weight left to longer contexts."""
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    mixed = None
    for n, level in enumerate(levels):
        here = level.select("key", "weight", one.alias("one"))
        if mixed is None:
            here = here.withColumns({"sure": F.lit(0.0), "rest": F.lit(1.0)})
        else:
            here = here.withColumn("up", parent(n - 1)).join(mixed.withColumnRenamed("key", "up"), "up")
        mixed = here.select("key", (F.col("sure") + F.col("rest") * F.col("weight") * F.col("one")).alias("sure"),
                            (F.col("rest") * (1 - F.col("weight"))).alias("rest"))
    return mixed


def values(grams: DataFrame, depth: int = DEPTH, part_grams: int = PART_GRAMS) -> DataFrame:
    """(code, log10): the logarithm of each distinct gram's last byte's probability after the others.

    ``grams``: (code, n) with n the learned count; grams that are asked for only have n = 0. Read three times. A part's size has a bound
    that no corpus moves: bytes alone can differ, two before the nearest and the last one, which is 2^24 grams at the very most.
    """
    shortest = depth - LOCAL
    parts = max(1, -(-grams.count() // part_grams))

    def part_of(suffix: Column) -> Column:
        return F.pmod(F.xxhash64(suffix), F.lit(parts))

    nearest = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit((1 << 8 * shortest) - 1))
    dealt = grams.withColumn("part", part_of(nearest))

    def up(table: pa.Table) -> pa.Table:
        level = local_levels(table.column("code").to_numpy().view("u8"), table.column("n").to_numpy(), depth, shortest)[0][0]
        return pa.table({"key": level["key"].view("i8"), "zeros": level["zeros"], "ones": level["ones"], "log_pw": level["log_pw"]})

    border = stored(spread(dealt, parts, "part").groupBy("part").applyInArrow(up, "key long, zeros double, ones double, log_pw double"), "level")
    above = left_by(shorter_levels(border, shortest)).withColumnRenamed("key", "up")
    given = border.select("key", parent(shortest - 1).alias("up")).join(above, "up").select(
        part_of(F.shiftrightunsigned("key", 8)).alias("part"), "key", "sure", "rest")

    def down(table: pa.Table, given: pa.Table) -> pa.Table:
        codes = table.column("code").to_numpy()
        keys, sure, rest = (given.column(c).to_numpy() for c in ("key", "sure", "rest"))
        found = local_values(codes.view("u8"), table.column("n").to_numpy(), depth, shortest, keys.view("u8"), sure, rest)
        return pa.table({"code": codes, "log10": found})

    return spread(dealt, parts, "part").groupBy("part").cogroup(spread(given, parts, "part").groupBy("part")).applyInArrow(
        down, "code long, log10 double")


# ---- blocks of texts, and buckets of what they hold

def _shrink(numbers: np.ndarray) -> bytes:
    """Numbers as bytes: all first bytes, all second ones and so on, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes(), 1)


def _grow(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1).T).view(kind).ravel()


def shrink_codes(codes: np.ndarray) -> bytes:
    """Ascending codes by their steps."""
    return _shrink(np.diff(codes, prepend=np.uint64(0)))


def grow_codes(data: bytes) -> np.ndarray:
    return np.cumsum(_grow(data, "<u8"), dtype=np.uint64)


def shrink_words(words: list[bytes]) -> bytes:
    return zlib.compress(b" ".join(words), 1)


def grow_words(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split(b" ")


def bucket_mix(oldest: Any, number: Callable[[int], Any]) -> Any:
    """A mix of a gram's oldest bytes, of a column or an array, below 2^31; no product is beyond 2^47."""
    prime = number((1 << 31) - 1)
    return oldest % prime * number(48271) % prime


PIECES = "block long, bucket long, codes binary, counts binary, words binary, word_counts binary"
PIECE = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), *[(n, pa.binary()) for n in ("codes", "counts", "words", "word_counts")]])


def cut(block: int, codes: np.ndarray, counts: np.ndarray, words: Counter, buckets: int) -> pa.Table:
    """Ascending distinct grams and words with their counts, a row for each bucket that has any."""
    # grams with the same oldest bytes share a bucket, so that their steps are small
    of_code = (bucket_mix(codes >> np.uint64(16), np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of_code, kind="stable")
    of_code = of_code[order]
    by_bucket: dict[int, list[bytes]] = {}
    for w in words:
        by_bucket.setdefault(zlib.crc32(w) % buckets, []).append(w)
    out = []
    for k in sorted({*by_bucket, *np.unique(of_code).tolist()}):
        own, mine = order[slice(*np.searchsorted(of_code, (k, k + 1)))], sorted(by_bucket.get(k, ()))
        out.append((block, k, shrink_codes(codes[own]), _shrink(counts[own]), shrink_words(mine) if mine else None,
                    _shrink(np.array([words[w] for w in mine], "<u8")) if mine else None))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), PIECE.types)], schema=PIECE)


def block_pieces(rows: DataFrame, blocks: int, buckets: int, depth: int = DEPTH) -> DataFrame:
    """Each block's distinct grams and words with their learned counts, a row per bucket, from (block, learn, text)."""

    def run(table: pa.Table) -> pa.Table:
        learn = np.array(table.column("learn").to_pylist(), bool)
        data = [t.as_py().encode("utf-8", "replace").lower() for t in table.column("text")]  # bytes: A to Z alone
        found, counts = [], []
        for codes, owner in pieces(data, depth):
            order = np.argsort(codes)
            codes = codes[order]
            first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            found.append(codes[first])
            counts.append(np.add.reduceat(learn[owner[order]].astype(np.int64), first))
        codes, inverse = np.unique(np.concatenate(found), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(counts)).astype("<u8")
        words: Counter = Counter()
        for d, counted in zip(data, learn):
            if counted:
                words.update(d.split())  # bytes: the six white space bytes alone
            else:
                words.update(dict.fromkeys(d.split(), 0))
        words[END_WORD] = int(learn.sum())
        return cut(table.column("block")[0].as_py(), codes, counts, words, buckets)

    return spread(rows, blocks, "block").groupBy("block").applyInArrow(run, PIECES)


def bundle_pieces(held: DataFrame, ranges: int, buckets: int) -> DataFrame:
    """Pieces by block and range of buckets summed by bundle of blocks, a row per bundle and bucket. As many bundles as ranges."""

    def run(table: pa.Table) -> pa.Table:
        codes, counts = _sum_codes(table)
        return cut(table.column("block")[0].as_py() % ranges, codes, counts, _sum_words(table), buckets)

    return _bundled(held, ranges).groupBy("bundle", "bucket").applyInArrow(run, PIECES)


def _bundled(held: DataFrame, ranges: int) -> DataFrame:
    rows = held.withColumn("bundle", F.pmod("block", F.lit(ranges)))
    return rows.repartition(min(ranges * ranges, MOST_TASKS), "bundle", "bucket")


def _sum_codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([grow_codes(c) for c in table.column("codes").to_pylist()]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([_grow(c, "<u8") for c in table.column("counts").to_pylist()]), len(codes))
    return codes, counts.astype("<u8")


def _sum_words(table: pa.Table) -> Counter:
    total: Counter = Counter()
    for words, counts in zip(table.column("words").to_pylist(), table.column("word_counts").to_pylist()):
        if words is not None:
            for w, n in zip(grow_words(words), _grow(counts, "<u8").tolist()):
                total[w] += n
    return total


def bucket_sums(held: DataFrame, buckets: int) -> DataFrame:
    """(code, n) of the corpus, and with a null code one row per bucket: (n, kinds) of its learned words."""

    def run(table: pa.Table) -> pa.Table:
        codes, n = _sum_codes(table)
        words = _sum_words(table).values()
        return pa.table({"code": pa.array([*codes.view("i8").tolist(), None], pa.int64()),
                         "n": pa.array([*n.astype("i8").tolist(), sum(words)], pa.int64()),
                         "kinds": pa.array([None] * len(codes) + [sum(c > 0 for c in words)], pa.int64())})

    return spread(held, buckets, "bucket").groupBy("bucket").applyInArrow(run, "code long, n long, kinds long")


GIVEN = "block long, bucket long, codes binary, values binary, words binary, word_counts binary"


def _answers(table: pa.Table, codes: np.ndarray, log10: np.ndarray, words: dict[bytes, int]) -> pa.Table:
    """Each piece's grams and words with their values, which are looked up among ascending codes and in the words."""
    values, word_counts = [], []
    for own, mine in zip(table.column("codes").to_pylist(), table.column("words").to_pylist()):
        values.append(log10[np.searchsorted(codes, grow_codes(own))].astype("<f4").tobytes())
        word_counts.append(None if mine is None else _shrink(np.array([words[w] for w in grow_words(mine)], "<u8")))
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "codes": table.column("codes"),
                     "values": pa.array(values, pa.binary()), "words": table.column("words"), "word_counts": pa.array(word_counts, pa.binary())})


def _told(given: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
    """Ascending codes, their values, and the words' counts, of pieces that came back."""
    codes = np.concatenate([grow_codes(c) for c in given.column("codes").to_pylist()])
    value = np.concatenate([np.frombuffer(v, "<f4") for v in given.column("values").to_pylist()])
    order = np.argsort(codes)
    words: dict[bytes, int] = {}
    for own, counts in zip(given.column("words").to_pylist(), given.column("word_counts").to_pylist()):
        if own is not None:
            words.update(zip(grow_words(own), _grow(counts, "<u8").tolist()))
    return codes[order], value[order], words


def give_back(held: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, codes, values, words, word_counts): what each block's grams and words come to in the corpus."""
    bucket = bucket_mix(F.shiftrightunsigned("code", 16), F.lit) % F.lit(buckets)

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        codes, log10 = found.column("code").to_numpy().view("u8"), found.column("log10").to_numpy()
        order = np.argsort(codes)
        return _answers(table, codes[order], log10[order], _sum_words(table))

    found = spread(found.withColumn("bucket", bucket), buckets, "bucket")
    return spread(held, buckets, "bucket").groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, GIVEN)


def hand_down(held: DataFrame, given: DataFrame, ranges: int) -> DataFrame:
    """What came back for bundles of blocks, dealt to the pieces of their blocks."""

    def run(table: pa.Table, given: pa.Table) -> pa.Table:
        return _answers(table, *_told(given))

    # a bundle's number is below that of bundles, and a bucket's range is its remainder
    given = _bundled(given.withColumn("bucket", F.pmod("bucket", F.lit(ranges))), ranges)
    return _bundled(held, ranges).groupBy("bundle", "bucket").cogroup(given.groupBy("bundle", "bucket")).applyInArrow(run, GIVEN)


def score_blocks(rows: DataFrame, given: DataFrame, blocks: int, tokens: int, kinds: int, depth: int = DEPTH) -> DataFrame:
    """Rows (block, doc_id, held_out, text) meet what ``give_back`` has for their block, and are summed up."""
    bottom = tokens + 0.5 * (kinds + 1)

    def run(docs: pa.Table, given: pa.Table) -> pa.Table:
        codes, value, counts = _told(given)
        of_word = dict(zip(counts, np.log10((np.fromiter(counts.values(), float, len(counts)) + 0.5) / bottom).tolist()))
        unknown = {w for w, n in counts.items() if n == 0}
        data = [t.as_py().encode("utf-8", "replace").lower() for t in docs.column("text")]
        score = np.zeros(len(data))
        for asked, owner in pieces(data, depth):
            order = np.argsort(asked)
            asked, owner = asked[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], asked[1:] != asked[:-1])))
            own = value[np.searchsorted(codes, asked[first])].astype(float)
            score += np.bincount(owner, np.repeat(own, np.diff(np.append(first, len(asked)))), minlength=len(data))
        n_tokens, n_known, base = [], [], []
        for d in data:
            own = d.split()
            own.append(END_WORD)
            n_tokens.append(len(own))
            n_known.append(len(own) - sum(map(unknown.__contains__, own)))
            base.append(math.fsum(map(of_word.__getitem__, own)))
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score),
            "bits_per_byte": pa.array(-score / math.log10(2) / np.array([len(d) + 1 for d in data], float))})

    return spread(rows, blocks, "block").groupBy("block").cogroup(spread(given, blocks, "block").groupBy("block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")


def score(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, part_grams: int = PART_GRAMS, fan: int = FAN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    score is the log10 of a text's probability, its end included; texts whose id's remainder modulo 5 is 1 aren't learned from.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                      F.coalesce(id_remainder(5) == 1, F.lit(False)).alias("held_out"),
                      F.coalesce(id_remainder(5) != 1, F.lit(False)).alias("learn"))
    size = own.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    ranges = blocks if blocks <= fan else math.isqrt(blocks - 1) + 1
    held = stored(block_pieces(rows.select("block", "learn", "text"), blocks, ranges, depth), "pieces")
    buckets = -(-blocks // ranges) * ranges  # so that a bucket's remainder is its range
    summed = held if buckets == ranges else stored(bundle_pieces(held, ranges, buckets), "bundles")
    sums = stored(bucket_sums(summed, buckets), "sums")
    tokens, kinds = sums.where("code is null").agg(F.sum("n"), F.sum("kinds")).first()
    tokens, kinds = tokens or 0, kinds or 0
    found = values(sums.where("code is not null").select("code", "n"), depth, part_grams)
    given = give_back(summed, found, buckets)
    if summed is not held:
        given = hand_down(held, given, ranges)
    scored = score_blocks(rows.select("block", "doc_id", "held_out", "text"), given, blocks, tokens, kinds, depth)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
