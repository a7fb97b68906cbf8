"""Tokenisers that the steps can be given: white space as columns, and subwords of a vocabulary file in Arrow batches.

A tokeniser turns text columns into ``pieces`` (strings), ``ids`` and ``offsets`` (start and stop in code points), and ids back into text;
``encoded`` has all three from one pass over the text, ``counts`` gives the number of tokens of each string of an array. Steps that cut,
truncate or label texts take one as a parameter.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession, functions as F

from .text import prefix_sums, stable_hash, tokens

# what runs inside tasks travels to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OFFSETS = "array<struct<start: int, stop: int>>"


class Tokeniser(Protocol):
    def pieces(self, text: Column) -> Column: ...

    def ids(self, text: Column) -> Column: ...

    def offsets(self, text: Column) -> Column: ...

    def encoded(self, text: Column) -> Column: ...

    def counts(self, texts: Column) -> Column: ...

    def head(self, text: Column, n: int) -> Column: ...


class Whitespace:
    """Words between white space; an id is a hash of the word. Columns only."""

    def pieces(self, text: Column) -> Column:
        return tokens(text)

    def ids(self, text: Column) -> Column:
        return F.transform(tokens(text), stable_hash)

    def offsets(self, text: Column) -> Column:
        """From the lengths of words and of the white space between them, in one pass over the text."""
        cut = F.regexp_extract_all(text, F.lit(r"(?U)[\s\x1c-\x1f]+|[^\s\x1c-\x1f]+"), F.lit(0))
        lengths = F.transform(cut, lambda part: F.char_length(part).cast("long"))

        def words(parts: Column) -> Column:
            held = F.filter(parts, lambda p: ~p["part"].rlike(r"(?U)^[\s\x1c-\x1f]"))
            return F.transform(held, lambda p: F.struct(
                (p["stop"] - F.char_length(p["part"])).cast("int").alias("start"), p["stop"].cast("int").alias("stop")))

        return words(F.arrays_zip(cut.alias("part"), prefix_sums(lengths).alias("stop")))

    def encoded(self, text: Column) -> Column:
        return F.struct(self.ids(text).alias("ids"), self.pieces(text).alias("pieces"), self.offsets(text).alias("offsets"))

    def counts(self, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.size(tokens(t)).cast("long"))

    def head(self, text: Column, n: int) -> Column:
        return F.array_join(F.slice(tokens(text), 1, n), " ")


def _sizes(array: pa.Array) -> np.ndarray:
    """Bytes of each row's texts; a number counts as one."""
    if pa.types.is_list(array.type):
        ends = np.concatenate(([0], np.cumsum(_sizes(array.values))))
        return np.diff(ends[array.offsets.to_numpy()])
    if pa.types.is_string(array.type):
        return pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.ones(len(array), np.int64)


def parts_of(array: pa.Array, size: int) -> Iterator[pa.Array]:
    """Consecutive rows of about ``size`` bytes, one row at least, so that what a batch is turned into never stands in memory as a whole."""
    part = np.cumsum(_sizes(array)) // size
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(array)] if len(array) else []
    begin = 0
    for end in ends:
        yield array.slice(begin, end - begin)
        begin = end


def _lists(rows: list, values: Callable[[list], pa.Array]) -> pa.Array:
    """Lists of the rows' elements, built from all of them at once by ``values``; a row that is None is null."""
    ends = np.concatenate(([0], np.cumsum([0 if r is None else len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values([r for r in rows if r is not None]), mask=pa.array([r is None for r in rows], pa.bool_()))


def _longs(rows: list) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.int64), *(np.array(r, np.int64) for r in rows)]))


def _strings(rows: list) -> pa.Array:
    return pa.array([piece for r in rows for piece in r], pa.string())


def _spots(rows: list) -> pa.Array:
    both = np.concatenate([np.zeros((0, 2), np.int32), *(np.array(r, np.int32).reshape(-1, 2) for r in rows)])
    return pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["start", "stop"])


class Subwords:
    """The codec of a vocabulary file, without special tokens.

    The file is read once, by Spark, and sent to the tasks: it has to be of a vocabulary's size, ``LIMIT`` bytes at most. A null text has null
    ids. Ids that the file doesn't have decode to nothing. A task has ``PART`` bytes of text in tokens at a time, or one text where that is longer.
    """

    LIMIT = 64 << 20
    PART = 1 << 18

    def __init__(self, spark: SparkSession, path: str) -> None:
        files = spark.read.format("binaryFile").load(path)
        size = files.agg(F.sum("length")).first()[0]
        if size is None or size > self.LIMIT:
            raise ValueError(f"a vocabulary file has {self.LIMIT} bytes at most, {path} has {size}")
        self.sent = spark.sparkContext.broadcast(bytes(files.select("content").first()[0]).decode())

    def _column(self, work, returns: str):
        sent, size = self.sent, self.PART

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            codec = Tokenizer.from_str(sent.value)
            codec.encode_special_tokens = True  # their names in a text are text
            for batch in batches:
                for part in parts_of(batch, size):
                    yield work(codec, part.to_pylist())

        return F.arrow_udf(run, returns)

    @staticmethod
    def _each(codec, texts: list, take: Callable) -> list:
        """``take`` of each text and its encoding, which is dropped before the next one is made."""
        return [None if t is None else take(t, codec.encode(t, add_special_tokens=False)) for t in texts]

    def ids(self, text: Column) -> Column:
        each = self._each
        return self._column(lambda codec, texts: _lists(each(codec, texts, lambda t, e: e.ids), _longs), "array<long>")(text)

    def offsets(self, text: Column) -> Column:
        each = self._each
        return self._column(lambda codec, texts: _lists(each(codec, texts, lambda t, e: e.offsets), _spots), OFFSETS)(text)

    def pieces(self, text: Column) -> Column:
        """Each token's part of the text; a character that several tokens share is in each of them."""
        each = self._each
        return self._column(lambda codec, texts: _lists(
            each(codec, texts, lambda t, e: [t[a:b] for a, b in e.offsets]), _strings), "array<string>")(text)

    def encoded(self, text: Column) -> Column:
        """(ids, pieces, offsets) of one encoding; a null text has null ones."""
        each = self._each

        def work(codec, texts: list) -> pa.Array:
            found = each(codec, texts, lambda t, e: (e.ids, (at := e.offsets), [t[a:b] for a, b in at]))
            ids, offsets, pieces = ([None if f is None else f[i] for f in found] for i in range(3))
            return pa.StructArray.from_arrays(
                [_lists(ids, _longs), _lists(pieces, _strings), _lists(offsets, _spots)], names=["ids", "pieces", "offsets"])

        return self._column(work, f"ids array<long>, pieces array<string>, offsets {OFFSETS}")(text)

    def text(self, ids: Column) -> Column:
        return self._column(lambda codec, lists: pa.array(
            [None if x is None else codec.decode(x, skip_special_tokens=False) for x in lists], pa.string()), "string")(ids)

    def counts(self, texts: Column) -> Column:
        each = self._each
        return self._column(lambda codec, lists: _lists(
            [None if x is None else each(codec, [t or "" for t in x], lambda t, e: len(e.ids)) for x in lists], _longs), "array<long>")(texts)

    def head(self, text: Column, n: int) -> Column:
        """The first n tokens as text."""
        each = self._each
        return self._column(lambda codec, texts: pa.array(
            each(codec, texts, lambda t, e: codec.decode(e.ids[:n], skip_special_tokens=False)), pa.string()), "string")(text)


WHITESPACE = Whitespace()
