"""Token vectors and their pooled means.

``VectorTable`` is the lookup table token id -> vector. Its size is read before it is used. ``pool_groups`` takes one row per group
with the ids of its tokens as an array. A table below ``BROADCAST_BYTES`` is sent to the workers once, and a group's vectors are
gathered, weighed and summed where its row lies, an Arrow batch at a time: no row per token, no join, no aggregation, and the
rows' partitioning stays. Words may stand in place of ids: their hash is worked out once for all equal words of a batch. The time grows with the values summed, at any width.
A larger table is shuffled once together with the rows, in parts, each of which has the vectors that its rows need before these (``in_parts``);
what is worked out there is the same (``over_parts``). Both ways give the same rows and columns.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import stable_hash
from ..functions.vectors import EPS, norm
from .lookup import skew_join
from .segments import PART, PLACED_BYTES, VEC, bytes_of

# what runs inside tasks travels to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

try:
    from _md5 import md5  # CPython's own, which starts faster on short words
except ImportError:
    from hashlib import md5

BROADCAST_BYTES = 128 << 20
HELD_BYTES = 256 << 20  # of vectors, beyond which a part's task holds those of its own words only
BLOCK = 64
VALUES_AT_ONCE = 1 << 21
SUMMED_AT_ONCE = 1 << 18  # values that stay in a core's cache
BYTES_A_WORD = 6  # of text, to size the parts of a batch
WORDS_KNOWN = 1 << 16  # by a task between parts, whose places it has looked up

# What is taken in place of vectors where they lie: a function of a list array, and the type of its results.
Reading = tuple[Callable[[pa.Array], pa.Array], str]
WHOLE: Reading = (lambda vectors: vectors, "array<double>")


@dataclass(frozen=True)
class VectorTable:
    """``frame`` has ``vec_id``, ``vec array<double>`` and its length ``norm``; ``rows`` and ``dim`` are its measured size.

    With ``single`` the values were floats, and are floats again where they are shuffled, which loses nothing. ``meets`` is the number of
    bytes of the rows that will meet the table, where it is known; else it is measured when a table that is too large to be sent is asked.
    """

    frame: DataFrame
    rows: int
    dim: int
    single: bool = False
    meets: int | None = None

    @property
    def held(self) -> int:
        """The bytes of all vectors as a part's task holds them."""
        return self.rows * (self.dim * (4 if self.single else 8) + 8)

    @property
    def fits_broadcast(self) -> bool:
        return self.rows * (self.dim * 8 + 64) <= BROADCAST_BYTES

    @cached_property
    def sent(self):
        """A broadcast of (ids in ascending order, their vectors); only asked for when the measured size is within the bound."""
        said = F.concat(F.lit("the vector of id "), F.col("vec_id").cast("string"), F.lit(f" does not have {self.dim} values"))
        checked = F.when(F.size("vec") == self.dim, F.col("vec")).otherwise(F.raise_error(said).cast("array<double>"))
        whole = self.frame.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("vec")).toArrow()
        ids = whole.column("vec_id").to_numpy()
        if not len(ids):
            raise ValueError("the vector table is empty")
        vectors = whole.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim)
        order = np.argsort(ids, kind="stable")
        return self.frame.sparkSession.sparkContext.broadcast((ids[order], vectors[order]))


def vector_table(frame: DataFrame, vec_id: str = "vec_id", vec: str = "embedding") -> VectorTable:
    """Reads the number of rows (from file footers) and the length of one vector."""
    one = frame.select(F.size(vec)).first()
    if one is None:
        raise ValueError("the vector table is empty")
    doubles = frame.select(F.col(vec_id).alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"))
    single = frame.schema[vec].dataType.simpleString() == "array<float>"
    return VectorTable(doubles.withColumn("norm", norm(F.col("vec"))), frame.count(), one[0], single)


def token_vector_id(token: Column, rows: int) -> Column:
    """Stand-in vocabulary: a token's vector is its MD5 prefix modulo the number of vectors."""
    return F.pmod(stable_hash(token), F.lit(rows).cast("long"))


def attach_vectors(rows: DataFrame, table: VectorTable, missing: str = "error") -> DataFrame:
    """Adds ``vec``, ``norm`` and ``live`` to rows that carry ``vec_id`` and ``cnt``; every row stays one row.

    A row whose id has no vector is an error, or, with ``missing="zero"``, gets the zero vector and ``live`` = 0: it counts in
    lengths and not in means. A row without an id, as a group without tokens has it, gets the same.
    """
    if missing not in ("error", "zero"):
        raise ValueError(f"missing is 'error' or 'zero', not {missing!r}")
    if table.fits_broadcast:
        joined = rows.join(F.broadcast(table.frame), "vec_id", "left")
    else:
        joined = skew_join(rows, table.frame, "vec_id", how="left")
    found = F.col("vec").isNotNull()
    absent = F.array_repeat(F.lit(0.0), table.dim)
    if missing == "error":
        said = F.concat(F.lit("no vector for id "), F.col("vec_id").cast("string"))
        absent = F.when(F.col("vec_id").isNotNull(), F.raise_error(said).cast("array<double>")).otherwise(absent)
    return joined.withColumns({
        "live": F.when(found, F.col("cnt")).otherwise(F.lit(0).cast("long")),
        "norm": F.coalesce("norm", F.lit(EPS)),
        "vec": F.when(found, F.col("vec")).otherwise(absent),
    })


def weighted_mean(rows: DataFrame, keys: list[str], dim: int, weight: Column | None = None,
                  divisor: Column | None = None, out: str = "vec") -> DataFrame:
    """Sum of weight * vec per group over ``divisor`` (default: the sum of weights ``_w``, at least 1e-9).

    One plain sum per place, in one aggregation: these combine on the map side and stay inside code generation. Vectors of more
    than ``BLOCK`` values are cut into blocks and summed per (group, block), and a group's blocks are then put together again,
    where its rows already lie.
    """
    by = F.greatest(F.col("_w"), F.lit(1e-9)) if divisor is None else divisor
    weighed = rows.withColumn("_wt", F.col("live").cast("double") if weight is None else weight)
    if dim <= BLOCK:
        sums = [F.sum(F.get("vec", F.lit(i)) * F.col("_wt")) for i in range(dim)]
        return weighed.groupBy(*keys).agg(
            F.sum("cnt").alias("n_tokens"), F.sum("_wt").alias("_w"), F.array(*sums).alias("_sums")).select(
            *keys, "n_tokens", F.transform("_sums", lambda x: x / by).alias(out))
    starts = F.sequence(F.lit(1), F.lit(dim), F.lit(BLOCK))
    cut = weighed.select(
        *keys, "cnt", "_wt", F.posexplode(F.transform(starts, lambda at: F.slice("vec", at, BLOCK))).alias("_block", "_part"))
    sums = [F.sum(F.get("_part", F.lit(i)) * F.col("_wt")) for i in range(min(dim, BLOCK))]
    summed = cut.groupBy(*keys, "_block").agg(
        F.sum("cnt").alias("n_tokens"), F.sum("_wt").alias("_w"), F.array(*sums).alias("_sums"))
    whole = summed.groupBy(*keys).agg(
        F.max("n_tokens").alias("n_tokens"), F.max("_w").alias("_w"),
        F.sort_array(F.collect_list(F.struct("_block", "_sums"))).alias("_blocks"))
    # the last block may be shorter: its other places are null
    values = F.slice(F.flatten(F.col("_blocks._sums")), 1, dim)
    return whole.select(*keys, "n_tokens", F.transform(values, lambda x: x / by).alias(out))


def masked_mean(rows: DataFrame, keys: list[str], dim: int, mask: Column | None = None, guard: float = 1.0) -> DataFrame:
    """Mean over the tokens with mask 1, the divisor held at ``guard`` or above; no valid token gives zeros."""
    weight = F.col("live").cast("double") * (F.lit(1.0) if mask is None else mask.cast("double"))
    return weighted_mean(rows, keys, dim, weight, F.greatest(F.col("_w"), F.lit(guard)))


def chunk_pool(rows: DataFrame, key: str, merge: int, dim: int, padded: bool = False) -> DataFrame:
    """Means of ``merge`` consecutive vectors. The tail is averaged over its own length, or over ``merge``
    when ``padded``, which is what zero vectors at its end amount to."""
    divisor = F.lit(float(merge)) if padded else F.greatest(F.col("_w"), F.lit(1.0))
    return weighted_mean(rows, [key, "chunk"], dim, divisor=divisor)


def softmax_pool(rows: DataFrame, keys: list[str], score: Column, dim: int, out: str = "vec", bounded: bool = False) -> DataFrame:
    """Softmax-weighted mean of the vectors of a group.

    The group's highest score is taken off first, unless scores are ``bounded`` like a cosine, when exp() cannot
    overflow and a pass is saved.
    """
    scored = rows.withColumn("_score", score)
    if not bounded:
        top = scored.groupBy(*keys).agg(F.max("_score").alias("_top"))
        scored = scored.join(top, keys).withColumn("_score", F.col("_score") - F.col("_top"))
    return weighted_mean(scored, keys, dim, F.exp("_score") * F.col("live"), out=out)


def _places(ids: np.ndarray, known: np.ndarray, missing: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each id's vector lies, and whether there is one."""
    places = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    found = known[places] == ids
    if missing == "error" and not found.all():
        raise ValueError(f"no vector for id {ids[~found][0]}")
    return places, found


def word_ids(words: list[bytes], rows: int) -> np.ndarray:
    """``token_vector_id`` of words inside a task."""
    digests = b"".join([md5(w).digest() for w in words])
    return ((np.frombuffer(digests, ">u8")[::2] >> 4) % rows).astype(np.int64) if words else np.zeros(0, np.int64)


def _ids(array: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists one after the other, and the length of each list, which may be of words."""
    if not pa.types.is_string(array.type.value_type):
        return _lists(array)
    lengths = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.dictionary_encode(array.flatten())
    return word_ids(words.dictionary.cast(pa.binary()).to_pylist(), rows)[words.indices.to_numpy(zero_copy_only=False)], lengths


class _WordPlaces(dict):
    """Numbers words as they come, and knows where the vector of each lies: -1 if there is none."""

    def __init__(self, known: np.ndarray, rows: int):
        self.known, self.rows, self.new, self.places = known, rows, [], np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        self[word] = at
        self.new.append(word)
        return at

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > WORDS_KNOWN:
            self.clear()
            self.places = self.places[:0]
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            places, found = _places(word_ids([w.encode() for w in self.new], self.rows), self.known, "zero")
            self.places, self.new = np.concatenate((self.places, np.where(found, places, -1))), []
        return self.places[numbers]


def _lists(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists one after the other, and the length of each."""
    lengths = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return array.flatten().to_numpy(zero_copy_only=False), lengths


def _cuts(tokens: np.ndarray, dim: int) -> list[tuple[int, int]]:
    """Ranges of rows that have about ``VALUES_AT_ONCE`` values in their tokens' vectors, one row at least. A row counts as a token besides its own."""
    part = np.cumsum((tokens + 1) * dim) // VALUES_AT_ONCE
    ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(tokens)] if len(tokens) else [0]
    return list(zip(ends[:-1], ends[1:]))


def _tokens(lists: pa.Array) -> np.ndarray:
    """The number of tokens of each row, whose lists may lie in lists."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not pa.types.is_list(lists.type.value_type):
        return lengths
    ends = np.concatenate(([0], np.cumsum(_tokens(lists.flatten()))))
    rows = np.cumsum(lengths)
    return ends[rows] - ends[rows - lengths]


def _in_parts(work: Callable[..., pa.Array], dim: int, *columns: pa.Array, tokens: np.ndarray) -> pa.Array:
    """``work`` on ranges of a batch's rows one after the other, so that only results stand in memory as a whole."""
    cuts = _cuts(tokens, dim) or [(0, 0)]
    return pa.concat_arrays([work(*(c.slice(a, b - a) for c in columns)) for a, b in cuts])


def _as_lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def _sizes(vectors: np.ndarray) -> np.ndarray:
    """The vectors' lengths, held above ``EPS`` so that they can divide."""
    step = max(1, VALUES_AT_ONCE // vectors.shape[1])
    squares = [np.einsum("ij,ij->i", part, part) for part in (vectors[at:at + step].astype(np.float64, copy=False) for at in range(0, len(vectors), step))]
    return np.maximum(np.sqrt(np.concatenate(squares)), EPS)


def _scores(vectors: np.ndarray, places: np.ndarray, owner: np.ndarray, queries: np.ndarray, cosine: bool, sizes: np.ndarray | None = None) -> np.ndarray:
    """The product of each token's vector with its group's query, or the cosine; ``sizes`` are the vectors' lengths, where they are known."""
    step = max(1, VALUES_AT_ONCE // vectors.shape[1])
    out = np.empty(len(places))
    for at in range(0, len(places), step):
        out[at:at + step] = np.einsum("ij,ij->i", vectors[places[at:at + step]], queries[owner[at:at + step]])
    if cosine:
        out /= (_sizes(vectors) if sizes is None else sizes)[places] * _sizes(queries)[owner]
    return out


def _sums(vectors: np.ndarray, places: np.ndarray, owner: np.ndarray, weights: np.ndarray | None, groups: int) -> np.ndarray:
    """The sum of each group's vectors, weighted where there are ``weights``; groups of one length together, about ``SUMMED_AT_ONCE`` values at once.

    ``owner`` has the group of each place, in ascending order.
    """
    out = np.zeros((groups, vectors.shape[1]))
    lengths = np.bincount(owner, minlength=groups)
    starts, most = np.cumsum(lengths) - lengths, max(1, min(SUMMED_AT_ONCE, VALUES_AT_ONCE) // vectors.shape[1])
    for length in np.unique(lengths[lengths > 0]).tolist():
        alike = np.flatnonzero(lengths == length)
        for begin in range(0, length, most):
            inside = np.arange(begin, min(begin + most, length))
            step = max(1, most // len(inside))
            for at in range(0, len(alike), step):
                rows = alike[at:at + step]
                taken = starts[rows][:, None] + inside
                values = vectors.take(places[taken], axis=0).astype(np.float64, copy=False)
                out[rows] += np.add.reduce(values, axis=1) if weights is None else np.einsum("kl,kld->kd", weights[taken], values)
    return out


def _queries(array: pa.Array, dim: int) -> np.ndarray:
    """Queries as a matrix; a null one is the zero vector."""
    if array.null_count:
        array = pa.array([v if v is not None else [0.0] * dim for v in array.to_pylist()], pa.list_(pa.float64()))
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), dim)


def _pooled(table: VectorTable, score: str | None, guard: float, fixed: float | None, missing: str) -> Callable[..., pa.Array]:
    """What ``gather_pool`` does, as a function of (ids, weights, query, known ids, vectors[, the vectors' lengths])."""
    dim, n_ids = table.dim, table.rows

    def part(ids: pa.Array, weights: pa.Array, query: pa.Array, known: np.ndarray, vectors: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
        flat, lengths = _ids(ids, n_ids)
        owner = np.repeat(np.arange(len(ids)), lengths)
        places, found = _places(flat, known, missing)
        weight = found.astype(np.float64)
        if len(flat):
            if weights.null_count < len(weights):
                weight *= _lists(weights)[0]
            if score:
                scores = _scores(vectors, places, owner, _queries(query, dim), score == "cosine", sizes)
                highest = np.full(len(ids), -np.inf)
                np.maximum.at(highest, owner, scores)
                weight *= np.exp(scores - highest[owner])
        total = np.bincount(owner, weight, len(ids))
        by = fixed if fixed is not None else np.maximum(total, 1e-300 if score else guard)[:, None]
        sums = _sums(vectors, places, owner, weight, len(ids)) if len(flat) else np.zeros((len(ids), dim))
        return _as_lists(sums / by)

    return part


def gather_pool(table: VectorTable, score: str | None = None, guard: float = 1.0, fixed: float | None = None,
                missing: str = "error", reading: Reading = WHOLE) -> Callable[..., Column]:
    """A column function of (ids[, weights][, query]) that gives a group's weighted mean, or its ``reading``.

    ``score``: None, or 'cosine' or 'dot' of a token with the query, whose softmax is a weight too. The sum is divided by the sum of weights, held at
    ``guard`` or above, or by ``fixed``.
    """
    sent, dim, pooled, (read, kind) = table.sent, table.dim, _pooled(table, score, guard, fixed, missing), reading

    def part(ids: pa.Array, weights: pa.Array, query: pa.Array) -> pa.Array:
        return read(pooled(ids, weights, query, *sent.value))

    def pool(ids: pa.Array, weights: pa.Array, query: pa.Array) -> pa.Array:
        return _in_parts(part, dim, ids, weights, query, tokens=_tokens(ids))

    column = F.arrow_udf(pool, kind)
    return lambda ids, weights=None, query=None: column(
        ids, F.lit(None).cast("array<double>") if weights is None else weights, F.lit(None).cast("array<double>") if query is None else query)


def gather_or_pool(table: VectorTable, missing: str = "error", reading: Reading = WHOLE) -> Callable[[Column, Column, Column], Column]:
    """A column function of (ids, keep, query): the vectors of a kept group's tokens, or a group's one mean, weighted by
    the softmax of its tokens' cosines with the query; of each its ``reading``."""
    sent, dim, n_ids, (taken, kind) = table.sent, table.dim, table.rows, reading

    def part(ids: pa.Array, keep: pa.Array, query: pa.Array) -> pa.Array:
        known, vectors = sent.value
        flat, lengths = _ids(ids, n_ids)
        kept = keep.to_numpy(zero_copy_only=False).astype(bool)
        owner = np.repeat(np.arange(len(ids)), lengths)
        places, found = _places(flat, known, missing)
        rows = np.where(kept, lengths, 1)
        ends = np.concatenate(([0], np.cumsum(rows)))
        out = np.zeros((ends[-1], dim))
        read = kept[owner]
        out[np.repeat(kept, rows)] = vectors[places[read]] * found[read, None]
        rest = ~read
        weight = found[rest].astype(np.float64)
        if len(weight):
            weight *= np.exp(_scores(vectors, places[rest], owner[rest], _queries(query, dim), True))
            total = np.maximum(np.bincount(owner[rest], weight, len(ids)), 1e-9)[:, None]
            means = _sums(vectors, places[rest], owner[rest], weight, len(ids)) / total
            out[ends[:-1][~kept]] = means[~kept]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), taken(_as_lists(out)))

    def both(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # a kept token's vector is a result, so a part's results leave before the next part is worked on
        for ids, keep, query in batches:
            for a, b in _cuts(_tokens(ids), dim):
                yield part(*(c.slice(a, b - a) for c in (ids, keep, query)))

    return F.arrow_udf(both, f"array<{kind}>")


def gather_similarities(table: VectorTable, missing: str = "error") -> Callable[[Column, Column], Column]:
    """A column function of (query's ids, ids by segment) that gives (query_vec, sims): means and their cosines, inside a record's row."""
    sent, dim = table.sent, table.dim

    def means(flat: np.ndarray, owner: np.ndarray, groups: int) -> np.ndarray:
        known, vectors = sent.value
        places, found = _places(flat, known, missing)
        by = np.maximum(np.bincount(owner, found, groups), 1.0)[:, None]
        return _sums(vectors, places, owner, found.astype(np.float64), groups) / by if len(flat) else np.zeros((groups, dim))

    def part(query: pa.Array, segments: pa.Array) -> pa.Array:
        flat, lengths = _lists(query)
        asked = means(flat, np.repeat(np.arange(len(query)), lengths), len(query))
        of_record = segments.value_lengths().to_numpy(zero_copy_only=False)
        flat, lengths = _lists(segments.flatten())
        read = means(flat, np.repeat(np.arange(len(lengths)), lengths), len(lengths))
        record = np.repeat(np.arange(len(query)), of_record)
        size = [np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), EPS) for x in (asked, read)]
        sims = np.einsum("ij,ij->i", read, asked[record]) / (size[1] * size[0][record])
        ends = np.concatenate(([0], np.cumsum(of_record))).astype(np.int32)
        return pa.StructArray.from_arrays(
            [_as_lists(asked), pa.ListArray.from_arrays(pa.array(ends), pa.array(sims))], names=["query_vec", "sims"])

    def compare(query: pa.Array, segments: pa.Array) -> pa.Array:
        return _in_parts(part, dim, query, segments, tokens=_tokens(query) + _tokens(segments))

    return F.arrow_udf(compare, "query_vec array<double>, sims array<double>")


def _words(texts: pa.Array) -> list[list[str]]:
    """The words of each text as ``tokens`` has them; a null one has none."""
    return [(text or b"").decode("utf-8", "replace").split() for text in texts.cast(pa.binary()).to_pylist()]


def _text_cuts(texts: list[pa.Array], dim: int) -> list[tuple[int, int]]:
    """Ranges of rows with about ``VALUES_AT_ONCE`` values by the bytes of their texts."""
    sizes = sum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for column in texts)
    return _cuts(sizes // BYTES_A_WORD, dim)


def _record_parts(size: int, cap: int | None, dim: int, missing: str) -> Callable[..., Iterator[pa.Array]]:
    """What ``gather_records`` does, as a function of (queries, documents, places of words, vectors) that gives a part's results at a time."""
    def means(words: list[str], lengths: np.ndarray, seen: _WordPlaces, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places, owner = seen.of(words), np.repeat(np.arange(len(lengths)), lengths)
        if cap is not None:
            spot = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            inner = (spot > 0) & (spot < np.minimum(lengths, cap)[owner] - 1)
            places, owner = places[inner], owner[inner]
            lengths = np.bincount(owner, minlength=len(lengths))
        found = places >= 0
        if not found.all():
            if missing == "error":
                at = np.flatnonzero(~found)[0] if cap is None else np.flatnonzero(inner)[~found][0]
                raise ValueError(f"no vector for id {word_ids([words[at].encode()], seen.rows)[0]}")
            places, owner = places[found], owner[found]
        by = np.maximum(np.bincount(owner, minlength=len(lengths)), 1.0)[:, None]
        return _sums(vectors, places, owner, None, len(lengths)) / by, lengths

    def part(query: pa.Array, document: pa.Array, seen: _WordPlaces, vectors: np.ndarray) -> pa.Array:
        asked, read = (_words(texts) for texts in (query, document))
        counts = np.array([len(words) for words in read], np.int64)
        of_record = np.maximum(-(-counts // size), 1)
        last = np.cumsum(of_record) - 1
        lengths = np.full(last[-1] + 1, size)
        lengths[last] = counts - (of_record - 1) * size
        query_vec, _ = means([w for words in asked for w in words], np.array([len(words) for words in asked], np.int64), seen, vectors)
        vecs, lengths = means([w for words in read for w in words], lengths, seen, vectors)
        ends = pa.array(np.concatenate(([0], last + 1)).astype(np.int32))
        if cap is None:
            record = np.repeat(np.arange(len(read)), of_record)
            norms = [np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), EPS) for x in (query_vec, vecs)]
            name, values = "sims", pa.array(np.einsum("ij,ij->i", vecs, query_vec[record]) / (norms[1] * norms[0][record]))
        else:
            name, values = "vecs", _as_lists(vecs)
        by_segment = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(lengths), values)]
        return pa.StructArray.from_arrays([_as_lists(query_vec), *by_segment], names=["query_vec", "n_tokens", name])

    def parts(query: pa.Array, document: pa.Array, seen: _WordPlaces, vectors: np.ndarray) -> Iterator[pa.Array]:
        # a part's results leave before the next part is worked on
        for a, b in _text_cuts([query, document], dim):
            yield part(query.slice(a, b - a), document.slice(a, b - a), seen, vectors)

    return parts


def _record_fields(cap: int | None) -> str:
    return "query_vec array<double>, n_tokens array<bigint>, " + ("sims array<double>" if cap is None else "vecs array<array<double>>")


def gather_records(table: VectorTable, size: int, cap: int | None = None, missing: str = "error") -> Callable[[str, str], Column]:
    """A column function of (query, document), names of texts, that gives (query_vec, n_tokens, sims), inside a record's row: the mean vector of
    the query, and by segment of ``size`` words its length and the cosine of its mean with the query's.

    Words are what is between white space, as by ``tokens``; a document without any has one segment without words. With ``cap`` means are those
    of the first ``cap`` words without the first and the last one, lengths likewise, and there are the segments' means, ``vecs``, instead of ``sims``.
    """
    sent, n_ids, parts = table.sent, table.rows, _record_parts(size, cap, table.dim, missing)

    def compare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, vectors = sent.value
        seen = _WordPlaces(known, n_ids)
        for query, document in batches:
            yield from parts(query, document, seen, vectors)

    column = F.arrow_udf(compare, _record_fields(cap))
    return lambda query, document: column(F.col(query).cast("binary"), F.col(document).cast("binary"))


def _part_numbers(frame: DataFrame, parts: int) -> list[int]:
    """Numbers that a shuffle into ``parts`` partitions puts into one partition each."""
    tried = frame.sparkSession.range(0, 40 * parts, 1, 1).select(F.col("id").cast("int").alias("n"))
    at = {row[0]: row[1] for row in tried.select(F.pmod(F.hash("n"), F.lit(parts)), "n").collect()}
    return [at.get(p, 40 * parts + p) for p in range(parts)]


def _named_ids(column: pa.Array, seen: _WordPlaces) -> np.ndarray:
    """The ids of a column of texts, or of lists of texts as bytes, of words or of ids."""
    if not pa.types.is_list(column.type):
        return seen.of([w for words in _words(column) for w in words])
    flat = column.flatten().drop_null()
    if pa.types.is_integer(flat.type):
        return flat.to_numpy(zero_copy_only=False)
    return seen.of(flat.to_pylist()) if pa.types.is_string(flat.type) else _named_ids(flat, seen)


def in_parts(rows: DataFrame, table: VectorTable, keys: list[str], words: list[str]) -> DataFrame:
    """Rows in parts, and with them the vectors that they need: for a table that is too large to be sent.

    A partition has its parts, PART, one after the other; of each the rows that bring it a vector, VEC, come first, in the order of ids, and have nulls in
    all other columns. Steps that keep to a partition and its order may follow, and ``over_parts`` in the end. There is neither a row nor a
    vector per token. Rows go by their ``keys``.

    Up to ``HELD_BYTES`` of vectors each part gets all of them, and there are as many parts as let the vectors be half of the rows' bytes, one for
    each core at least: one shuffle. Beyond, a part has ``PLACED_BYTES`` of rows; it names the ids in its ``words``, columns as ``_named_ids`` reads
    them, once each, and these meet their vectors by a join; that shuffles the rows twice.
    """
    spark, cores = rows.sparkSession, rows.sparkSession.sparkContext.defaultParallelism
    size = table.meets if table.meets is not None else rows.agg(F.sum(bytes_of(rows))).first()[0] or 0
    values = F.col("vec").cast("array<float>") if table.single else F.col("vec")
    known = table.frame.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("vec"))
    vector = F.struct("vec_id", "vec").alias(VEC)
    if table.held <= HELD_BYTES:
        parts = max(cores, size // max(1, 2 * table.held))
        numbers = _part_numbers(rows, parts)
        rows = rows.withColumn(PART, F.get(F.lit(numbers), F.pmod(F.hash(*keys), F.lit(parts))))
        vectors = known.select(vector, F.inline(F.transform(F.lit(numbers), lambda n: F.struct(n.alias(PART)))))
    else:
        parts = max(cores, -(-size // PLACED_BYTES))
        rows = rows.withColumn(PART, F.pmod(F.hash(*keys), F.lit(parts))).repartition(parts, PART)
        n_ids = table.rows

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, hit = _WordPlaces(np.arange(n_ids), n_ids), {}
            for batch in batches:
                for number in pc.unique(batch.column(PART)).to_pylist():
                    own = batch.filter(pc.equal(batch.column(PART), number))
                    named = hit.setdefault(number, set())
                    for at in range(0, len(own), 256):
                        for name in words:
                            named.update(np.unique(_named_ids(own.column(name).slice(at, 256), seen)).tolist())
            for number, named in hit.items():
                ids = pa.array(sorted(named), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number, np.int32)), ids], names=[PART, "vec_id"])

        # with all columns, so that both passes read one shuffle
        named = rows.mapInArrow(wanted, f"{PART} int, vec_id bigint")
        vectors = named.join(known, "vec_id").select(vector, PART)
    both = rows.unionByName(vectors, allowMissingColumns=True)
    return both.repartition(parts, PART).sortWithinPartitions(PART, F.col(f"{VEC}.vec_id").asc_nulls_last())


class _Held:
    """The vectors of the part that a task is at."""

    def __init__(self, n_ids: int, dim: int, single: bool):
        self.n_ids, self.dim, self.kind = n_ids, dim, np.float32 if single else np.float64
        room = max(1, min(n_ids, HELD_BYTES // (dim * np.dtype(self.kind).itemsize)))
        self.ids, self.values = np.empty(room, np.int64), np.empty((room, dim), self.kind)
        self.begin(None)

    def begin(self, part: int | None) -> None:
        self.part, self.n, self.whole = part, 0, False

    def add(self, rows: pa.StructArray) -> None:
        ids, vecs = rows.flatten()
        if pc.any(pc.not_equal(pc.fill_null(pc.list_value_length(vecs), -1), self.dim)).as_py():
            raise ValueError(f"a vector does not have {self.dim} values")
        upto = self.n + len(ids)
        if upto > len(self.ids):
            self.ids, self.values = (np.concatenate((x, np.empty((max(len(x), upto - len(x)), *x.shape[1:]), x.dtype))) for x in (self.ids, self.values))
        self.ids[self.n:upto] = ids.to_numpy(zero_copy_only=False)
        self.values[self.n:upto] = vecs.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim)
        self.n, self.whole = upto, False

    def ready(self) -> None:
        """``known`` ids, their ``vectors``, the lengths of these, and where words lie, after the last vector has come."""
        if not self.whole:
            # without any vector a zero one stands for a place, which no id has
            self.known, self.vectors = (self.ids[:self.n], self.values[:self.n]) if self.n else (np.array([-1]), np.zeros((1, self.dim), self.kind))
            self.sizes, self.seen, self.whole = _sizes(self.vectors), _WordPlaces(self.known, self.n_ids), True


def over_parts(rows: DataFrame, table: VectorTable, work: Callable[[pa.RecordBatch, _Held], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` gives for rows that are ``in_parts``, or come from such: of each batch of a part's rows and its vectors. A task holds a part's
    vectors and a batch; results leave as they come."""
    n_ids, dim, single = table.rows, table.dim, table.single

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(n_ids, dim, single)
        for batch in batches:
            parts = batch.column(PART).to_numpy(zero_copy_only=False)
            brings = batch.column(VEC).is_valid().to_numpy(zero_copy_only=False)
            turns = (np.flatnonzero((parts[1:] != parts[:-1]) | (brings[1:] != brings[:-1])) + 1).tolist()
            for a, b in zip([0, *turns], [*turns, len(parts)] if len(parts) else []):
                if parts[a] != held.part:
                    held.begin(parts[a])
                if brings[a]:
                    held.add(batch.column(VEC).slice(a, b - a))
                else:
                    held.ready()
                    yield from work(batch.slice(a, b - a), held)
            batch = None  # the next one is read before this name is taken again

    return rows.mapInArrow(run, schema)


def _kinds(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in names)


def pull_records(records: DataFrame, table: VectorTable, size: int, cap: int | None = None, key: str = "example_id", query: str = "question",
                 document: str = "document", missing: str = "error") -> DataFrame:
    """(key, query_vec, n_tokens, sims), or ``vecs``, as ``gather_records`` gives them, for a table that is too large to be sent."""
    parts = _record_parts(size, cap, table.dim, missing)
    names = ["query_vec", "n_tokens", "sims" if cap is None else "vecs"]

    def work(batch: pa.RecordBatch, held: _Held) -> Iterator[pa.RecordBatch]:
        at = 0
        for found in parts(batch.column("_query"), batch.column("_document"), held.seen, held.vectors):
            yield pa.RecordBatch.from_arrays([batch.column("_key").slice(at, len(found)), *found.flatten()], names=["_key", *names])
            at += len(found)

    rows = _texts(records, table, key, query, document)
    return over_parts(rows, table, work, f"{_kinds(rows, ['_key'])}, {_record_fields(cap)}").withColumnRenamed("_key", key)


def _texts(records: DataFrame, table: VectorTable, key: str, query: str, document: str) -> DataFrame:
    """Records ``in_parts`` as (_key, _query, _document), texts as bytes."""
    rows = records.select(F.col(key).alias("_key"), F.col(query).cast("binary").alias("_query"), F.col(document).cast("binary").alias("_document"))
    return in_parts(rows, table, ["_key"], ["_query", "_document"])


def _best(sims: np.ndarray, of_record: np.ndarray, ratio: float, digits: int) -> np.ndarray:
    """Whether a segment is among the int(ratio * S) closest of its record; ties at ``digits`` go to the earlier one."""
    away = -np.array([float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in sims.tolist()])
    record = np.repeat(np.arange(len(of_record)), of_record)
    begin = np.cumsum(of_record) - of_record
    order = np.lexsort((away, record))
    rank = np.empty(len(sims), np.int64)
    rank[order] = np.arange(len(sims)) - begin[record]
    return rank < np.floor(ratio * of_record)[record]


def pull_choice(records: DataFrame, table: VectorTable, ratio: float, size: int, digits: int, vecs: str | None = None, key: str = "example_id",
                query: str = "question", document: str = "document", missing: str = "error", reading: Reading = WHOLE) -> DataFrame:
    """(key, seg_idx, words, keep) of the document's segments, for a table that is too large to be sent: similarity, choice and
    vectors are one pass over the records' parts, so that neither texts nor vectors are shuffled again.

    With ``vecs`` there are their vectors too, as ``gather_or_pool`` gives them: of a segment that is not kept one summary, and of a kept one
    those of its words, or none when ``vecs`` is 'summaries'; of each its ``reading``.
    """
    dim, (taken, kind) = table.dim, reading
    names = ["_key", "seg_idx", "words", "keep", *(["vecs"] if vecs else [])]

    def found_places(words: list[str], held: _Held) -> np.ndarray:
        places = held.seen.of(words)
        if missing == "error" and len(places) and places.min() < 0:
            raise ValueError(f"no vector for id {word_ids([words[int(np.argmin(places))].encode()], held.n_ids)[0]}")
        return places

    def means(places: np.ndarray, owner: np.ndarray, groups: int, held: _Held) -> np.ndarray:
        found = places >= 0
        sums = _sums(held.vectors, places[found], owner[found], None, groups)
        return sums / np.maximum(np.bincount(owner[found], minlength=groups), 1.0)[:, None]

    def work(batch: pa.RecordBatch, held: _Held) -> Iterator[pa.RecordBatch]:
        texts = [batch.column("_query"), batch.column("_document")]
        for a, b in _text_cuts(texts, dim):
            asked, read = (_words(column.slice(a, b - a)) for column in texts)
            counts = np.array([len(words) for words in read], np.int64)
            of_record = np.maximum(-(-counts // size), 1)
            last = np.cumsum(of_record) - 1
            lengths = np.full(last[-1] + 1, size)
            lengths[last] = counts - (of_record - 1) * size
            asked_lengths = np.array([len(words) for words in asked], np.int64)
            queries = means(found_places([w for words in asked for w in words], held), np.repeat(np.arange(b - a), asked_lengths), b - a, held)
            words = [w for words in read for w in words]
            places, owner, record = found_places(words, held), np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.arange(b - a), of_record)
            vectors = means(places, owner, len(lengths), held)
            sims = np.einsum("ij,ij->i", vectors, queries[record]) / (_sizes(vectors) * _sizes(queries)[record])
            keep = _best(sims, of_record, ratio, digits) & (lengths > 0)
            keys, segment = batch.column("_key").slice(a, b - a).take(pa.array(record)), np.arange(len(lengths)) - (last + 1 - of_record)[record]
            ends = np.concatenate(([0], np.cumsum(lengths)))
            # a long record's segments leave in parts too
            for i, j in _cuts(lengths, dim):
                own, at = slice(ends[i], ends[j]), pa.array((ends[i:j + 1] - ends[i]).astype(np.int32))
                out = [keys.slice(i, j - i), pa.array(segment[i:j]), pa.ListArray.from_arrays(at, pa.array(words[own], pa.string())), pa.array(keep[i:j])]
                if vecs:
                    out.append(_vecs(places[own], owner[own] - i, lengths[i:j], keep[i:j], queries[record[i:j]], held))
                yield pa.RecordBatch.from_arrays(out, names=names)

    def _vecs(places: np.ndarray, owner: np.ndarray, lengths: np.ndarray, keep: np.ndarray, queries: np.ndarray, held: _Held) -> pa.Array:
        rows = np.where(keep, lengths if vecs == "all" else 0, 1)
        ends = np.concatenate(([0], np.cumsum(rows)))
        out, found = np.zeros((ends[-1], dim)), places >= 0
        if vecs == "all":
            read = keep[owner]
            out[np.repeat(keep, rows)] = held.vectors[np.maximum(places[read], 0)] * found[read, None]
        rest = ~keep[owner] & found
        weight = np.exp(_scores(held.vectors, places[rest], owner[rest], queries, True, held.sizes))
        total = np.maximum(np.bincount(owner[rest], weight, len(lengths)), 1e-9)[:, None]
        out[ends[:-1][~keep]] = (_sums(held.vectors, places[rest], owner[rest], weight, len(lengths)) / total)[~keep]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), taken(_as_lists(out)))

    rows = _texts(records, table, key, query, document)
    schema = f"{_kinds(rows, ['_key'])}, seg_idx bigint, words array<string>, keep boolean" + (f", vecs array<{kind}>" if vecs else "")
    return over_parts(rows, table, work, schema).withColumnRenamed("_key", key)


def pull_products(records: DataFrame, table: VectorTable, size: int, key: str = "example_id", queries: str = "queries", document: str = "document",
                  missing: str = "error") -> DataFrame:
    """(key, query_id, seg_idx, sim) of records that ask several queries, for a table that is too large to be sent: the products of ``gather_products``."""
    dim, directions = table.dim, _directions()

    def work(batch: pa.RecordBatch, held: _Held) -> Iterator[pa.RecordBatch]:
        asked, documents = batch.column("_queries"), batch.column("_document")
        texts = asked.flatten()
        ends = np.concatenate(([0], np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))))
        sizes = np.concatenate(([0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))[ends]
        sizes = np.diff(sizes) + pc.binary_length(documents).fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in _cuts(sizes // BYTES_A_WORD, dim):
            said, read = _words(texts.slice(ends[a], ends[b] - ends[a])), _words(documents.slice(a, b - a))
            counts = np.array([len(words) for words in read], np.int64)
            of_record = np.maximum(-(-counts // size), 1)
            last = np.cumsum(of_record) - 1
            lengths = np.full(last[-1] + 1, size)
            lengths[last] = counts - (of_record - 1) * size
            q = directions(_at([w for words in said for w in words], held), np.array([len(words) for words in said], np.int64), held.vectors)
            d = directions(_at([w for words in read for w in words], held), lengths, held.vectors)
            n_asked, first, begin = np.diff(ends[a:b + 1]), ends[a:b] - ends[a], last + 1 - of_record
            sims = [(q[first[i]:first[i] + n_asked[i]] @ d[begin[i]:begin[i] + of_record[i]].T).ravel() for i in range(b - a)]
            pairs = n_asked * of_record
            spot = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            wide = np.repeat(of_record, pairs)
            yield pa.RecordBatch.from_arrays([documents_key(batch, a, b, pairs), pa.array(spot // wide), pa.array(spot % wide), pa.array(np.concatenate(sims))],
                                             names=["_key", "query_id", "seg_idx", "sim"])

    def documents_key(batch: pa.RecordBatch, a: int, b: int, pairs: np.ndarray) -> pa.Array:
        return batch.column("_key").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), pairs)))

    def _at(words: list[str], held: _Held) -> tuple[np.ndarray, np.ndarray]:
        places = held.seen.of(words)
        found = places >= 0
        if missing == "error" and not found.all():
            raise ValueError(f"no vector for id {word_ids([words[int(np.argmin(found))].encode()], held.n_ids)[0]}")
        return np.maximum(places, 0), found

    rows = records.select(F.col(key).alias("_key"), F.col(queries).cast("array<binary>").alias("_queries"), F.col(document).cast("binary").alias("_document"))
    rows = in_parts(rows, table, ["_key"], ["_queries", "_document"])
    schema = f"{_kinds(rows, ['_key'])}, query_id bigint, seg_idx bigint, sim double"
    return over_parts(rows, table, work, schema).withColumnRenamed("_key", key)


def _directions() -> Callable[..., np.ndarray]:
    """A function of ((places, found), lengths of groups, vectors) that gives each group's mean over its length."""
    def directions(at: tuple[np.ndarray, np.ndarray], lengths: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        places, found = at
        owner = np.repeat(np.arange(len(lengths)), lengths)
        sums = _sums(vectors, places, owner, found.astype(np.float64), len(lengths)) if len(places) else np.zeros((len(lengths), vectors.shape[1]))
        means = sums / np.maximum(np.bincount(owner, found, len(lengths)), 1.0)[:, None]
        return means / _sizes(means)[:, None]

    return directions


def gather_products(table: VectorTable, missing: str = "error") -> Callable[[Column, Column], Column]:
    """A column function of (ids by query, ids by segment) that gives the cosines, segments by query: one matrix product in a record's row."""
    sent, dim, n_ids, of_groups = table.sent, table.dim, table.rows, _directions()

    def directions(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known, vectors = sent.value
        of_record = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, lengths = _ids(lists.flatten(), n_ids)
        return of_groups(_places(flat, known, missing), lengths, vectors), np.concatenate(([0], np.cumsum(of_record)))

    def part(queries: pa.Array, segments: pa.Array) -> pa.Array:
        (asked, at), (read, begin) = directions(queries), directions(segments)
        rows = []
        for i in range(len(queries)):
            rows.extend(asked[at[i]:at[i + 1]] @ read[begin[i]:begin[i + 1]].T)
        flat = np.concatenate(rows) if rows else np.zeros(0)
        ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
        inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), inner)

    def products(queries: pa.Array, segments: pa.Array) -> pa.Array:
        return _in_parts(part, dim, queries, segments, tokens=_tokens(queries) + _tokens(segments))

    return F.arrow_udf(products, "array<array<double>>")


def batch_losses(temperature: float) -> Callable[[Column, Column], Column]:
    """A column function of a batch's (query vectors, memory vectors) that gives a loss for each query: the cross-entropy of its own memory
    against those of the whole batch, on plain dot products, as one matrix product."""
    def losses(queries: pa.Array, memories: pa.Array) -> pa.Array:
        found = []
        for q, m in zip(queries, memories):
            scores = np.array(q.as_py(), np.float64) @ np.array(m.as_py(), np.float64).T / temperature
            top = scores.max(axis=1)
            found.append(np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top - scores.diagonal())
        return pa.array(found, pa.list_(pa.float64()))

    return F.arrow_udf(losses, "array<double>")


def pool_groups(groups: DataFrame, keys: list[str], table: VectorTable, ids: Column, weights: Column | None = None, query: str | None = None,
                score: str | None = None, guard: float = 1.0, fixed: float | None = None, missing: str = "error", out: str = "vec",
                reading: Reading = WHOLE) -> DataFrame:
    """(keys, n_tokens, out) of rows that are a group each, with the ids of its tokens; the arguments are those of ``gather_pool``.

    A group without tokens, or without one that has a vector and a weight, has the zero vector.
    """
    if missing not in ("error", "zero"):
        raise ValueError(f"missing is 'error' or 'zero', not {missing!r}")
    asked = [] if query is None else [query]
    if table.fits_broadcast:
        rows = groups.select(*keys, *asked, ids.alias("_ids"), (F.lit(None).cast("array<double>") if weights is None else weights).alias("_weights"))
        pool = gather_pool(table, score, guard, fixed, missing, reading)
        return rows.select(*keys, F.size("_ids").cast("long").alias("n_tokens"),
                           pool(F.col("_ids"), F.col("_weights"), F.col(query) if query else None).alias(out))
    rows = groups.select(*keys, *asked, ids.alias("_ids"), *([] if weights is None else [weights.alias("_weights")]), *(c for c in (PART, VEC) if c in groups.columns))
    rows = rows if VEC in rows.columns else in_parts(rows, table, keys, ["_ids"])
    dim, pooled, (read, kind) = table.dim, _pooled(table, score, guard, fixed, missing), reading
    names = ["_ids", None if weights is None else "_weights", query]

    def work(batch: pa.RecordBatch, held: _Held) -> Iterator[pa.RecordBatch]:
        columns = [pa.nulls(len(batch), pa.list_(pa.float64())) if name is None else batch.column(name) for name in names]
        lengths = _tokens(columns[0])
        for a, b in _cuts(lengths, dim):
            vecs = read(pooled(*(column.slice(a, b - a) for column in columns), held.known, held.vectors, held.sizes))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in keys), pa.array(lengths[a:b]), vecs], names=[*keys, "n_tokens", out])

    return over_parts(rows, table, work, f"{_kinds(rows, keys)}, n_tokens bigint, `{out}` {kind}")


def minmax_scale(rows: DataFrame, key: str, value: str, scale: float = 1.0, out: str = "scaled") -> DataFrame:
    """scale * (x - min) / (max - min + 1e-8) over the values of one sequence."""
    sequence = Window.partitionBy(key)
    low, high = F.min(value).over(sequence), F.max(value).over(sequence)
    return rows.withColumn(out, F.lit(scale) * (F.col(value) - low) / (high - low + F.lit(1e-8)))
