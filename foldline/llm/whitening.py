"""Embedding whitening by shifted CholeskyQR over the distributed rows.

Entries c become whole numbers floor(64 c) + 1000000, so that sums S by dimension and the differences n x - S are exact, and a
centred row (n x - S) / n is right to the last place. One pass gives n and S. Each further pass sends
the centred rows through the triangular solve with the R found so far and adds up their Gram matrix: partial matrices by task,
then by group of tasks, and at most ``GROUPS`` matrices to the driver. The Gram matrix's Cholesky factor is put before R. Where it has none, its diagonal is
shifted first; the shift leaves rows that are only partly orthogonal, and the next pass mends that. Passes end when the rows are orthonormal to
``TOLERANCE``, or when the Gram matrix is singular and no longer changes: then its symmetric root takes the factor's place. The singular values and right vectors
of R are those of the centred rows, without squaring their condition. A vector's sign makes its largest entry positive.

Memory: a task holds one batch of rows and one d x d matrix, the driver ``GROUPS`` matrices, whatever the number of rows. Sums of tasks are
added in the tasks' order, so that a repeated task gives the same result. All else is exact in the number of rows as long as it is
below 2^42 or so; a deviation that doesn't fit a long is an error.

Defined results: rows whose vector is null or empty or holds null or non-finite entries take no part, nor do those of another width than most
rows have (of equally frequent widths the larger counts). Rows with a null id or a repeated one are rows like others. Components without variance (below ``LEAST`` of
the largest singular value) can't be whitened and are left out, so rows that are all alike give nothing, and so does an empty table. Of
equal variances the order and direction of the vectors is that of one decomposition, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE, OFFSET = 64, 1_000_000
GROUPS = 32
PASSES = 8
TOLERANCE = 1e-13
LEAST = 1e-12
AT_ONCE = 4096


@dataclass
class Basis:
    """What whitens a row: n, sums by dimension, the components as columns, their eigenvalues, and the covariance's trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int


def whole(vector: str) -> Column:
    """The entries as whole numbers."""
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + OFFSET).cast("long"))


def fit_list(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): rows with a complete vector of the table's width."""
    finite = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c.cast("double")))
    rows = embeddings.select(F.col("vec_id"), F.col(column)).where(F.coalesce((F.size(column) > 0) & finite, F.lit(False)))
    widths = rows.groupBy(F.size(column).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    rows = rows.where(F.size(column) == widths[0]["width"]) if widths else rows.limit(0)
    return rows.select("vec_id", whole(column).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _added(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], dtype: type) -> list[np.ndarray]:
    """The sums of ``make(x)`` over all rows, as one array of each group of tasks, in their order."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in _slices(batches):
            own = make(_matrix(batch))
            total = own if total is None else total + own
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        total = sum(np.frombuffer(x.as_py(), dtype) for x in table.column("data"))
        return pa.table({"task": pa.array([table.column("task")[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    schema = "task int, data binary"
    sums = rows.select("x").mapInArrow(partial, schema).groupBy(F.col("task") % GROUPS).applyInArrow(merge, schema)
    return [np.frombuffer(r["data"], dtype) for r in sums.orderBy("task").collect()]


def exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n times the centred rows, in whole numbers."""
    if float(np.abs(x).max()) * n >= 2.0**62:
        raise ArithmeticError("n times an entry does not fit a long")
    return n * x - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return exact(x, n, sums) / n


def solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rows times the inverse of an upper triangular matrix, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def fit(rows: DataFrame, keep: int = 32) -> Basis | None:
    """The components of ``fit_list`` rows, at most ``keep`` of them."""
    def first(x: np.ndarray) -> np.ndarray:
        return np.concatenate(([len(x)], x.sum(axis=0)))

    parts = _added(rows, first, np.int64)
    if not parts:
        return None
    total = sum(parts)
    n, sums = int(total[0]), total[1:]
    width = len(sums)
    factor = np.eye(width)
    before = None
    for passes in range(1, PASSES + 1):
        gram = sum(_added(rows, lambda x: (q := solve(centred(x, n, sums), factor)).T @ q, np.float64)).reshape(width, width)
        gram = (gram + gram.T) / 2
        if passes == 1:
            trace = float(np.trace(gram)) / n
            if trace == 0:
                return None
        flat = np.abs(gram - np.eye(width)).max()
        settled = flat <= TOLERANCE * width or (before is not None and np.abs(gram - before).max() <= TOLERANCE * width)
        if settled or passes == PASSES:
            values, turn = np.linalg.eigh(gram)
            factor = (turn * np.sqrt(np.maximum(values, 0))) @ turn.T @ factor
            break
        before = gram
        try:
            step = np.linalg.cholesky(gram).T
            sound = step.diagonal().min() > 1e-7 * step.diagonal().max()
        except np.linalg.LinAlgError:
            sound = False
        if not sound:
            shift = 11 * (n * width + width * (width + 1)) * 2.0**-53 * float(np.linalg.norm(gram, 2))
            step = np.linalg.cholesky(gram + min(shift, 1e-4 * np.trace(gram)) * np.eye(width)).T
        factor = step @ factor
    _, singular, vectors = np.linalg.svd(factor)
    kept = min(keep, int((singular > LEAST * singular[0]).sum()))
    vectors = vectors[:kept].T
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    return Basis(n, sums, vectors, singular[:kept] ** 2 / n, trace, passes)


def identity_error(rows: DataFrame, basis: Basis) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, as measured over all rows."""
    scaled = basis.vectors / np.sqrt(basis.values)
    n, sums = basis.n, basis.sums
    mean = sum(_added(rows, lambda x: (centred(x, n, sums) @ scaled).sum(axis=0), np.float64)) / n

    def products(x: np.ndarray) -> np.ndarray:
        own = centred(x, n, sums) @ scaled - mean
        return own.T @ own

    covariance = sum(_added(rows, products, np.float64)).reshape(len(mean), -1) / n
    return float(np.abs(covariance - np.eye(len(mean))).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, keep: int = 32, column: str = "embedding") -> DataFrame:
    """A row for each vector and component: its whitened coordinate, and what share of the variance the component explains."""
    rows = fit_list(embeddings, column)
    basis = fit(rows, keep)
    if basis is None or not len(basis.values):
        return rows.sparkSession.createDataFrame([], WHITENED)
    error = identity_error(rows, basis)
    n, sums, kept = basis.n, basis.sums, len(basis.values)
    scaled = basis.vectors / np.sqrt(basis.values)
    explained = basis.values / basis.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _matrix(batch)
            away = exact(x, n, sums)
            if float(np.abs(away).max()) ** 2 * x.shape[1] >= 2.0**63:
                raise ArithmeticError("a deviation does not fit a long")
            count = len(x)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(count), kept))),
                "component": pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)),
                "n": pa.array(np.full(count * kept, n, np.int64)),
                "deviation": pa.array(np.repeat((away * away).sum(axis=1), kept)),
                "whitened": pa.array(((away / n) @ scaled).ravel()),
                "explained": pa.array(np.tile(explained, count)),
                "identity_error": pa.array(np.full(count * kept, error)),
            })

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, WHITENED)
