"""Whitening of vectors by shifted CholeskyQR.

The rows are centred, A = X - mean, and never multiplied before. A pass over all rows adds up the Gram matrix of the rows as
they stand: each task keeps one matrix, and matrices are summed in two levels of blocks, so that the driver gets a single one.
The Cholesky factor of the first Gram matrix, with a small multiple of the identity added so that it exists however
ill-conditioned A is, orthogonalises the rows roughly: every task solves Q R = A for its rows, forward through the triangle. The next
passes do the same with the rows so made, now without a shift, until their Gram matrix is the identity to rounding; two to three
passes are enough. The factors compose to R with A = Q R, and the singular value decomposition of R (a matrix of the width of a vector)
gives the components and, by the squares of the singular values, the eigenvalues of the covariance. As the Gram matrix of A itself
is never decomposed, small eigenvalues keep their digits.

Where the rows don't span all dimensions, a Gram matrix has no Cholesky factor even after the shifts; then its
symmetric root closes the chain (Gram = root * root) in place of the last factor. Components whose eigenvalue is zero to rounding
can't be whitened and aren't returned, so there may be fewer than asked for, or none (a single row, all rows equal).

Entries are c, as double, as x = floor(1024 c) + 100000. Rows whose vector is null, empty or holds null or non-finite entries take no
part. Vectors of several widths are fitted apart, each width with its own n, means and components. Rows with a
null vec_id take part and keep it; repeated rows count each. An entry beyond 2^52 is refused with an error, as is a deviation, or a sum, that
a 64-bit integer can't hold. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries of a block of rows, and of a block of a matrix on its way to the driver.
BLOCK, CHUNK = 1 << 20, 1 << 17
#: The Gram matrix counts as the identity below this; passes that are made at most.
TOLERANCE, PASSES = 1e-13, 6
RANK = 1e-12


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, width) of the rows that take part, entries as double."""
    rows = documents(vectors, "vec_id", "embedding").where("embedding is not null and size(embedding) > 0")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(good, F.lit(False))).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.size("embedding").alias("width"))


def _blocks(batches, column: int, width: int):
    """(batch, entries x as an integer matrix) for slices of bounded size."""
    step = max(1, BLOCK // width)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            c = part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if np.abs(c).max(initial=0) * SCALE >= 2.0**52:
                raise ValueError("an entry is beyond 2^52")
            yield part, np.floor(c * SCALE).astype(np.int64) + OFFSET


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Q with Q R = rows for each upper triangle R in turn, column after column."""
    for r in factors:
        q = np.empty_like(rows, order="F")
        for j in range(len(r)):
            q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        rows = q
    return rows


class _Sums:
    """mapInArrow function: (vec_id, embedding) to the number of rows and their sums by dimension."""

    kind = np.int64

    def __init__(self, width: int):
        self.width = width
        self.shape = (1, width + 1)

    def __call__(self, batches):
        total = np.zeros(self.width + 1, np.int64)
        for _, x in _blocks(batches, 0, self.width):
            if np.abs(x).sum(dtype=float) + float(np.abs(total).max()) >= 2.0**62:
                raise ValueError("the sums don't fit 64-bit integers")
            total[0] += len(x)
            total[1:] += x.sum(axis=0)
        yield from _passed(total[None])


class _Gram:
    """mapInArrow function: (vec_id, embedding) to the Gram matrix of centred rows after these factors, or after a projection."""

    kind = np.float64

    def __init__(self, mean: np.ndarray, factors: list[np.ndarray], onto: np.ndarray | None = None):
        self.mean, self.factors, self.onto = mean, factors, onto
        self.shape = (len(mean),) * 2 if onto is None else (onto.shape[1] + 1,) * 2

    def __call__(self, batches):
        total = np.zeros(self.shape)
        for _, x in _blocks(batches, 0, len(self.mean)):
            rows = _solved(x - self.mean, self.factors)
            if self.onto is not None:  # a column of ones brings the sums along
                rows = np.column_stack([np.ones(len(rows)), rows @ self.onto])
            total += rows.T @ rows
        yield from _passed(total)


def _passed(matrix: np.ndarray):
    """The matrix of a task in blocks of rows: (chunk, lane, values)."""
    step = max(1, CHUNK // matrix.shape[1])
    values = [matrix[lo : lo + step].tobytes() for lo in range(0, len(matrix), step)]
    lane = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([lane] * len(values), pa.int32()), pa.array(values, pa.binary())], ["chunk", "lane", "values"])


def _summed(rows: DataFrame, function) -> np.ndarray:
    """The sum of the matrices of all tasks, in two levels; the driver gets one matrix."""
    kind, shape = function.kind, function.shape

    def add(table: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(v.as_buffer(), kind) for v in table.column("values")))
        if kind is np.int64 and sum(np.abs(np.frombuffer(v.as_buffer(), kind).astype(float)).max() for v in table.column("values")) >= 2.0**62:
            raise ValueError("the sums don't fit 64-bit integers")
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "lane": table.column("lane").slice(0, 1), "values": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, lane int, values binary"
    tasks = rows.select("embedding").mapInArrow(function, schema)
    lanes = max(1, round(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) ** 0.5))
    part = tasks.withColumn("lane", F.col("lane") % lanes).groupBy("chunk", "lane").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    found = sorted((r["chunk"], bytes(r["values"])) for r in part.collect())  # one matrix
    return np.concatenate([np.frombuffer(v, kind) for _, v in found]).reshape(shape)


def orthogonal_factor(gram, n: int, width: int) -> np.ndarray:
    """R with A = Q R, from ``gram(factors)``: the Gram matrix of the rows of A after these triangles are solved.

    The product of the composed factors; the last may be a symmetric root where the rows don't span all dimensions.
    """
    factors: list[np.ndarray] = []
    composed, unit = np.eye(width), np.eye(width)
    for turn in range(PASSES):
        g = gram(factors)
        g = (g + g.T) / 2
        if turn and np.abs(g - unit).max() <= TOLERANCE * width:
            return composed
        shift = 11 * (n * width + width * (width + 1)) * np.finfo(float).eps / 2 * max(np.trace(g), np.finfo(float).tiny) if not turn else 0.0
        try:
            r = np.linalg.cholesky(g + shift * unit).T
            r_ok = bool(np.isfinite(r).all()) and bool((np.diag(r) > 0).all())
        except np.linalg.LinAlgError:
            r_ok = False
        if not r_ok or turn == PASSES - 1 or (turn and np.diag(r).min() < 1e-7 * np.diag(r).max()):
            values, vectors = np.linalg.eigh(g)
            return (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T @ composed
        factors.append(r)
        composed = r @ composed
    raise AssertionError("unreachable")


def fit(rows: DataFrame, width: int, most: int = COMPONENTS) -> dict | None:
    """n, sums, mean, components (columns), eigenvalues, trace and the error of the identity; None without variance."""
    sums = _summed(rows, _Sums(width))[0]
    n, total = int(sums[0]), sums[1:]
    mean = total / n
    r = orthogonal_factor(lambda factors: _summed(rows, _Gram(mean, factors)), n, width)
    _, singular, vectors = np.linalg.svd(r)
    e = singular**2 / n
    keep = min(most, int((singular > RANK * singular[0]).sum())) if singular[0] > 0 else 0
    if not keep:
        return None
    v = vectors[:keep].T
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    onto = v / np.sqrt(e[:keep])
    moments = _summed(rows, _Gram(mean, [], onto)) / n
    covariance = moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:])  # the rows are centred: their means are rounding
    return {"n": n, "sums": total, "mean": mean, "onto": onto, "explained": e[:keep] / e.sum(), "identity_error": float(np.abs(covariance - np.eye(keep)).max())}


class _Whitened:
    """mapInArrow function: (embedding, vec_id) to the rows of the result."""

    def __init__(self, model: dict):
        self.model = model

    def __call__(self, batches):
        m = self.model
        keep, width = m["onto"].shape[1], len(m["mean"])
        for part, x in _blocks(batches, 0, width):
            white = (x - m["mean"]) @ m["onto"]
            if m["n"] * float(np.abs(x).max()) >= 2.0**62:
                raise ValueError("deviations don't fit 64-bit integers")
            gap = m["n"] * x - m["sums"]
            if (gap.astype(float) ** 2).sum(axis=1).max() >= 2.0**63 * (1 - 1e-9):
                raise ValueError("deviations don't fit 64-bit integers")
            row = np.repeat(np.arange(len(x)), keep)
            columns = [part.column(1).take(pa.array(row)), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), m["n"])), pa.array((gap * gap).sum(axis=1)[row])]
            columns += [pa.array(white.ravel()), pa.array(np.tile(m["explained"], len(x))), pa.array(np.full(len(row), m["identity_error"]))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: n, deviation, whitened, explained, identity_error."""
    spark, rows = vectors.sparkSession, valid(vectors)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = []
    for width in sorted(r["width"] for r in rows.select("width").distinct().collect()):
        own = rows.where(F.col("width") == width).select("embedding", "vec_id")
        if model := fit(own, width, components):
            out.append(own.mapInArrow(_Whitened(model), schema))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)
