"""Whitening of vectors: pivoted Cholesky of the centred scatter, one-sided Jacobi on the triangular factor.

1. Entries become integers (64 steps a unit, offset 1 000 000). The fit list is each distinct integer vector once.
2. Its sums by dimension are exact; the scatter is summed a block at a time from rows centred before they are multiplied.
   Tasks send one matrix each, added up by entry: the driver gets dims x dims numbers, whatever the rows.
3. Covariance = P L L' P'. Jacobi rotations make the columns of L orthogonal, all disjoint pairs of columns at once;
   the squared column norms are the eigenvalues, the normalised columns the components.
4. A pass over all rows projects them; one over the fit list measures how far its covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

STEPS, OFFSET = 64, 1_000_000
#: Entries of this size or more have no exact integer; they count as not finite
TOO_LARGE = float(1 << 46)
_SAFE = 1 << 62


def cholesky(a: np.ndarray) -> np.ndarray:
    """L (dims x rank) with L L' = a: the largest remaining diagonal entry comes first, the rank ends where rounding begins.

    Rows are in a's order, so that the row permutation is applied already.
    """
    rest, columns = a.copy(), []
    least = len(a) * np.finfo(float).eps * max(np.diag(a).max(initial=0.0), 0.0)
    for _ in range(len(a)):
        p = int(np.argmax(np.diag(rest)))
        if not rest[p, p] > least:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0
        columns.append(column)
    return np.array(columns).T.reshape(len(a), len(columns))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms (falling) and unit columns of factor times the rotation that makes its columns orthogonal."""
    f = factor.copy()
    many = f.shape[1] + f.shape[1] % 2
    seats = np.arange(many)
    for _ in range(sweeps if many else 0):
        turned = False
        for _ in range(many - 1):
            # a tournament: every pair of columns meets once a sweep, half of the columns against the other half
            i, j = seats[: many // 2], seats[many // 2 :][::-1]
            both = (i < f.shape[1]) & (j < f.shape[1])
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
            i, j = i[both], j[both]
            x, y = f[:, i], f[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(xy) > 4 * np.finfo(float).eps * np.sqrt(xx * yy)
            if not off.any():
                continue
            turned = True
            i, j, x, y = i[off], j[off], x[:, off], y[:, off]
            zeta = (yy[off] - xx[off]) / (2 * xy[off])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            f[:, i], f[:, j] = c * (x - t * y), c * (t * x + y)
        if not turned:
            break
    norms = (f * f).sum(0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], f[:, order] / np.sqrt(norms[order])


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            yield part, part.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit integers if they are large enough, else Python's."""
    largest = int(np.abs(x).max(initial=0))
    if n * largest + max(map(abs, sums), default=0) < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _added(matrices: DataFrame) -> np.ndarray:
    """The sum over rows of the column `m` of equally long arrays."""
    if matrices.schema["m"].dataType.elementType.typeName() == "decimal":
        total = F.sum("v")
    else:
        total = F.sum(F.col("v").cast("double"))
    rows = matrices.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(total.alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """Number of rows, then the exact sums by dimension."""

    def add(batches):
        n, total = 0, [0] * dims
        for _, x in _blocks(batches, dims, "x"):
            n += len(x)
            small = len(x) * int(np.abs(x).max(initial=0)) < _SAFE
            total = [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(axis=0), strict=True)]
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array([[n, *total]], pa.list_(kind))], ["m"])

    return [int(v) for v in _added(fit.mapInArrow(add, "m array<decimal(38,0)>"))]


def _products(fit: DataFrame, dims: int, n: int, sums: list[int], turn: np.ndarray | None) -> np.ndarray:
    """Covariance, divisor n, of the fit list's centred rows, or of their projections by turn."""
    width = dims if turn is None else turn.shape[1]

    def multiply(batches):
        total, seen = np.zeros((width, width)), False
        for _, x in _blocks(batches, dims, "x"):
            centred = _apart(x, n, sums).astype(float) / n
            centred = centred if turn is None else centred @ turn
            total += centred.T @ centred
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])

    return np.array(_added(fit.mapInArrow(multiply, "m array<double>")), float).reshape(width, width) / n


def whiten(vectors: DataFrame, vector: str = "embedding", most: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    vectors: vec_id, `vector`; other columns are ignored. Usable: the vector isn't null and all its entries are finite
    numbers. Vectors of another length than the most frequent one (of equally frequent ones the longest) take no part,
    nor do empty ones. Repeated rows and a null vec_id are rows like others; equal vectors count once in the fit.
    Components of eigenvalue 0 (constant or dependent dimensions, one vector alone) are left out: no row if all are.
    deviation is null if it is beyond a long. Empty table: no rows. Memory: dims x dims numbers in a task and on the driver.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    v = F.col(vector)
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < TOO_LARGE, F.lit(False)))
    whole: Column = F.transform(v, lambda c: F.floor(c.cast("double") * STEPS) + F.lit(OFFSET).cast("long"))
    usable = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(finite).select("vec_id", whole.alias("x"))
    sizes = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return empty
    dims = sizes["d"]
    usable = usable.where(F.size("x") == dims)
    fit = materialize(usable.select("x").distinct())
    n, *sums = _sums(fit, dims)
    covariance = _products(fit, dims, n, sums, None)
    values, components = jacobi(cholesky(covariance))
    values, components = values[:most], components[:, :most]
    if not len(values):
        return empty
    turn = components / np.sqrt(values)
    error = float(np.abs(_products(fit, dims, n, sums, turn) - np.eye(len(values))).max())

    def project(batches):
        for part, x in _blocks(batches, dims, "x"):
            apart = _apart(x, n, sums)
            small = dims * int(np.abs(apart).max(initial=0)) ** 2 < _SAFE
            squares = (apart if small else apart.astype(object)) ** 2
            deviation = [s if s < 1 << 63 else None for s in map(int, squares.sum(axis=1))]
            whitened = apart.astype(float) / n @ turn
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviation, pa.int64()), pa.array(list(whitened), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = usable.mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    shares = F.array(*(F.lit(float(e)) for e in values / np.trace(covariance)))
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error"))
