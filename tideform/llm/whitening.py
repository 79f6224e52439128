"""Embedding whitening: leading eigenvectors of the covariance by LOBPCG, never forming the covariance.

A pass over the fit list multiplies the covariance by a block of directions: each task centres its rows and adds up
rows' x (rows x block), and Spark sums those partial products by line. The driver holds blocks of directions only: the
iterate, its residual and the previous direction, from which a Rayleigh-Ritz step takes the next iterate. It goes on until
the residuals of the wanted vectors certify them, so every eigenvector is right to the rounding of the products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideform.llm.common import Scratch

SCALE, OFFSET = 64, 1_000_000
GUARD = 8  # directions iterated beside the wanted ones, which speeds up the last of those
SURE = 1e-13  # residual that certifies a vector, as a share of the largest eigenvalue
ENOUGH = 1e-11  # the same where rounding lets it shrink no further
ROUNDS = 500  # raises where so many do not settle
SLICE = 1 << 20  # entries worked on at once
FLAT = 1e-12  # an eigenvalue below this share of the largest is rounding: there is no such component
LARGEST = float(1 << 30)  # entries from here on count as not finite, so that sums of a task fit a long


def finite(vec: F.Column) -> F.Column:
    """Whether an array of doubles is there and holds finite numbers of a size that a long takes only."""
    return F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)), F.lit(False))


def matrix(column: pa.Array, dim: int, dtype: type = np.int64) -> np.ndarray:
    """Rows of an Arrow column of lists that are all ``dim`` long."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dim)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S exactly, as integers."""
    if n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0)) >= 1 << 62:
        return x.astype(object) * n - sums.astype(object)
    return x * n - sums.astype(np.int64)


def _sliced(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    step = max(1, SLICE // max(1, dim))
    for batch in batches:
        x = matrix(batch.column(0), dim)
        for at in range(0, len(x), step):
            yield x[at : at + step]


def summed(rows: DataFrame, part: Callable[[Iterator[np.ndarray]], np.ndarray], shape: tuple[int, int], dim: int, kind: str = "double") -> np.ndarray:
    """Sum over all tasks of a matrix that each makes from its rows; the driver gets one such matrix, whatever the table.

    ``rows`` has one column, an array of longs ``dim`` long. A task returns its matrix line by line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = part(_sliced(batches, dim))
        lines = pa.array(list(got), pa.list_(pa.int64() if kind == "bigint" else pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got)), pa.int32()), lines], names=["line", "v"])

    lines = rows.mapInArrow(run, f"line int, v array<{kind}>").groupBy("line").agg(*[F.sum(F.col("v")[j]).alias(f"c{j}") for j in range(shape[1])])
    out = np.zeros(shape, np.int64 if kind == "bigint" else np.float64)
    for r in lines.collect():  # as many as the matrix has lines
        out[r[0]] = r[1:]
    return out


def _orthonormal(basis: list[np.ndarray]) -> np.ndarray:
    """Orthonormal columns that span the first block, and what the others add to it."""
    q = np.linalg.qr(basis[0])[0]
    rest = np.concatenate(basis[1:], axis=1) if len(basis) > 1 else np.empty((len(q), 0))
    for _ in range(2):
        rest = rest - q @ (q.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        rest = rest[:, size > 0] / size[size > 0]
    if not rest.shape[1]:
        return q
    u, s, _ = np.linalg.svd(rest, full_matrices=False)
    u = u[:, s > 1e-8 * s[0]][:, : len(q) - q.shape[1]]
    u = u - q @ (q.T @ u)
    return np.concatenate([q, np.linalg.qr(u)[0]], axis=1) if u.shape[1] else q


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix known by its products only.

    ``product`` multiplies the matrix by a block of columns. Raises ArithmeticError where the residuals do not certify the
    vectors within ROUNDS products.
    """
    wanted = min(dim, wanted)
    x = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, min(dim, wanted + GUARD))))[0]
    basis, best, still = [x], np.inf, 0
    for _ in range(ROUNDS):
        q = _orthonormal(basis)
        aq = product(q)
        t = q.T @ aq
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1][: x.shape[1]], y[:, ::-1][:, : x.shape[1]]
        new = q @ y
        residual = aq @ y - new * values
        worst, top = np.linalg.norm(residual[:, :wanted], axis=0).max(), max(abs(values[0]), np.finfo(float).tiny)
        still = 0 if worst < 0.5 * best else still + 1
        best = min(best, worst)
        if worst <= SURE * top or still >= 3 and worst <= ENOUGH * top:
            return values[:wanted], new[:, :wanted] / np.linalg.norm(new[:, :wanted], axis=0)
        basis = [new, residual, new - x @ (x.T @ new)]
        x = new
    raise ArithmeticError(f"eigenvectors are not certified after {ROUNDS} products")


def _one_length(rows: DataFrame, dim: int, components: int, scratch: Scratch) -> DataFrame | None:
    spark = rows.sparkSession
    fit = scratch.save(rows.select("x").distinct(), f"fit-{dim}")
    n = fit.count()
    sums = summed(fit, lambda xs: sum((x.sum(0, keepdims=True) for x in xs), np.zeros((1, dim), np.int64)), (1, dim), dim, "bigint")[0]

    def around(x: np.ndarray) -> np.ndarray:
        return centred(x, n, sums).astype(np.float64) / n

    def product(block: np.ndarray) -> np.ndarray:
        def part(xs: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros(block.shape)
            for x in xs:
                z = around(x)
                out += z.T @ (z @ block)
            return out

        return summed(fit, part, block.shape, dim) / n

    trace = summed(fit, lambda xs: np.array([[sum(float((around(x) ** 2).sum()) for x in xs)]]), (1, 1), dim)[0, 0] / n
    if trace <= 0:
        return None
    values, vectors = leading_pairs(product, dim, components)
    keep = values > FLAT * values[0]
    values, vectors = values[keep], vectors[:, keep]
    k = len(values)

    def white(c: np.ndarray) -> np.ndarray:
        return (c.astype(np.float64) / n) @ vectors / np.sqrt(values)

    def moments(xs: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((k + 1, k))
        for x in xs:
            w = white(centred(x, n, sums))
            out[:k] += w.T @ w
            out[k] += w.sum(0)
        return out

    got = summed(fit, moments, (k + 1, k), dim) / n
    error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SLICE // max(dim, k))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = matrix(batch.column(1), dim)
                c, m = centred(x, n, sums), len(x)
                if c.dtype == object or float(np.abs(c).max(initial=0)) ** 2 * dim >= 2.0**62:
                    deviation = [v if v < 1 << 63 else None for v in (c.astype(object) ** 2).sum(1).tolist()]
                else:
                    deviation = (c * c).sum(1)
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    pa.array(deviation, pa.int64()).take(again), pa.array(white(c).ravel()), pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whitened(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vectors projected on the leading components of their covariance, each scaled to unit variance.

    Entries become the long floor(SCALE * c) + OFFSET; the covariance is over each distinct such vector once. Returns one
    row per input row and component, numbered from 1 by falling eigenvalue: ``(id_col, component, n, deviation, whitened,
    explained, identity_error)``. ``deviation`` is the exact sum of (n * x - S)^2, null where no long takes it.
    Rows whose vector is null, or holds a null, a NaN, an infinite entry or one of 2^30 and more, are dropped. Vectors of
    different lengths are spaces of their own, each fitted by itself; an empty vector, and a space whose vectors are all
    equal, has no component and so no rows; nor has a direction without variance. Rows that repeat an identifier, or have
    none, come back each. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    vec = F.col(vec_col).cast("array<double>")
    good = vectors.select(F.col(id_col).alias("id"), F.when(finite(vec), vec).alias("v")).where("size(v) > 0")
    rows = good.select("id", F.transform("v", lambda v: F.floor(v * SCALE) + OFFSET).alias("x"))
    out = None
    for r in rows.groupBy(F.size("x").alias("dim")).count().orderBy("dim").collect():  # the lengths that vectors have
        some = _one_length(rows.where(F.size("x") == r["dim"]), r["dim"], components, scratch)
        out = some if out is None else out if some is None else out.unionByName(some)
    if out is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        out = spark.createDataFrame([], f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
