"""Embedding whitening: float32 eigenvectors of a distributed covariance, refined in higher precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructField, StructType

from .common import store

#: Components that are returned, and how many steps an entry of a vector is cut into.
COMPONENTS = 4
STEPS = 256
#: Rounds of refinement at most; each about doubles the right digits, so few are ever used.
ROUNDS = 40


def whole(vector: str, steps: int = STEPS) -> Column:
    """The entries as ``floor(steps * entry)``, null where the vector is null, empty or holds null or non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    entries = F.transform(vector, lambda c: F.floor(c.cast("double") * float(steps)).cast("long"))
    return F.when(finite & (F.size(vector) > 0), entries)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists of longs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each entry, as exact integers; one row per entry reaches the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=object)
        for batch in batches:
            x = matrix(batch.column("x"), width)
            n += len(x)
            # halves of 32 bits, so that no sum of a batch leaves 64 bits
            total += (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        if n:
            halves = [[int(t) >> 32 for t in total], [int(t) & 0xFFFFFFFF for t in total]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), *[pa.array(h, pa.int64()) for h in halves]],
                names=["at", "n", "high", "low"],
            )

    parts = fit.mapInArrow(each, "at int, n long, high long, low long")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col(h).cast("decimal(38,0)")).alias(h) for h in ("high", "low")])
    found = sorted(rows.collect())
    return (int(found[0]["n"]), [int(r["high"]) * (1 << 32) + int(r["low"]) for r in found]) if found else (0, [0] * width)


def products(fit: DataFrame, width: int, project: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all vectors of ``yᵀy`` for ``y = project(x)``, a matrix of ``size`` rows and columns.

    Every task sends one matrix, row by row; the rows are added up where they meet, one matrix row in memory each.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = project(matrix(batch.column("x"), width))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "line"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            lines = batch.column("line").flatten().to_numpy().reshape(-1, size)
            for at, line in zip(batch.column("at").to_pylist(), lines):
                held[at] = held[at] + line if at in held else line.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["at", "line"]
        )

    schema = "at int, line array<double>"
    total = np.zeros((size, size))
    for row in fit.mapInArrow(each, schema).repartition("at").mapInArrow(add, schema).collect():
        total[row["at"]] += row["line"]
    return (total + total.T) / 2


def orthogonal(w: np.ndarray) -> np.ndarray:
    """A nearly orthogonal matrix made orthogonal to its own precision (Newton and Schulz)."""
    one = np.eye(len(w), dtype=w.dtype)
    for _ in range(3):
        w = w @ (3 * one - w.T @ w) / 2
    return w


def norm_beside(s: np.ndarray) -> float:
    """The norm of what stands beside the diagonal."""
    off = s - np.diag(np.diag(s))
    return np.sqrt((off * off).sum())


def eigen(a: np.ndarray, high: type = np.longdouble) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in the precision of ``high``.

    The first vectors are those of the matrix in float32.  Each round of Ogita and Aishima's iteration corrects
    them by matrix products in ``high``: with ``R = I - XᵀX`` and ``S = XᵀAX``, entry (i, j) of the correction
    is ``(S + R * value_j) / (value_j - value_i)`` for values that are told apart, and ``R / 2`` for those that
    are not.  Values closer than the error bound form a cluster; its block of S, shifted by its mean and scaled,
    is solved on its own in float32 and turns the cluster's vectors, until they are told apart or equal.
    """
    a = np.asarray(a, dtype=high)
    scale = np.abs(a).max(initial=high(0))
    if not scale > 0:
        return np.zeros(len(a), dtype=high), np.eye(len(a), dtype=high)
    a = a / scale
    one, small = np.eye(len(a), dtype=high), 8 * len(a) * np.finfo(high).eps
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(high)
    norm, best, kept, stalls = np.sqrt((a * a).sum()), np.inf, x, 0
    for _ in range(ROUNDS):
        r, s = one - x.T @ x, x.T @ a @ x
        wrong = max(np.abs(s - np.diag(np.diag(s))).max(), np.abs(r).max())
        stalls = 0 if wrong < best / 2 else stalls + 1
        if wrong < best:
            best, kept = wrong, x
        if wrong <= small or stalls > 3:
            break
        values = np.diag(s) / (1 - np.diag(r))
        skew = norm * np.sqrt((r * r).sum())
        bound = 2 * (norm_beside(s) + skew)
        order = np.argsort(values)
        clusters = [c for c in np.split(order, np.flatnonzero(np.diff(values[order]) > bound) + 1) if len(c) > 1]
        for c in clusters:
            block = s[np.ix_(c, c)] - values[c].mean() * one[np.ix_(c, c)]
            if norm_beside(block) > small:
                turn = np.linalg.eigh((block / np.abs(block).max()).astype(np.float32))[1]
                x[:, c] = x[:, c] @ orthogonal(turn.astype(high))
        r, s = one - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        told = np.abs(gap) > bound
        for c in clusters:
            inner = np.ix_(c, c)
            told[inner] = np.abs(gap[inner]) > 2 * (norm_beside(s[inner]) + skew) + small
        e = np.where(told, (s + values[None, :] * r) / np.where(told, gap, 1), r / 2)
        x = x + x @ e
    x = orthogonal(kept)
    values = np.diag(x.T @ a @ x) / (x * x).sum(0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order] * scale, x / np.sqrt((x * x).sum(0))


def whiten(
    rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, steps: int = STEPS,
    high: type = np.longdouble,
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    Vectors count in whole steps, ``x = floor(steps * entry)``.  Left out are rows whose vector is null, empty,
    or holds null or non-finite entries, and vectors of another length than most distinct ones have (of equally
    frequent lengths the longest counts).  Entries beyond 64 bits count as the last whole number.

    Means and covariance are those of the distinct vectors, each once.  ``component`` runs from 1 by falling
    eigenvalue of the covariance; there are ``components`` of them, or as many as a vector has entries.
    ``whitened`` is the vector less the mean, projected on the component, over the root of its eigenvalue; it is
    null for components without variance (eigenvalues no larger than rounding leaves, so all of a single
    distinct vector's).  ``explained`` is the eigenvalue's part of the trace, null if that is 0.  ``deviation``
    (decimal) is the sum of ``(n * x - S)^2`` over the entries, exact, and null beyond 38 digits.  ``identity_error`` is the largest entry
    of whitened's covariance less the identity.  Null and repeated ids are rows like others, other columns are
    ignored whatever their names, an empty table gives an empty result.

    Distinct vectors are found by an aggregate that combines copies before its shuffle.  The driver holds the
    covariance alone, whose size is that of the dimension, and the tasks' parts of it are added up in tasks.
    """
    kind = rows.schema[id].dataType
    cut = rows.select(F.col(id).alias("id"), whole(vector, steps).alias("x")).where("x is not null")
    fit = store(cut.select("x").distinct(), "vectors")
    lengths = fit.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = lengths["width"] if lengths else 1
    fit, cut = (df.where(F.size("x") == width) for df in (fit, cut))
    count = min(components, width)

    n, sums = exact_sums(fit, width)
    mean = np.array([float(Fraction(s, max(n, 1))) for s in sums])
    cov = products(fit, width, lambda x: x - mean, width) / max(n, 1)
    values, vectors = eigen(cov, high)
    trace = float(np.trace(cov))
    floor = width * np.finfo(float).eps * max(float(values[0]), 0.0)
    real = [k for k in range(count) if float(values[k]) > floor]
    axes = np.array(vectors[:, real] / np.sqrt(values[real]), dtype=float).reshape(width, len(real))
    square = products(fit, width, lambda x: (x - mean) @ axes, len(real)) / max(n, 1) if real else np.zeros((0, 0))
    error = float(np.abs(square - np.eye(len(real))).max(initial=0.0))
    explained = [float(v) / trace if trace > 0 else None for v in values[:count]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            placed = np.full((len(x), count), np.nan)
            placed[:, real] = (x - mean) @ axes
            known = np.tile(np.isin(np.arange(count), real), len(x))
            each_row = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(each_row),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * count, n), pa.int64()),
                    deviations(x, n, sums).take(each_row),
                    pa.array(placed.reshape(-1), mask=~known),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array(np.full(len(x) * count, error)),
                ],
                names=["id", *NAMES],
            )

    shape = StructType([StructField("id", kind), *StructType.fromDDL(", ".join(f"{a} {b}" for a, b in zip(NAMES, TYPES))).fields])
    return cut.mapInArrow(each, shape).withColumnRenamed("id", id)


NAMES = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
TYPES = ["int", "long", "decimal(38,0)", "double", "double", "double"]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum of ``(n * x - S)^2`` of each row, exact: in 64-bit arithmetic where a bound on all of them fits."""
    most = n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        y = n * x - np.array(sums, dtype=np.int64)
        return pc.cast(pa.array((y * y).sum(1)), pa.decimal128(38, 0))
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([Decimal(v) if v < 10**38 else None for v in found], pa.decimal128(38, 0))
