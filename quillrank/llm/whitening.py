"""Embedding whitening (operator 13).

Every entry c of a vector becomes the whole number x = floor(64 c) + 1000000.
The whitened vector is x less its mean, projected on the leading unit
eigenvectors of x's covariance, over the square roots of their eigenvalues.

1. Tasks sum x; the mean's whole part is taken off before anything is
   multiplied, so the scatter is of small whole numbers and exact: products
   are summed within 2^53 by matrix products and as pairs of longs beyond.
   The covariance is therefore the same however rows are dealt, and has no
   rounding but its own last one.
2. The driver, which sees only sums (dimension squared numbers), factors the
   centred scatter by Cholesky with pivots and rotates the columns of the
   triangular factor until they are orthogonal (one-sided Jacobi). Their
   squared norms are the eigenvalues, the normalised columns the components.
3. Rows are mapped without a shuffle. What the covariance of the whitened rows
   lacks to the identity is measured over all rows.

Defined results: rows without a vector, with null or non-finite entries, or
with another dimension than the commonest one (of equally common ones the
greatest) are left out; entries are held within +-2^53 / 64 (64 c as a whole
double); components whose eigenvalue is zero to working precision are left
out, so one vector, equal vectors and an empty table give no rows; rows may
repeat and ids may be null; signs are such that the entry of a component
farthest from 0 (of equal ones the first) is positive. ``deviation`` is null
where its value is beyond a long; ``deviation_decimal`` has it up to 38
digits. More than ``DIMENSIONS`` dimensions raise ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import col

#: Step and offset of the whole numbers (fixed by the definition).
STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Most dimensions, as the driver holds a square matrix of them.
DIMENSIONS = 4096
#: Numbers of vectors worked on at a time.
SLICE = 1 << 19
_LIMB, _HALF = 20, 32


def usable(vectors: DataFrame, carry: list[str], vector_col: str) -> DataFrame:
    """Struct ``doc`` of the ``carry`` columns and ``vector`` of the rows whose entries are all finite numbers."""
    doc = F.struct(*[col(c).alias(c) for c in carry] or [F.lit(0)]).alias("doc")
    rows = vectors.select(doc, col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))))


def whole_numbers(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and x of some vectors (rows of a matrix) at a time, by runs of one dimension."""
    lengths = np.diff(np.asarray(column.offsets))
    starts = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1]])) if len(lengths) else []
    values = np.asarray(column.values)
    for start, end in zip(starts, [*starts[1:], len(lengths)], strict=True):
        size = int(lengths[start])
        step = max(1, SLICE // max(1, size))
        for at in range(start, end, step):
            stop = min(at + step, end)
            first = column.offsets[at].as_py()
            c = values[first : first + size * (stop - at)].reshape(stop - at, size)
            yield at, np.clip(np.floor(c * float(STEPS)), -float(1 << 53), float(1 << 53)).astype(np.int64) + OFFSET


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as two, whose sums stay far within a long."""
    return values >> _HALF, values & ((1 << _HALF) - 1)


def vector_sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Commonest dimension, number of its vectors, and the sums of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                held = sums.setdefault(x.shape[1], [0, 0, 0])
                high, low = _halves(x)
                held[:] = [held[0] + len(x), held[1] + high.sum(0), held[2] + low.sum(0)]
        for size, (n, high, low) in sums.items():
            places = np.arange(max(1, size))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), v), pa.int64()) if np.ndim(v) == 0 else pa.array(v if size else [0], pa.int64()) for v in (size, places, n, high, low)], names=["size", "place", "n", "high", "low"])

    parts = rows.select("vector").mapInArrow(run, "size long, place long, n long, high long, low long")
    sums = parts.groupBy("size", "place").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).checkpoint()
    common = sums.where("place = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not common:
        return 0, 0, []
    size, n = common[0]["size"], common[0]["n"]
    if size > DIMENSIONS:
        raise ValueError(f"vectors of {size} dimensions; {DIMENSIONS} at most")
    found = sums.where(F.col("size") == size).orderBy("place").collect() if size else []
    return size, n, [(r["high"] << _HALF) + r["low"] for r in found]


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Whole numbers in parts of 20 bits (the last one signed), as doubles; one part if they are small."""
    out = []
    while np.abs(y).max(initial=0) >= 1 << _LIMB:
        out.append((y & ((1 << _LIMB) - 1)).astype(np.float64))
        y = y >> _LIMB
    return [*out, y.astype(np.float64)]


def scatter(rows: DataFrame, size: int, whole_mean: list[int]) -> list[list[int]]:
    """The exact sums of products of all pairs of entries, less the whole part of their means (lower triangle)."""
    mean = np.array(whole_mean, np.int64)
    lower = np.tril_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                for at in range(0, len(x), 1 << 12):  # 2^12 products below 2^40 are exact in doubles
                    limbs = _limbs(x[at : at + (1 << 12)] - mean)
                    for a, left in enumerate(limbs):
                        for b, right in enumerate(limbs):
                            high, low = _halves((left.T @ right)[lower].astype(np.int64))
                            held = sums.setdefault(a + b, [0, 0])
                            held[:] = [held[0] + high, held[1] + low]
        for power, (high, low) in sums.items():
            arrays = [pa.array(np.full(len(lower[0]), power)), pa.array(lower[0]), pa.array(lower[1]), pa.array(high), pa.array(low)]
            yield pa.RecordBatch.from_arrays(arrays, names=["power", "i", "j", "high", "low"])

    parts = rows.select("vector").mapInArrow(run, "power long, i long, j long, high long, low long")
    out = [[0] * (i + 1) for i in range(size)]
    for r in parts.groupBy("power", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        out[r["i"]][r["j"]] += ((r["high"] << _HALF) + r["low"]) << _LIMB * r["power"]
    return out


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """L with matrix = L L^T to working precision: a column for each pivot, triangular in their order."""
    size = len(matrix)
    left = matrix.diagonal().copy()
    columns = np.zeros((size, size))
    least = size * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(size):
        pivot = int(np.argmax(left))
        if left[pivot] <= least:
            return columns[:, :k]
        column = matrix[:, pivot] - columns[:, :k] @ columns[pivot, :k]
        column /= math.sqrt(left[pivot])
        column[left < 0] = 0.0  # rows of the pivots before
        column[pivot] = math.sqrt(left[pivot])
        columns[:, k] = column
        left = np.where(left < 0, left, np.maximum(left - column**2, 0.0))
        left[pivot] = -1.0
    return columns


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns rotated in pairs until all are orthogonal; each round takes pairs that share no column."""
    g = factor.T.copy()
    r = len(g)
    if r < 2:
        return g.T
    seats = np.arange(r + r % 2)  # the last seat of an odd number is empty
    enough = np.finfo(float).eps * math.sqrt(factor.shape[0])
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            a, b, c = (g[p] ** 2).sum(1), (g[q] ** 2).sum(1), (g[p] * g[q]).sum(1)
            far = np.abs(c) > enough * np.sqrt(a * b)
            if far.any():
                turned = True
                p, q, a, b, c = p[far], q[far], a[far], b[far], c[far]
                z = (b - a) / (2 * c)
                t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1.0, z))
                cos = 1 / np.hypot(1.0, t)
                sin = cos * t
                one, two = g[p], g[q]
                g[p], g[q] = cos[:, None] * one - sin[:, None] * two, sin[:, None] * one + cos[:, None] * two
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    return g.T


@dataclass
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # dimension, component
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the whole part of its mean, and less all of it."""
        y = x - np.array([s // self.n for s in self.sums], np.int64)
        return y, y - np.array([(s % self.n) / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x)[1] @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n x - S)^2 of each row."""
        y = self.centred(x)[0]
        rest = np.array([s % self.n for s in self.sums], np.int64)
        top = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if x.shape[1] * top * top < 1 << 63:
            return ((self.n * y - rest) ** 2).sum(1).tolist()
        if top < 1 << 61:  # squares of numbers in two parts of 31 bits, in two halves each
            high, low = np.divmod(self.n * y - rest, 1 << 31)
            total = [0] * len(x)
            for product, shift in ((high * high, 62), (high * low, 32), (low * low, 0)):
                for half, by in zip(_halves(product), (_HALF, 0), strict=True):
                    total = [t + (v << shift + by) for t, v in zip(total, half.sum(1).tolist(), strict=True)]
            return total
        return [sum((self.n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in y.tolist()]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``rows`` (None if there is nothing to scale by)."""
    size, n, sums = vector_sums(rows)
    if not size:
        return None
    rows = rows.where(F.size("vector") == size)
    products = scatter(rows, size, [s // n for s in sums])
    rest = [s % n for s in sums]
    covariance = np.zeros((size, size))
    numerators = [0] * size
    for i in range(size):
        for j in range(i + 1):
            value = n * products[i][j] - rest[i] * rest[j]  # n^2 times the covariance, exact
            covariance[i, j] = covariance[j, i] = value / (n * n)
            if i == j:
                numerators[i] = value
    rotated = orthogonal_columns(pivoted_cholesky(covariance))
    norms = (rotated**2).sum(0)
    order = [k for k in np.argsort(-norms, kind="stable") if norms[k] > 0][:components]
    if not order:
        return None
    vectors = rotated[:, order] / np.sqrt(norms[order])
    vectors *= np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(order))])
    return Whitening(n, sums, vectors, norms[order], sum(numerators) / (n * n))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, in size, of the whitened rows' covariance less the identity."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    k = len(model.eigenvalues)
    lower = np.tril_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                w = shared.value.apply(x)
                total += w.sum(0)
                products += w.T @ w
        i, j = np.concatenate([lower[0], np.full(k, -1)]), np.concatenate([lower[1], np.arange(k)])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate([products[lower], total]))], names=["i", "j", "value"])

    parts = rows.select("vector").mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    mean, covariance = np.zeros(k), np.zeros((k, k))
    for r in parts:
        if r["i"] < 0:
            mean[r["j"]] = r["value"] / model.n
        else:
            covariance[r["i"], r["j"]] = covariance[r["j"], r["i"]] = r["value"] / model.n
    # x was centred already; what rounding left of the mean is taken off.
    return float(np.abs(covariance - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, carry: list[str], vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``doc`` (struct of the ``carry`` columns), ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``, ``deviation_decimal``: a row for each vector and component."""
    rows = usable(vectors, carry, vector_col)
    model = fit(rows, components)
    schema = rows.select("doc", F.lit(0).alias("component"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained")).schema
    if model is None:
        out, n, error = rows.sparkSession.createDataFrame([], schema), 0, 0.0
    else:
        k = len(model.eigenvalues)
        explained = model.eigenvalues / model.trace
        rows = rows.where(F.size("vector") == len(model.sums))
        n, error = model.n, identity_error(rows, model)
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, SLICE // 4 // k)
            for batch in batches:
                for first, x in whole_numbers(batch.column(1)):
                    for at in range(0, len(x), step):
                        some = x[at : at + step]
                        whitened, deviations = shared.value.apply(some), shared.value.deviations(some)
                        docs = batch.column(0).slice(first + at, len(some)).take(pa.array(np.repeat(np.arange(len(some)), k)))
                        high, low = (np.repeat(np.array([v(d) for d in deviations], np.int64), k) for v in (lambda d: min(d >> 62, (1 << 63) - 1), lambda d: d & (1 << 62) - 1))
                        arrays = [docs, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))), pa.array(high), pa.array(low), pa.array(whitened.ravel()), pa.array(np.tile(explained, len(some)))]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "component", "high", "low", "whitened", "explained"])

        out = rows.select("doc", "vector").mapInArrow(run, schema)
    # Up to 2^124 fits into 38 digits; beyond, the high part is above 2^62 and the product overflows to null.
    exact = F.expr(f"try_add(try_multiply(CAST(high AS DECIMAL(20, 0)), CAST({1 << 62} AS DECIMAL(19, 0))), CAST(low AS DECIMAL(20, 0)))")
    out = out.withColumn("deviation_decimal", F.when(F.col("high") < F.lit(1 << 62), exact.try_cast("decimal(38,0)")))
    return out.select("doc", "component", F.lit(n).cast("long").alias("n"), F.col("deviation_decimal").try_cast("long").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"), "deviation_decimal")
