"""Whitening of embeddings. The leading components of the covariance are found by contour integration.

Three passes over the table give the sums, the covariance and, once the components are known, the covariance of the
whitened values, which says how far it is from the identity. What a task returns has the size of the covariance, not
of its rows. Sums and cross products are whole numbers added without rounding: the components do not
depend on how rows are spread.

Components: bisection with inertia counts (signs of the pivots of V - s) closes in on the wanted part of the spectrum and cuts
it into intervals of a few eigenvalues. For each interval random vectors are filtered by a quadrature of
(z - V)^-1 along a circle around it, Rayleigh-Ritz takes eigenpairs out of the filtered space, and this repeats until the
residuals vanish and as many pairs lie inside as the inertia counts of its ends promise. This is work on one
matrix of dim x dim, whatever the number of rows.

Defined cases
    Vectors that are null or hold a null or a number that is not finite are dropped. Other rows stay, also those with a
    null or repeated id; each is one vector. Vectors shorter than the longest are filled with zeros.
    Directions without variance have no component, so there may be fewer than wanted: none for a single vector
    or equal vectors, which then have no rows in the result. An empty table gives an empty table.
    Tied eigenvalues: any basis of their space, the same for all rows. Of the two signs a component has the one that makes its
    largest entry positive.
    Columns that are not kept do not matter; a kept one must not be named like a column of the result (ValueError).
    Components of 2^40 and above are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.vectors import doubles, finite, matrix, whole, width
from wiretally.session import landed

SCALE, SHIFT = 1024, 100_000
LIMIT = 1 << 50
NODES = 8
#: Eigenvalues of an interval, where bisection can part them.
CROWD = 4
RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of a symmetric factorisation of v - shift with pivots
    of one or two rows; one of two rows has a positive and a negative eigenvalue."""
    a = v - shift * np.eye(len(v))
    alpha = (1 + 17 ** 0.5) / 8
    count = 0
    while len(a):
        size, far = 1, 0
        if len(a) > 1:
            far = 1 + int(np.argmax(np.abs(a[1:, 0])))
            most = abs(a[far, 0])
            if abs(a[0, 0]) < alpha * most:
                rest = np.abs(a[:, far])
                rest[far] = 0
                if abs(a[0, 0]) * rest.max() < alpha * most * most:
                    size, to = (1, 0) if abs(a[far, far]) >= alpha * rest.max() else (2, 1)
                    order = np.arange(len(a))
                    order[[to, far]] = order[[far, to]]
                    a = a[np.ix_(order, order)]
        head, side = a[:size, :size], a[size:, :size]
        if size == 2:
            count += 1
            a = a[2:, 2:] - side @ np.linalg.solve(head, side.T)
        else:
            count += bool(head[0, 0] > 0)
            a = a[1:, 1:] - (side @ side.T / head[0, 0] if head[0, 0] else 0)
    return count


def intervals(v: np.ndarray, wanted: int, tolerance: float) -> list[tuple[float, float, int]]:
    """``low, high, eigenvalues inside`` of intervals that hold the ``wanted`` largest eigenvalues, and more only where
    they cannot be told apart."""
    high = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-12) + tolerance
    out, over = -tolerance, above(v, -tolerance)
    bound = high
    while over > wanted and bound - out > tolerance:
        middle = (out + bound) / 2
        n = above(v, middle)
        if n >= wanted:
            out, over = middle, n
        else:
            bound = middle
    found, todo = [], [(out, high, over, 0)]
    while todo:
        a, b, n_a, n_b = todo.pop()
        if n_a - n_b <= CROWD or b - a <= 4 * tolerance:
            if n_a > n_b:
                found.append((a, b, n_a - n_b))
            continue
        middle = (a + b) / 2
        n = above(v, middle)
        todo += [(a, middle, n_a, n), (middle, b, n, n_b)]
    return found


def filtered(v: np.ndarray, low: float, high: float, y: np.ndarray) -> np.ndarray:
    """The part of ``y`` with eigenvalues between ``low`` and ``high``, by quadrature along the upper half circle."""
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(y)
    for x, w in zip(points, weights, strict=True):
        turn = radius * np.exp(0.5j * np.pi * (x + 1))
        out += w / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(len(v)) - v, y)).real
    return out


def inside(v: np.ndarray, low: float, high: float, count: int, tolerance: float) -> np.ndarray:
    """Eigenvectors of the ``count`` eigenvalues between ``low`` and ``high``."""
    rng = np.random.default_rng(29)
    size = min(len(v), max(2 * count, count + 6))
    while True:
        y, near = rng.standard_normal((len(v), size)), False
        for _ in range(30):
            q, _ = np.linalg.qr(filtered(v, low, high, y) if size < len(v) else y)
            values, turned = np.linalg.eigh(q.T @ v @ q)
            y = q @ turned
            chosen = (values > low) & (values <= high)
            gap = np.linalg.norm(v @ y[:, chosen] - y[:, chosen] * values[chosen], axis=0)
            if chosen.sum() == count and gap.max(initial=0) <= tolerance:
                if near:  # one more round than needed takes the last digits
                    return y[:, chosen]
                near = True
            if size == len(v):  # nothing is missing; an eigenvalue lies on an end, within rounding
                return y[:, np.argsort(np.abs(values - (low + high) / 2))[:count]]
        size = min(len(v), 2 * size)


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above rounding, falling, and their unit eigenvectors as columns."""
    size = float(np.trace(v))
    if not len(v) or size <= 0:
        return np.zeros(0), np.zeros((len(v), 0))
    scaled = v / size
    tolerance = 4 * len(v) * np.finfo(float).eps
    wanted = min(wanted, above(scaled, 4 * tolerance))
    parts = [inside(scaled, a, b, n, tolerance) for a, b, n in intervals(scaled, wanted, tolerance)]
    # One more Rayleigh-Ritz over all intervals makes their vectors orthogonal to each other.
    q, _ = np.linalg.qr(np.concatenate(parts, axis=1))
    values, turned = np.linalg.eigh(q.T @ scaled @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = q @ turned[:, order]
    vectors /= np.linalg.norm(vectors, axis=0)
    largest = np.abs(vectors).argmax(axis=0)
    return values[order] * size, vectors * np.sign(vectors[largest, np.arange(len(order))])


@dataclass
class Whitening:
    """``n`` vectors with ``sums`` per dimension, their ``trace``, falling eigenvalues and eigenvectors as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x minus the mean's whole part, and the rest of the mean times n, all whole numbers."""
        whole_part = np.array([s // self.n for s in self.sums], np.int64)
        return x - whole_part, np.array([s % self.n for s in self.sums], object)

    def project(self, x: np.ndarray) -> np.ndarray:
        y, rest = self.centred(x)
        off = y - np.array([r / self.n for r in rest], np.float64)
        return np.einsum("ij,jk->ik", off, self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 of every row, without rounding."""
        y, rest = self.centred(x)
        if max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) * (self.n + 1) * (y.shape[1] + 1) < 1 << 31:
            y = self.n * y - rest.astype(np.int64)
            return [int(d) for d in (y * y).sum(axis=1)]
        squares = (y.astype(object) ** 2).sum(axis=1)
        cross = (y.astype(object) * rest).sum(axis=1)
        return list(self.n ** 2 * squares - 2 * self.n * cross + (rest ** 2).sum())


def grid(column: pa.Array, dim: int) -> np.ndarray:
    """Whole numbers floor(1024 c) + 100000 of every component."""
    return whole(np.floor(matrix(column, dim) * SCALE), LIMIT) + SHIFT


def _exact_sums(vectors: DataFrame, size: int, of_batch) -> list[int]:
    """Totals over all rows of ``size`` whole numbers that ``of_batch`` gives for each Arrow batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for part in parts:
            total = [a + int(b) for a, b in zip(total, of_batch(part.column(0)), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["slot", "total"])

    partial = vectors.mapInArrow(run, "slot int, total decimal(38,0)")
    found = {r["slot"]: int(r["total"]) for r in partial.groupBy("slot").agg(F.sum("total").alias("total")).collect()}
    return [found.get(i, 0) for i in range(size)]


def fit(table: DataFrame, *, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """The whitening of all usable vectors of a table; None without any."""
    vectors = table.filter(finite(doubles(vector))).select(doubles(vector).alias("vector"))
    dim = width(vectors, "vector")

    def sums(column: pa.Array) -> list[int]:
        return [len(column), *grid(column, dim).sum(axis=0, dtype=object)]

    n, *total = _exact_sums(vectors, dim + 1, sums)
    if not n:
        return None
    first = Whitening(n, total, 0.0, np.zeros(0), np.zeros((dim, 0)))
    upper = np.triu_indices(dim)

    def products(column: pa.Array) -> list[int]:
        y, _ = first.centred(grid(column, dim))
        most = int(np.abs(y).max(initial=1))
        exact = most * most * len(y) < 1 << 53  # then doubles hold every sum as it is
        return (y.T.astype(float) @ y if exact else y.T.astype(object) @ y)[upper]

    crossed = _exact_sums(vectors, len(upper[0]), products)
    rest = [s % n for s in total]
    v = np.zeros((dim, dim))
    for i, j, p in zip(*upper, crossed, strict=True):
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / n ** 2
    return Whitening(n, total, float(np.trace(v)), *leading(v, components))


def identity_error(table: DataFrame, model: Whitening, *, vector: str = "embedding") -> float:
    """Largest entry, without sign, of the covariance of the whitened values of all usable vectors minus the identity."""
    k, dim = len(model.values), len(model.sums)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for part in parts:
            w = model.project(grid(part.column(0), dim))
            total += w.T @ w / model.n
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())],
                                         names=["slot", "total"])

    vectors = table.filter(finite(doubles(vector))).select(doubles(vector).alias("vector"))
    parts = vectors.mapInArrow(run, "slot int, total double").groupBy("slot").agg(F.sum("total").alias("total"))
    off = F.abs(F.col("total") - F.when(F.col("slot") % (k + 1) == 0, 1.0).otherwise(0.0))
    return parts.agg(F.max(off)).first()[0] if k else 0.0


def whiten(table: DataFrame, keep: list[str], *, vector: str = "embedding", components: int = 8) -> DataFrame:
    """The kept columns and ``component, n, deviation, whitened, explained, identity_error`` of every usable row and
    component. ``deviation`` is a decimal, so that it is exact for any number of rows."""
    clash = set(keep) & set(RESULT)
    if clash:
        raise ValueError(f"kept columns are named like results: {sorted(clash)}")
    rows = table.filter(finite(doubles(vector))).select(*keep, doubles(vector).alias("whitened_vector"))
    schema = rows.drop("whitened_vector").select(
        *keep, F.lit(1).alias("component"), F.lit(1).cast("bigint").alias("n"),
        F.lit(1).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("whitened"),
        F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")).schema
    model = fit(table, vector=vector, components=components)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(table, model, vector=vector)
    k, dim = len(model.values), len(model.sums)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            size = part.num_rows
            x = grid(part.column(len(keep)), dim)
            at = pa.array(np.repeat(np.arange(size), k))
            deviation = pa.array(model.deviation(x), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i).take(at) for i in range(len(keep))],
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                 pa.array(np.full(size * k, model.n)), deviation.take(at), pa.array(model.project(x).ravel()),
                 pa.array(np.tile(model.values / model.trace if k else np.zeros(0), size)),
                 pa.array(np.full(size * k, error))], names=[*keep, *RESULT])

    return rows.mapInArrow(run, schema)
