"""Whitening of embeddings: a compensated covariance and the eigenvectors of it.

Each task centres its vectors and adds their outer products in double-double: a number is the unevaluated sum of a high and a low
double, products and sums are taken with their rounding errors (error-free transformations). What tasks give out, a row of the
matrix at a time, is merged high with high and low with low, in two steps, so that no task gets what all tasks gave. The covariance is d * d numbers
for vectors of d components, however many vectors there are; only it goes to the driver, where LAPACK's syevd (numpy.linalg.eigh) solves it: reduction
to tridiagonal form, then divide and conquer. Rows are whitened where they are.

The fit list holds each different vector once; copies are merged before they move. It is written to the shared folder and read three times: for the sums, which
are exact, the covariance, and the covariance of the result. A lost executor costs its running tasks.

Defined results: vectors that are null or hold a null or non-finite component go; shorter vectors count as filled up with zeros; repeated rows each get their rows; a null id
stays null; a component without variance (all of them, if there is one different vector) has whitened null, and explained null if there is no variance at all; deviations beyond
longs end at their limit; components of over 2**53 in units of x are rounded to doubles; an empty table, or vectors without components, give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPREAD, as_matrix, mapped, stored, table, whole_vectors

#: Pairs of a row and a place of the matrix that are multiplied at once; bits by which a long is parted for sums.
WORK, HALF = 1 << 18, 32
MOST = (1 << 63) - 1


def two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def two_product(a, b, ah, al, bh, bl):
    p = a * b
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(ah, al, bh, bl):
    """Sum of two double-doubles."""
    s, e = two_sum(ah, bh)
    return two_sum(s, e + (al + bl))


def total(high, low):
    """Sums along the first axis, in pairs."""
    while len(high) > 1:
        half = len(high) // 2
        h, l = add(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])
        high, low = (np.concatenate([h, high[2 * half :]]), np.concatenate([l, low[2 * half :]])) if len(high) % 2 else (h, l)
    return high[0], low[0]


class Outer:
    """The sum of outer products of rows, given as high and low parts; the upper triangle."""

    def __init__(self, width: int):
        self.i, self.j = np.triu_indices(width)
        self.high, self.low = np.zeros(len(self.i)), np.zeros(len(self.i))

    def take(self, high: np.ndarray, low: np.ndarray) -> None:
        step = max(1, WORK // max(1, len(self.i)))
        for at in range(0, len(high), step):
            h, l = high[at : at + step], low[at : at + step]
            first, second = halves(h)
            i, j = self.i, self.j
            p, e = two_product(h[:, i], h[:, j], first[:, i], second[:, i], first[:, j], second[:, j])
            e += h[:, i] * l[:, j] + l[:, i] * h[:, j]
            self.high, self.low = add(self.high, self.low, *total(*two_sum(p, e)))


def _merged(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")
    high, low = (np.stack([np.asarray(x.values) for x in rows[c]]) for c in ("high", "low"))
    h, l = total(high, low)
    return pa.table({"i": rows["i"][:1], "part": pa.array([rows["part"][0].as_py() % SPREAD], pa.int64()), "high": pa.array([h.tolist()], pa.list_(pa.float64())), "low": pa.array([l.tolist()], pa.list_(pa.float64()))})


SUMS = "i int, part long, high array<double>, low array<double>"


def outer_sums(rows: DataFrame, width: int, centred: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], of: int) -> tuple[np.ndarray, np.ndarray]:
    """High and low part of the sum of outer products of centred(x) over rows (x: array of longs); centred turns a matrix of `of` columns into high and low parts of `width` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Outer(width), False
        for batch in batches:
            if len(batch):
                own.take(*centred(as_matrix(batch.column(0), of)))
                seen = True
        if seen:
            cuts = [np.flatnonzero(own.i == i) for i in range(width)]
            columns = [pa.array([v[c].tolist() for c in cuts], pa.list_(pa.float64())) for v in (own.high, own.low)]
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([TaskContext.get().partitionId()] * width, pa.int64()), *columns], ["i", "part", "high", "low"])

    parts = mapped(rows.select("x"), run, SUMS)
    for keys in (["i", F.pmod("part", F.lit(SPREAD)).alias("of")], ["i"]):
        parts = parts.groupBy(*keys).applyInArrow(_merged, SUMS)
    high, low = np.zeros((width, width)), np.zeros((width, width))
    for row in parts.collect():  # the matrix: width rows
        for side, values in ((high, row["high"]), (low, row["low"])):
            side[row["i"], row["i"] :] = side[row["i"] :, row["i"]] = values
    return high, low


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and sum of each component, exact at any size: longs are summed in two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, under = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = as_matrix(batch.column(0), width)
            n, upper, under = n + len(x), upper + (x >> HALF).sum(0), under + (x & ((1 << HALF) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(upper), pa.array(under)], ["i", "n", "upper", "under"])

    found = mapped(rows.select("x"), run, "i int, n long, upper long, under long").groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "upper", "under"))).collect()
    sums = [0] * width
    for row in found:
        sums[row["i"]] = (int(row["upper"]) << HALF) + int(row["under"])
    return (int(found[0]["n"]) if found else 0), sums


@dataclass
class Whitening:
    """What a fit gives: number of different vectors, sums by component, covariance, its largest eigenvalues, unit eigenvectors as columns, shares of the trace, the error."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    error: float | None

    @property
    def width(self) -> int:
        return len(self.sums)

    def centre(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """x less the mean, in double-double."""
        mean = [Fraction(s, self.n) for s in self.sums]
        high = np.array([float(m) for m in mean])
        low = np.array([float(m - Fraction(h)) for m, h in zip(mean, high.tolist(), strict=True)])

        def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s, e = two_sum(x.astype(np.float64), -high)
            return two_sum(s, e - low)

        return run

    def project(self) -> Callable[[np.ndarray], np.ndarray]:
        """Whitened components of x; NaN where there is no variance."""
        centre, scale = self.centre(), np.array([np.sqrt(v) if v > 0 else np.nan for v in self.values])

        def run(x: np.ndarray) -> np.ndarray:
            high, low = centre(x)
            return (high @ self.vectors + low @ self.vectors) / scale

        return run

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over components of (n * x - S) ** 2, exact."""
        reach = self.n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, self.sums), default=0)
        exact = np.int64 if reach * reach * max(1, self.width) < MOST else object
        d = x.astype(exact) * self.n - np.array(self.sums, exact)
        return [min(MOST, int(v)) for v in (d * d).sum(1)]


def fit(distinct: DataFrame, k: int) -> Whitening | None:
    """The k leading components of distinct (x: array of longs, each different vector once); None if it is empty or has no components."""
    width = distinct.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    n, sums = exact_sums(distinct, width)
    k = min(k, width)
    found = Whitening(n, sums, np.zeros((width, width)), np.zeros(k), np.zeros((width, k)), [None] * k, None)
    high, low = outer_sums(distinct, width, found.centre(), width)
    found.covariance = high / n + low / n
    values, vectors = np.linalg.eigh(found.covariance)
    trace = float(np.trace(found.covariance))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    found.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    found.values = np.where(values > trace * width * 2.0**-50, values, 0.0)  # below, it is rounding
    found.explained = [float(v) / trace if trace > 0 else None for v in found.values]
    there = int((found.values > 0).sum())
    if there:
        project = found.project()

        def result(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w = np.column_stack([project(x)[:, :there], np.ones(len(x))])  # the last column sums the others, for their mean
            return w, np.zeros_like(w)

        high, low = outer_sums(distinct, there + 1, result, width)
        full = (high + low) / n
        found.error = float(np.abs(full[:there, :there] - np.outer(full[-1, :there], full[-1, :there]) - np.eye(there)).max())
    return found


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = 4) -> DataFrame:
    """RESULT: for each row of vectors (id, x: array of longs) its k whitened components, fitted on the different vectors."""
    found = fit(stored(vectors.select("x").distinct(), "different"), k)
    if found is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    project = found.project()
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column(1), found.width)
            own, times = np.repeat(np.arange(len(x)), k), len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), times)), pa.array(np.full(len(own), found.n)), pa.array(found.deviation(x), pa.int64()).take(pa.array(own)),
                 pa.array(project(x).ravel(), from_pandas=True), pa.array(found.explained * times, pa.float64()), pa.array([found.error] * len(own), pa.float64())],
                [part.split()[0] for part in RESULT.split(", ")],
            )

    return mapped(vectors.select("id", "x"), run, RESULT)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding."""
    return whiten(whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256), 4)
