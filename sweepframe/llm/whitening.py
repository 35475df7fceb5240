"""Whitening of embeddings: centred covariance, leading components, projection.

Entries become whole numbers, so sums per dimension are exact and rows are centred
before anything is multiplied: first by the whole number nearest to the mean, the rest
of which is taken off exactly at the end. Tasks return one partial sum each, of the size
of the matrix; the matrix itself, dimensions by dimensions, is the only thing that the
driver sees. There it is made tridiagonal by Householder reflections, the leading
eigenvalues are found by bisection with Sturm counts, their vectors by inverse iteration,
those of close eigenvalues made orthogonal to each other again. The components go to the
tasks, which project their rows.

Defined results: rows whose vector is NULL, empty, or holds entries that are NULL, not
finite or too large for a whole number of 62 bits are dropped, as are rows whose length
is not the most frequent one (of equally frequent ones, the shortest); repeated rows and
ids count as often as they come; there are no components without variance, so equal rows,
a single row and empty tables give empty results; ``deviation`` is NULL where it has no
place in 64 bits; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.session import write_table

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Rows worked on at a time.
ROWS = 4096
#: Whole numbers beyond this have no place.
LARGEST = float(1 << 62)
#: Eigenvalues closer than this part of the matrix's norm are a cluster.
CLUSTER = 1e-3
#: Components with less than this part of the whole variance have none.
NONE = 1e-13


# -- rows -----------------------------------------------------------------------------


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the usable vectors as whole numbers, one vector after the other, the
    vectors' lengths, and which of all vectors are usable."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors)
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    entries = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(entries * SCALE)
        bad = bad | ~(np.abs(scaled) < LARGEST)
    total = np.concatenate([[0], np.cumsum(bad)])
    ends = np.cumsum(lengths)
    usable = (lengths > 0) & (total[ends] == total[ends - lengths])
    kept = np.repeat(usable, lengths)
    return scaled[kept].astype(np.int64) + OFFSET, lengths[usable], usable


def _matrices(vectors: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of usable vectors of ``dims`` entries, and their entries, in bounded parts."""
    for at in range(0, len(vectors), ROWS):
        part = vectors.slice(at, ROWS)
        entries, lengths, usable = whole_numbers(part)
        same = lengths == dims
        places = at + np.flatnonzero(usable)[same]
        yield places, entries[np.repeat(same, lengths)].reshape(-1, dims)


@dataclass(frozen=True)
class Fit:
    """What all rows have in common."""

    n: int
    sums: list[int]
    #: Eigenvalues and unit components (a row each) by falling eigenvalue.
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def middle(self) -> np.ndarray:
        """The whole numbers nearest to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def beyond(self) -> np.ndarray:
        """The means less ``middle``, at most a half."""
        return np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.middle)])


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of the fitted vectors and their sums per dimension, of ``rows`` (vec)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in parts:
            for at in range(0, batch.num_rows, ROWS):
                entries, lengths, _ = whole_numbers(batch.column(0).slice(at, ROWS))
                for size in np.unique(lengths):
                    mine = entries[np.repeat(lengths == size, lengths)].reshape(-1, size)
                    # as Python numbers, which do not overflow
                    if np.abs(mine).max() < (1 << 62) // len(mine):
                        sums = mine.sum(0).tolist()
                    else:
                        sums = mine.astype(object).sum(0).tolist()
                    n, old = found.get(int(size), (0, [0] * int(size)))
                    found[int(size)] = n + len(mine), [a + b for a, b in zip(old, sums)]
        for size, (n, sums) in found.items():
            columns = [pa.array([size]), pa.array([n]), pa.array([[str(s) for s in sums]])]
            yield pa.RecordBatch.from_arrays(columns, ["dims", "n", "sums"])

    partial = write_table(rows.mapInArrow(run, "dims long, n long, sums array<string>"), "sums").df
    counts = partial.groupBy("dims").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("n"), "dims").first()
    if most is None:
        return 0, []
    each = partial.where(F.col("dims") == most.dims).select(F.posexplode("sums").alias("i", "s"))
    summed = each.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return most.n, [int(r.s) for r in summed.orderBy("i").collect()]


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor ``n``) of the fitted vectors of ``rows`` (vec)."""
    dims = len(sums)
    fit = Fit(n, sums, np.zeros(0), np.zeros(0), 0.0)
    middle, beyond = fit.middle, fit.beyond
    upper = np.triu_indices(dims)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((dims, dims))
        for batch in parts:
            for _, x in _matrices(batch.column(0), dims):
                centred = (x - middle).astype(np.float64)
                products += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array([products[upper].tolist()])], ["products"])

    # sums of whole numbers below 2 ** 53: the order in which they are added is of no weight
    partial = rows.mapInArrow(run, "products array<double>").select(F.posexplode("products").alias("i", "p"))
    found = partial.groupBy("i").agg(F.sum("p").alias("p")).orderBy("i").collect()
    matrix = np.zeros((dims, dims))
    matrix[upper] = [r.p for r in found]
    matrix = matrix + np.triu(matrix, 1).T
    return matrix / n - np.outer(beyond, beyond)


# -- eigenvectors ---------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflections of a symmetric matrix made tridiagonal."""
    a = matrix.astype(np.float64).copy()
    n = len(a)
    reflections = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        rest = np.linalg.norm(x[1:])
        v = x.copy()
        if rest == 0:
            reflections.append(np.zeros_like(v))
            continue
        v[0] += math.copysign(np.linalg.norm(x), x[0])
        v /= np.linalg.norm(v)
        inner = a[k + 1 :, k + 1 :]
        p = inner @ v
        w = 2 * (p - (v @ p) * v)
        inner -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def above(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie above each value of ``at``."""
    tiny = np.finfo(np.float64).tiny ** 0.5 * (1 + float(np.abs(diagonal).max(initial=0)))
    count = np.zeros(len(at), np.int64)
    q = diagonal[0] - at
    for k in range(len(diagonal)):
        if k:
            q = diagonal[k] - at - off[k - 1] ** 2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q > 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection."""
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return high
        # the j-th largest lies above ``middle`` if more than j do
        more = above(diagonal, off, middle) > np.arange(k)
        low, high = np.where(more, middle, low), np.where(more, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """``(T - shift) x = b`` by elimination with row exchanges."""
    n = len(diagonal)
    # rows hold the pivot and the two entries behind it
    u = np.zeros((n, 3))
    x = b.copy()
    row = np.array([diagonal[0] - shift, off[0] if n > 1 else 0.0, 0.0])
    for k in range(n - 1):
        below = np.array([off[k], diagonal[k + 1] - shift, off[k + 1] if k + 2 < n else 0.0])
        if abs(below[0]) > abs(row[0]):
            row, below = below, row
            x[k], x[k + 1] = x[k + 1], x[k]
        if row[0] == 0:
            row[0] = least
        factor = below[0] / row[0]
        u[k] = row
        x[k + 1] -= factor * x[k]
        row = np.array([below[1] - factor * row[1], below[2] - factor * row[2], 0.0])
    u[n - 1] = row
    for k in range(n - 1, -1, -1):
        pivot = u[k, 0] if abs(u[k, 0]) > least else math.copysign(least, u[k, 0])
        x[k] = (x[k] - u[k, 1:] @ np.append(x[k + 1 : k + 3], np.zeros(2))[:2]) / pivot
    return x


def eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix and a unit vector (row) each."""
    k = min(k, len(matrix))
    norm = float(np.abs(matrix).sum(1).max(initial=0))
    if k == 0 or norm == 0:
        return np.zeros(k), np.eye(len(matrix))[:k]
    diagonal, off, reflections = tridiagonal(matrix / norm)
    # all of the eigenvalues, as a cluster may reach beyond the k-th
    every = leading_values(diagonal, off, len(matrix))
    last = k
    while last < len(every) and every[last - 1] - every[last] < CLUSTER:
        last += 1
    least = np.finfo(np.float64).eps
    rng = np.random.default_rng(7)
    found: list[np.ndarray] = []
    first = 0
    for j in range(last):
        if j and every[j - 1] - every[j] >= CLUSTER:
            first = j
        x = rng.standard_normal(len(matrix))
        for _ in range(6):
            for _ in range(2):  # twice is enough to be orthogonal to rounding
                for other in found[first:]:
                    x = x - (x @ other) * other
            x = x / np.linalg.norm(x)
            # equal eigenvalues are moved apart a little
            x = _solve(diagonal, off, every[j] - least * (j - first), x, least)
            x = x / np.linalg.norm(x)
        for other in found[first:] * 2:
            x = x - (x @ other) * other
        found.append(x / np.linalg.norm(x))
    vectors = np.array(found[:k])
    for j in range(len(reflections) - 1, -1, -1):
        v = reflections[j]
        vectors[:, j + 1 :] -= 2 * np.outer(vectors[:, j + 1 :] @ v, v)
    largest = vectors[np.arange(k), np.abs(vectors).argmax(1)]
    vectors = vectors * np.where(largest < 0, -1, 1)[:, None]
    # the matrix's own quotients are exact to the square of a vector's error
    values = np.einsum("ki,ij,kj->k", vectors, matrix / norm, vectors) * norm
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[order]


# -- tables ---------------------------------------------------------------------------


def fitted(docs: DataFrame, vec_col: str = "embedding", most: int = COMPONENTS) -> Fit | None:
    """Sums, eigenvalues and components of all usable vectors. Runs jobs.

    None if there are no usable vectors or they have no variance.
    """
    rows = docs.select(F.col(vec_col).cast("array<double>").alias("vec"))
    n, sums = totals(rows)
    if n == 0:
        return None
    matrix = covariance(rows, n, sums)
    trace = float(np.trace(matrix))
    values, components = eigen(matrix, most)
    some = values > NONE * trace
    return Fit(n, sums, values[some], components[some], trace) if trace > 0 and some.any() else None


def projected(docs: DataFrame, fit: Fit, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id``, ``deviation`` and the array ``whitened`` per usable row of ``docs``."""
    n, dims, middle, beyond = fit.n, len(fit.sums), fit.middle, fit.beyond
    sums = np.array(fit.sums, object)
    scaled = (fit.components / np.sqrt(fit.values)[:, None]).T

    def deviations(x: np.ndarray) -> list[int | None]:
        centred = np.abs(x - middle).max(initial=0) + 1.0
        if n * centred < 2.0**31 and dims * (n * centred) ** 2 < 2.0**62:
            return ((n * (x - middle) - (sums - n * middle.astype(object)).astype(np.int64)) ** 2).sum(1).tolist()
        exact = [int(((n * row.astype(object) - sums) ** 2).sum()) for row in x]
        return [d if d < 1 << 63 else None for d in exact]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for places, x in _matrices(batch.column("vec"), dims):
                white = ((x - middle) - beyond) @ scaled
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * scaled.shape[1]), pa.array(white.ravel())
                )
                columns = [batch.column("id").take(pa.array(places)), pa.array(deviations(x), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", "deviation", "whitened"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            w = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([pa.array([np.append(w.sum(0), (w.T @ w).ravel()).tolist()])], ["s"])

    each = white.select("whitened").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v"))
    found = np.array([r.v for r in each.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()]) / n
    mean, products = found[:k], found[k:].reshape(k, k)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whitened(
    docs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS
) -> DataFrame:
    """Per usable row of ``docs`` and component, numbered from 1: the projection over the
    square root of the eigenvalue, and figures of the fit. Runs jobs."""
    kind = docs.schema[id_col].dataType.simpleString()
    fit = fitted(docs, vec_col, most)
    if fit is None:
        return docs.sparkSession.createDataFrame(
            [], f"{id_col} {kind}, component int, n long, deviation long, whitened double, "
            "explained double, identity_error double",
        )
    white = write_table(projected(docs, fit, id_col, vec_col), "white").df
    error = identity_error(white, fit.n, len(fit.values))
    explained = F.array(*(F.lit(float(e / fit.trace)) for e in fit.values))
    rows = white.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        F.col("id").alias(id_col),
        (F.col("k") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("k")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
