"""Whitening of embeddings by their leading principal components.

Components are integers x = floor(1024 * c) + 100000. One pass sums them exactly; a second adds up products of
what is left of x when the nearest whole number to its mean is taken away, which is exact in doubles for usual
data, so the covariance doesn't depend on how tasks are cut. Tasks send one matrix each; the matrices are added
in two steps. The driver holds one dims x dims matrix, however many vectors there are:

1. Householder reflections make it tridiagonal,
2. Sturm counts (how many eigenvalues lie below a point) bisect the leading eigenvalues,
3. inverse iteration gives their vectors; vectors of close eigenvalues are made orthogonal to each other at
   each step; the reflections take them back.

The projection, dims x k numbers, goes to the tasks. A last pass measures how far the whitened covariance is from
the identity.

Defined results: a vector that is null or has a null, NaN or infinite component takes no part; shorter vectors count
as if zeros followed; a null id stays null; repeated rows and ids stand each for themselves; components whose
eigenvalue is zero to double precision aren't returned (so a table of equal vectors gives no rows); a deviation
beyond 64 bits is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearby.llm.common import bounded_batches, slices

SCALE, OFFSET = 1024, 100_000
#: Components returned, and the most dimensions (the matrix on the driver has dims * dims doubles).
COMPONENTS, MOST_DIMS = 8, 4096
#: Rows turned to numbers at once, and the most tasks that the first of two additions of matrices is dealt to.
ROWS, MERGERS = 4096, 64
#: Whole numbers beyond this aren't told apart: 2**62.
MOST = 1 << 62
#: Eigenvalues nearer than this share of the norm are one cluster.
CLUSTER = 1e-3
EPS = float(np.finfo(float).eps)


# ---- eigenvalues and vectors of a symmetric matrix -------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and the unit reflection vectors (the k-th acts on places k + 1 and up)."""
    a, n = matrix.copy(), len(matrix)
    mirrors: list[np.ndarray] = []
    off = np.zeros(max(0, n - 1))
    for k in range(n - 1):
        x = a[k + 1 :, k].copy()
        size = float(np.linalg.norm(x))
        if size == 0 or not np.any(x[1:]):
            mirrors.append(np.zeros_like(x))
            off[k] = x[0]
            continue
        alpha = -size if x[0] >= 0 else size
        x[0] -= alpha
        v = x / np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        off[k] = alpha
        mirrors.append(v)
    return np.diag(a).copy(), off, mirrors


def reflected(mirrors: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """A vector of the tridiagonal matrix as one of the matrix."""
    y = y.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        y[k + 1 :] -= 2.0 * (v @ y[k + 1 :]) * v
    return y


def sturm(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eigenvalues below each of the points: negative pivots of the shifted matrix."""
    least = np.finfo(float).tiny / EPS
    q, below = np.ones(len(at)), np.zeros(len(at), np.int64)
    for i, d in enumerate(diagonal):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    slack = 2 * EPS * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high, wanted = low - slack, high + slack, n - np.arange(k)  # the j-th has n - j at or below it, from 0
    for _ in range(200):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        under = sturm(diagonal, off, middle) >= wanted
        low, high = np.where(under, low, middle), np.where(under, middle, high)
    return low + (high - low) / 2


def solver(diagonal: np.ndarray, off: np.ndarray, at: float, tiny: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves the shifted tridiagonal system by elimination with row exchanges; zero pivots become ``tiny``."""
    n = len(diagonal)
    d, up = (diagonal - at).tolist(), off.tolist()
    down, second, factor, swap = off.tolist(), [0.0] * n, [0.0] * n, [False] * n
    for i in range(n - 1):
        if abs(down[i]) > abs(d[i]):
            swap[i] = True
            d[i], down[i] = down[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            if i + 1 < n - 1:
                second[i], up[i + 1] = up[i + 1], 0.0
        if abs(d[i]) < tiny:
            d[i] = tiny
        factor[i] = down[i] / d[i]
        d[i + 1] -= factor[i] * up[i]
        if i + 1 < n - 1:
            up[i + 1] -= factor[i] * second[i]
    if n and abs(d[-1]) < tiny:
        d[-1] = tiny

    def solve(right: np.ndarray) -> np.ndarray:
        x = right.tolist()
        for i in range(n - 1):
            if swap[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            total = x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (second[i] * x[i + 2] if i + 2 < n else 0.0)
            x[i] = total / d[i]
        return np.array(x)

    return solve


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors (columns) of falling eigenvalues of a tridiagonal matrix."""
    n, rng = len(diagonal), np.random.default_rng(20240317)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0))
    out = np.zeros((n, len(values)))
    shift = np.inf
    for j, value in enumerate(values):
        shift = min(value, shift - 2 * EPS * norm)  # equal eigenvalues are told apart by a hair
        near = [i for i in range(j) if values[i] - value <= CLUSTER * norm]
        solve = solver(diagonal, off, shift, EPS * norm)
        x = rng.standard_normal(n)
        for _ in range(5):
            for i in near:
                x -= (out[:, i] @ x) * out[:, i]
            x /= np.linalg.norm(x)
            y = solve(x)
            x = y / np.abs(y).max()
        for _ in range(2):
            for i in near:
                x -= (out[:, i] @ x) * out[:, i]
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues, falling, without those that are zero to double precision, and their unit vectors as columns."""
    n = len(matrix)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((n, 0))
    d, off, mirrors = tridiagonal(matrix / scale)
    values = leading(d, off, min(k, n))
    values = values[values > 8 * n * EPS * max(values[0], 0.0)]
    found = vectors_of(d, off, values)
    whole = [reflected(mirrors, found[:, j]) for j in range(len(values))]
    return values * scale, np.stack([v / np.linalg.norm(v) for v in whole], axis=1) if whole else np.zeros((n, 0))


# ---- passes over the vectors -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """A fitted projection. ``sums`` are exact."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        return centre_of(self.n, self.sums)


def centre_of(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest whole numbers to the means, and what the means have beyond them."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * m) / n for s, m in zip(sums, whole)])


def complete(vectors: DataFrame, vec_col: str) -> DataFrame:
    return vectors.where(F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of x as 64-bit integers; zeros stand for what short vectors lack."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    c = np.zeros((len(sizes), dims))
    c[np.arange(dims) < sizes[:, None]] = flat
    return np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64) + OFFSET


def exact_sum(x: np.ndarray) -> list[int]:
    wide = len(x) and float(np.abs(x).max(initial=0)) * len(x) >= MOST
    return [int(v) for v in (x.astype(object) if wide else x).sum(0)]


def add_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays of ``size`` doubles (one column, binary), in two steps."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), float)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    tasks = min(MERGERS, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = parts.repartition(tasks).mapInArrow(add, "part binary").repartition(1).mapInArrow(add, "part binary").collect()
    return np.frombuffer(bytes(rows[0][0]), float).copy() if rows else np.zeros(size)


def products(rows: DataFrame, width: int, make: Callable[[pa.Array], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows that ``make`` gives (``width`` wide) and of their products with themselves, over all of ``rows`` (one column)."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, seen = np.zeros(width), np.zeros((width, width)), False
        for batch in slices(batches, ROWS):
            d = make(batch.column(0))
            total += d.sum(0)
            square += d.T @ d
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, square.ravel()]).tobytes()], pa.binary())], names=["part"])

    found = add_up(rows.mapInArrow(multiply, "part binary"), width + width * width)
    return found[:width], found[width:].reshape(width, width)


def fit(vectors: DataFrame, k: int = COMPONENTS, vec_col: str = "embedding") -> Whitening:
    """The leading ``k`` components of all vectors that take part."""
    bounded_batches(vectors.sparkSession)
    rows = complete(vectors, vec_col).select(vec_col)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size(vec_col)).alias("dims")).first()
    n, dims = size["n"], size["dims"] or 0
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions; the covariance of at most {MOST_DIMS} is held on the driver")
    if not n or not dims:
        return Whitening(n, [0] * dims, np.zeros(0), np.zeros((dims, 0)), 0.0)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in slices(batches, ROWS):
            total = [a + b for a, b in zip(total, exact_sum(integers(batch.column(0), dims)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["dim", "s"])

    sums = {r["dim"]: int(r["s"]) for r in rows.mapInArrow(sum_up, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    exact = [sums[i] for i in range(dims)]
    whole, beyond = centre_of(n, exact)
    _, square = products(rows, dims, lambda column: (integers(column, dims) - whole).astype(float))
    covariance = square / n - np.outer(beyond, beyond)
    values, components = eigen((covariance + covariance.T) / 2, k)
    return Whitening(n, exact, values, components, float(np.trace(covariance)))


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    whole, beyond = model.centre()
    return ((x - whole).astype(float) - beyond) @ (model.components / np.sqrt(model.values))


def identity_error(vectors: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity."""
    dims, k = model.components.shape
    total, square = products(complete(vectors, vec_col).select(vec_col), k, lambda column: whitened(integers(column, dims), model))
    mean = total / model.n
    return float(np.abs(square / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums over dimensions of (n * x - S) ** 2; null beyond 64 bits."""
    whole, _ = model.centre()
    rest = [s - model.n * int(m) for s, m in zip(model.sums, whole)]
    most = model.n * float(np.abs(x - whole).max(initial=0)) + max(map(abs, rest), default=0)
    kind = np.int64 if most * most * max(1, len(rest)) < MOST else object
    d = model.n * (x - whole).astype(kind) - np.array(rest, kind)
    return [int(s) if s < 1 << 63 else None for s in (d * d).sum(1)]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to ``k`` rows for each vector."""
    model = fit(vectors, k, vec_col)
    dims, found = model.components.shape
    error = identity_error(vectors, model, vec_col) if found else 0.0
    share = model.values / model.trace if found else model.values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            if not found:
                continue
            x = integers(batch.column(1), dims)
            rows, each = len(x), np.repeat(np.arange(len(x)), found)
            columns = [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, found + 1), rows), pa.int32()), pa.array(np.full(rows * found, model.n), pa.int64()),
                pa.array(deviations(x, model), pa.int64()).take(pa.array(each)), pa.array(whitened(x, model).ravel()), pa.array(np.tile(share, rows)), pa.array(np.full(rows * found, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return complete(vectors, vec_col).select(F.col(id_col).cast("long").alias("vec_id"), vec_col).mapInArrow(project, SCHEMA)
