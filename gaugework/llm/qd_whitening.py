"""Whitening of embeddings: blockwise QR, Householder bidiagonalisation, dqds and twisted factorisations.

1. Vectors become whole numbers (``vectors.py``); their sums per dimension are exact, and so are the numbers n * x - S. A
   constant added to every component, such as 1,000,000, cancels in these numbers and in all that follows from them.
2. Each task folds its centred rows, block after block, into a triangle R by QR of (R over the block). Triangles are folded
   in groups of at most ``FAN_IN`` until one is left, so no task and not the driver meets more than that many.
3. On the driver, R (dimensions squared, whatever the number of rows) is brought to bidiagonal form by Householder
   reflections; dqds gives its singular values to high relative accuracy; the twisted factorisation of B'B - s^2 gives
   each right singular vector. The covariance itself is never formed, so its condition is not squared.
4. One pass projects the rows; the covariance of what came out is folded the same way, centred and merged pairwise.

Defined cases: a null vector, or one with a null or non-finite entry, is left out, and so is one whose number of components
is not the commonest (ties: the larger); repeated ids are rows of their own; other columns are not read. Directions
without spread, up to rounding, have no whitened value: a component is given for each of the others, so vectors that
are all equal, a single one and an empty table give no rows. Equal eigenvalues get some orthonormal basis of their
space. A deviation that doesn't fit into 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import table
from gaugework.llm.registry import query
from gaugework.llm.vectors import commonest_length, quantised, rows_of
from gaugework.session import materialise

COMPONENTS = 32
FAN_IN, FOLD_BYTES = 64, 256 << 20
# A triangle of so many dimensions squared goes through the driver.
MAX_DIMS = 4096
BLOCK_VALUES = 1 << 20
EPS = np.finfo(float).eps

WHITENED = "vec_id long, component int, deviation long, whitened double"


# ---- folding states of tasks ---------------------------------------------------

def folded(rows: DataFrame, start: Callable[[Iterator[pa.RecordBatch]], bytes | None],
           merge: Callable[[bytes, bytes], bytes], state_bytes: int, fan_in: int = FAN_IN) -> bytes | None:
    """One state of all rows: each task's by ``start``, then merged in groups, level by level."""
    fan_in = max(2, min(fan_in, FOLD_BYTES // state_bytes))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start(batches)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], names=["state"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for state in batch.column(0).to_pylist():
                whole = state if whole is None else merge(whole, state)
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["state"])

    states = materialise(rows.mapInArrow(first, "state binary"), "states")
    while (n := states.count()) > fan_in:
        states = materialise(states.repartition(-(-n // fan_in)).mapInArrow(together, "state binary"), "states")
    whole = None
    for row in states.collect():
        whole = row.state if whole is None else merge(whole, row.state)
    return whole


def column_sums(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Rows and exact sums per dimension, as whole numbers of any size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            if batch.num_rows:
                rows = rows_of(batch.column(0), dims)
                n += len(rows)
                sums = [a + int(b) for a, b in zip(sums, exact_sums(rows))]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([str(s) for s in sums]), pa.array([n] * dims, pa.int64())],
                names=["dim", "total", "n"])

    found = (vectors.select("vector").mapInArrow(add, "dim int, total string, n long")
             .groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
             .orderBy("dim").collect())
    return (found[0].n, np.array([int(r.total) for r in found], object)) if found else (0, np.zeros(dims, object))


def exact_sums(rows: np.ndarray) -> np.ndarray:
    """Column sums of 64-bit whole numbers below 2^52: high and low halves can't overflow for 2^31 rows."""
    return (rows >> 26).sum(axis=0).astype(object) * 2 ** 26 + (rows & (2 ** 26 - 1)).sum(axis=0).astype(object)


def centred(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n as doubles: the whole part of the mean is taken off exactly, then the rest of it."""
    whole = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([(int(s) % n) / n for s in sums])
    return (rows - whole).astype(float) - rest


def triangle(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    dims = len(sums)
    block = max(2 * dims, BLOCK_VALUES // dims)

    def below(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        new = np.linalg.qr(np.concatenate([r, rows]), mode="r")
        return np.concatenate([new, np.zeros((dims - len(new), dims))])

    def reduce(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        r, seen = np.zeros((dims, dims)), False
        for batch in batches:
            rows = centred(rows_of(batch.column(0), dims), n, sums)
            seen |= len(rows) > 0
            for at in range(0, len(rows), block):
                r = below(r, rows[at:at + block])
        return r.astype("<f8").tobytes() if seen else None

    def merge(a: bytes, b: bytes) -> bytes:
        one, two = (np.frombuffer(x, "<f8").reshape(dims, dims) for x in (a, b))
        return below(one, two).astype("<f8").tobytes()

    return np.frombuffer(folded(vectors.select("vector"), reduce, merge, 8 * dims * dims), "<f8").reshape(dims, dims)


# ---- singular values and vectors of R ------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and P, with R = Q B P' and Q, P orthogonal."""
    a, d = r.copy(), r.shape[1]
    p = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """v with (1 - 2 v v' / v'v) x along the first axis; None where x is there already."""
        scale = np.abs(x).max()
        if not scale or not np.abs(x[1:]).max(initial=0.0):
            return None
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        if (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < d and (v := reflector(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            p[:, k + 1:] -= 2 * np.outer(p[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of a bidiagonal matrix from its squared diagonal and superdiagonal, descending.

    Fernando and Parlett's differential qd with shifts. A pass without shift gives 1 / (sum of 1 / d), a lower bound of
    the smallest value left; the shifted pass can then only fail by rounding, and is repeated with a smaller shift.
    """
    found: list[float] = []
    blocks = [(list(q), list(e), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while q:
            if len(q) == 1:
                found.append(max(q.pop() + moved, 0.0))
                continue
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * (q[k] + q[k + 1] + moved)), None)
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            d, inverse = q[0], 0.0
            for k in range(len(e)):
                if d <= 0:
                    break
                inverse += 1 / d
                d *= q[k + 1] / (d + e[k])
            shift = 0.0 if d <= 0 else (1 - 8 * EPS * len(q)) / (inverse + 1 / d)
            while (new := qd_pass(q, e, shift)) is None:
                shift = shift / 2 if shift > EPS * EPS * max(q) else 0.0
            (q, e), moved = new, moved + shift
    return sorted(found, reverse=True)


def qd_pass(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential pass; None if the shift was larger than the smallest value."""
    new_q, new_e, d = [], [], q[0] - shift
    for k in range(len(e)):
        if d < 0 or d == 0 and shift > 0:
            return None
        top = d + e[k]
        ratio = q[k + 1] / top if top else 1.0
        new_q.append(top)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return [*new_q, d], new_e


def twisted(q: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """The vector of ``value`` of L D L' (D: ``q``, L: unit lower bidiagonal ``low``), from the twist with least remainder.

    Parlett and Dhillon: the stationary transform from the top and the progressive one from the bottom meet at a row r
    where the rest is smallest; from there the vector follows by products alone.
    """
    n, tiny = len(q), np.finfo(float).tiny / EPS
    s, p = np.empty(n), np.empty(n)
    up, down = np.empty(n - 1), np.empty(n - 1)
    s[0], p[n - 1] = -value, q[n - 1] - value
    for i in range(n - 1):
        top = s[i] + q[i] or tiny
        up[i] = q[i] * low[i] / top
        s[i + 1] = up[i] * low[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        top = q[i] * low[i] ** 2 + p[i + 1] or tiny
        ratio = q[i] / top
        down[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    rest = np.abs(s + p + value)
    r = int(np.where(np.isnan(rest), np.inf, rest).argmin())
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def close_vectors(t: np.ndarray, values: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal vectors for values too close for single ones: inverse iteration on all of them, then rotations.

    The rotations are Jacobi's, on the matrix in the small space found.
    """
    width, scale = len(values), np.abs(t).max() or 1.0
    shifted = t - (values.mean() + 4 * EPS * scale) * np.eye(len(t))
    x = basis + np.random.default_rng(1).standard_normal(basis.shape) * 1e-3
    for _ in range(4):
        x = np.linalg.qr(np.linalg.solve(shifted, np.linalg.qr(x)[0]))[0]
    small, turn = x.T @ t @ x, np.eye(width)
    for _ in range(30):
        rest = np.abs(np.triu(small, 1)).max(initial=0.0)
        if rest <= EPS * EPS * scale:
            break
        for i in range(width):
            for j in range(i + 1, width):
                angle = 0.5 * np.arctan2(2 * small[i, j], small[j, j] - small[i, i])
                c, s = np.cos(angle), np.sin(angle)
                g = np.eye(width)
                g[i, i], g[j, j], g[i, j], g[j, i] = c, c, s, -s
                small, turn = g.T @ small @ g, turn @ g
    return (x @ turn)[:, np.argsort(-np.diag(small), kind="stable")]


def right_vectors(a: np.ndarray, b: np.ndarray, wanted: int, gap: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest squared singular values of the bidiagonal (a, b) and their right singular vectors.

    Where the superdiagonal is negligible the matrix falls into parts, each with its own values and vectors. Values that
    are nearer than ``gap``, relative to themselves, are treated together.
    """
    d, scale = len(a), max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    if not scale:
        return np.zeros(wanted), np.eye(d)[:, :wanted]
    a, b = a / scale, b / scale
    a = np.where(np.abs(a) < EPS / d, EPS / d, a)  # below what the reduction has rounded away
    splits = [0, *(np.flatnonzero(np.abs(b) <= EPS * EPS) + 1).tolist(), d]
    values, vectors = [], []
    for start, end in zip(splits, splits[1:]):
        main, side = a[start:end], b[start:end - 1]
        q, low = main ** 2, side / main[:-1]
        own = dqds(q.tolist(), (side ** 2).tolist())
        at = 0
        while at < len(own):
            to = at + 1
            while to < len(own) and own[to - 1] - own[to] <= gap * own[at]:
                to += 1
            z = np.stack([twisted(q, low, v) for v in own[at:to]], axis=1)
            if to > at + 1:
                t = np.diag(q + np.concatenate([[0.0], side ** 2])) + np.diag(main[:-1] * side, 1) + np.diag(main[:-1] * side, -1)
                z = close_vectors(t, np.array(own[at:to]), z)
            for k in range(at, to):
                values.append(own[k])
                vectors.append(np.concatenate([np.zeros(start), z[:, k - at], np.zeros(d - end)]))
            at = to
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    return np.array(values)[order] * scale ** 2, np.array(vectors)[order].T


# ---- the fitted model ------------------------------------------------------------

@dataclass
class Whitening:
    """``directions`` has a unit eigenvector a column, ``variances`` their eigenvalues; ``trace`` is that of V."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    trace: float

    def of(self, rows: np.ndarray) -> np.ndarray:
        return centred(rows, self.n, self.sums) @ self.directions / np.sqrt(self.variances)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2 of each row, exactly; None where it takes more than 64 bits."""
        largest = self.n * max(int(np.abs(rows).max()), 1) + max(abs(int(s)) for s in self.sums)
        if len(self.sums) * largest ** 2 < 2 ** 63:
            return ((self.n * rows - self.sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * rows.astype(object) - self.sums) ** 2).sum(axis=1)
        return [int(v) if v < 2 ** 63 else None for v in exact]


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Directions of what ``quantised`` gave; None without rows or without any spread."""
    if dims > MAX_DIMS:
        raise ValueError(f"{dims} dimensions are more than {MAX_DIMS}")
    n, sums = column_sums(vectors, dims)
    if not n:
        return None
    r = triangle(vectors, n, sums)
    a, b, p = bidiagonal(r)
    values, z = right_vectors(a, b, min(components, dims))
    spread = np.sqrt(values) > dims * EPS * np.linalg.norm(r)
    if not spread.any():
        return None
    return Whitening(n, sums, p @ z[:, spread], values[spread] / n, float((r ** 2).sum()) / n)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    dims, k = model.directions.shape

    def state(n: int, mean: np.ndarray, spread: np.ndarray) -> bytes:
        return np.concatenate([[n], mean, spread.ravel()]).astype("<f8").tobytes()

    def parts(raw: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        v = np.frombuffer(raw, "<f8")
        return v[0], v[1:k + 1], v[k + 1:].reshape(k, k)

    def merge(one: bytes, two: bytes) -> bytes:
        (n, a, s), (m, b, t) = parts(one), parts(two)
        gap = b - a
        return state(n + m, a + gap * (m / (n + m)), s + t + np.outer(gap, gap) * (n * m / (n + m)))

    def reduce(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        whole = None
        for batch in batches:
            if batch.num_rows:
                rows = model.of(rows_of(batch.column(0), dims))
                mean = rows.mean(axis=0)
                own = state(len(rows), mean, (rows - mean).T @ (rows - mean))
                whole = own if whole is None else merge(whole, own)
        return whole

    n, _, spread = parts(folded(vectors.select("vector"), reduce, merge, 8 * k * (k + 1)))
    return float(np.abs(spread / n - np.eye(k)).max())


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector and component."""
    dims, k = model.directions.shape

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = rows_of(part.column(1), dims)
                each = np.repeat(np.arange(len(rows)), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                     pa.array(model.deviations(rows), pa.int64()).take(pa.array(each)), pa.array(model.of(rows).ravel())],
                    names=["vec_id", "component", "deviation", "whitened"])

    return vectors.mapInArrow(project, WHITENED)


def whiten(table: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` per row and component."""
    dims = commonest_length(table, vector_column)
    vectors = quantised(table, max(dims, 1), id_column, vector_column)
    model = fit(vectors, max(dims, 1), components)
    if model is None:
        rows, n, shares, error = vectors.limit(0).mapInArrow(lambda batches: iter(()), WHITENED), 0, [0.0], 0.0
    else:
        rows, n, shares = whitened(vectors, model), model.n, (model.variances / model.trace).tolist()
        error = identity_error(vectors, model)
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("component"))
    return rows.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       explained.alias("explained"), F.lit(error).alias("identity_error"))


@query("op12_qd_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
