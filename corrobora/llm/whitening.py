"""Whitening of vectors by an incremental eigendecomposition.

* Each partition keeps the spectrum of its own scatter matrix.  A vector changes the scatter
  by one centred rank-one term, so the new eigenvalues are the roots of the secular equation
  ``1 + rho * sum(z_i^2 / (d_i - t)) = 0``; entries with a vanishing z_i or equal d_i are
  deflated first.
* Spectra of partitions are combined in a tree of tasks, each by successive rank-one updates
  with the other's eigenvectors, and one more for the distance of the means.
* A last pass over all vectors forms the covariance in the combined basis (Rayleigh-Ritz),
  whose small eigenproblem removes the rounding of all updates.

Integers: a vector's entries become ``floor(scale * c) + shift``; sums and deviations are
exact.  Whatever passes the driver is a square of the vectors' length.

Defined results: vectors that are null or hold null or non-finite entries, entries beyond
2^50, or another number of entries than most (ties: the longer) take no part; repeated rows
count each; directions without variance (below 1e-11 of the largest) are no component; a
deviation that no long holds is null; an empty table, or one without variance, gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corrobora.llm.storage import stored

EPS = np.finfo(float).eps
LARGEST = float(1 << 50)


@dataclass(frozen=True)
class WhitenSpec:
    """Integer grid of the entries, components returned, states that one task combines."""

    scale: int = 1_024
    shift: int = 100_000
    components: int = 8
    fan: int = 16


@np.errstate(divide="ignore", invalid="ignore")
def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(origin, offset, gaps): roots ``origin + offset`` between rising poles d, and ``gaps[j, i] = d_j - root_i``.

    Each root is kept as the offset from its nearer pole.  The sums over the poles on each
    side are replaced by one pole each with the same value and slope; steps that leave the
    bracket are halved.
    """
    k, w = len(d), rho * z * z
    if k == 1:
        return d, w, -w[None, :]
    gap = np.append(np.diff(d), w.sum())
    middle = d + gap / 2
    rises = 1 + (w[:, None] / (d[:, None] - middle[None, :])).sum(axis=0)
    near = rises >= 0
    near[-1] = True
    origin = np.where(near, d, np.append(d[1:], d[-1]))
    low = np.where(near, 0.0, -gap / 2)
    high = np.where(near, gap / 2, 0.0)
    high[-1] = gap[-1] * (1 + 4 * EPS)
    x = np.where(near, high, low)
    apart = d[:, None] - origin[None, :]
    below_w = np.tri(k).T * w[:, None]
    above_w = w[:, None] - below_w
    rows, inner = np.arange(k), np.arange(k - 1)
    for _ in range(60):
        den = apart - x
        pole = 1 / den
        below, above = np.einsum("ji,ji->i", below_w, pole), np.einsum("ji,ji->i", above_w, pole)
        pole *= pole
        below_slope, above_slope = np.einsum("ji,ji->i", below_w, pole), np.einsum("ji,ji->i", above_w, pole)
        value = 1 + below + above
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        here, there = den[rows, rows], np.append(den[inner + 1, inner], 1.0)
        a = below_slope * here * here
        c = 1 + below - below_slope * here
        step = np.empty(k)
        step[-1] = here[-1] + a[-1] / c[-1]
        here, there, a, c = here[:-1], there[:-1], a[:-1], (c + above)[:-1] - (above_slope[:-1] * there[:-1])
        b = above_slope[:-1] * there * there
        p, f = c * (here + there) + a + b, value[:-1] * here * there
        root = np.sqrt(np.abs(p * p - 4 * c * f))
        step[:-1] = np.where(p <= 0, (p - root) / (2 * c), 2 * f / (p + root))
        new = x + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        flat = np.abs(value) <= k * EPS * (1 + above - below)
        done = (flat | (np.abs(new - x) <= 1e-8 * np.abs(new))).all()     # steps shrink quadratically
        x = np.where(flat, x, new)
        if done:
            break
    return origin, x, apart - x


def rank_one(d: np.ndarray, U: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors of ``U diag(d) U' + rho v v'``, rho above 0."""
    z = U.T @ v
    size = float(np.sqrt(z @ z))
    least = 8 * EPS * max(abs(d[0]), abs(d[-1]), rho * size * size)
    live = rho * size * np.abs(z) > least
    at = np.flatnonzero(live)
    if not len(at):
        return d, U
    close = d[at[1:]] - d[at[:-1]] <= least
    if close.any():
        U = U.copy()
        for i, j in zip(at[:-1][close], at[1:][close]):    # turn the equal pair so that one entry of z vanishes
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            U[:, i], U[:, j] = c * U[:, i] - s * U[:, j], s * U[:, i] + c * U[:, j]
            z[i], z[j], live[i] = 0.0, r, False
        at = np.flatnonzero(live)
    poles, zs = d[at], z[at]
    origin, x, gaps = secular_roots(poles, zs, rho)
    # entries of z for which these roots are exact: their eigenvectors are orthogonal
    between = poles[None, :] - poles[:, None]
    np.fill_diagonal(between, 1.0)
    exact = np.sqrt(np.abs(np.prod(-gaps / between, axis=1))) * np.where(zs < 0, -1.0, 1.0)
    Q = exact[:, None] / gaps
    Q /= np.sqrt((Q * Q).sum(axis=0))
    out, V = d.copy(), U.copy()
    out[at], V[:, at] = origin + x, U[:, at] @ Q
    order = np.argsort(out, kind="stable")
    return out[order], V[:, order]


class Spectrum:
    """Number, exact sums, mean and eigendecomposition of the scatter of some vectors."""

    def __init__(self, dims: int):
        self.n, self.sums = 0, [0] * dims
        self.mean, self.d, self.U = np.zeros(dims), np.zeros(dims), np.eye(dims)

    def add(self, x: np.ndarray) -> None:
        """Take in the rows of an integer matrix, one rank-one update each."""
        high, low = (x >> 26).sum(axis=0).tolist(), (x & (1 << 26) - 1).sum(axis=0).tolist()
        self.sums = [s + (h << 26) + m for s, h, m in zip(self.sums, high, low)]
        for row in x.astype(float):
            away = row - self.mean
            if self.n and away.any():
                self.d, self.U = rank_one(self.d, self.U, away, self.n / (self.n + 1))
            self.n += 1
            self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """Take in the vectors of another spectrum."""
        both = self.n + other.n
        if not other.n:
            return
        for value, vector in zip(other.d, other.U.T):
            if value > 0:
                self.d, self.U = rank_one(self.d, self.U, vector, value)
        away = other.mean - self.mean
        if self.n and away.any():
            self.d, self.U = rank_one(self.d, self.U, away, self.n * other.n / both)
        self.mean = (self.n * self.mean + other.n * other.mean) / both
        self.n, self.sums = both, [a + b for a, b in zip(self.sums, other.sums)]


class Sums:
    """A matrix that is added up."""

    def __init__(self, total: np.ndarray):
        self.total = total

    def merge(self, other: Sums) -> None:
        self.total = self.total + other.total


def grid(column: pa.Array, dims: int, spec: WhitenSpec) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integer matrix) of the vectors that take part."""
    column = column.cast(pa.list_(pa.float64()))
    starts = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((np.diff(starts) == dims) & column.is_valid().to_numpy(zero_copy_only=False))
    c = values[starts[rows][:, None] + np.arange(dims)]
    fine = (np.isfinite(c) & (np.abs(c) * spec.scale < LARGEST)).all(axis=1)
    return rows[fine], np.floor(spec.scale * c[fine]).astype(np.int64) + spec.shift


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact ``n * x - sums``: longs, or Python integers where longs are too short."""
    if n * (1 << 51) < 1 << 62 or n * int(np.abs(x).max(initial=0)) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _folded(states: DataFrame, fan: int) -> object:
    """All states of ``states(part, state)`` merged, in a tree of tasks and in order of part; None without any."""

    def task(batch: pa.Table) -> pa.Table:
        rows = sorted(zip(batch.column("part").to_pylist(), batch.column("state").to_pylist()))
        total = pickle.loads(rows[0][1])
        for _, state in rows[1:]:
            total.merge(pickle.loads(state))
        return pa.table({"part": pa.array([rows[0][0] // fan], pa.int64()), "state": pa.array([pickle.dumps(total)], pa.binary())})

    states = stored(states)
    most = states.agg(F.max("part")).first()[0]
    while most:
        states = stored(states.groupBy(F.expr(f"part div {fan}").alias("group")).applyInArrow(task, "part long, state binary"))
        most //= fan
    row = states.first()
    return None if row is None else pickle.loads(row["state"])


def _per_partition(vectors: DataFrame, spec: WhitenSpec, dims: int, start: Callable[[], object], step: Callable) -> DataFrame:
    """(part, state): a state for each partition of ``vectors(embedding)``, ``step(state, rows)`` for each of its batches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = start(), False
        for batch in batches:
            _, x = grid(batch.column("embedding"), dims, spec)
            if len(x):
                step(state, x)
                some = True
        if some:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "state"])

    return vectors.mapInArrow(task, "part long, state binary")


@dataclass
class Model:
    """Exact sums, components as columns by falling eigenvalue, and how white the result is."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exact deviations from the mean, times n; whitened rows)."""
        far = _scaled(x, self.n, self.sums)
        return far, far.astype(float) / self.n @ self.components / np.sqrt(self.values)


def dimensions(vectors: DataFrame) -> int:
    """Commonest number of entries of whole vectors; ties go to the longer."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    row = (vectors.where(F.col("embedding").isNotNull() & whole).groupBy(F.size("embedding").alias("dims")).count()
           .orderBy(F.desc("count"), F.desc("dims")).first())
    return row["dims"] if row else 0


def fit(vectors: DataFrame, spec: WhitenSpec = WhitenSpec()) -> Model | None:
    """Whitening of ``vectors(embedding)``; None where nothing varies."""
    vectors = vectors.select("embedding")
    dims = dimensions(vectors)
    spectrum = _folded(_per_partition(vectors, spec, dims, lambda: Spectrum(dims), Spectrum.add), spec.fan) if dims else None
    if spectrum is None:
        return None
    n, sums = spectrum.n, spectrum.sums
    basis, _ = np.linalg.qr(spectrum.U)

    def project(state: Sums, x: np.ndarray) -> None:
        y = _scaled(x, n, sums).astype(float) / n @ basis
        state.total = state.total + y.T @ y

    gram = _folded(_per_partition(vectors, spec, dims, lambda: Sums(np.zeros((dims, dims))), project), spec.fan).total / n
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    top = np.arange(dims)[::-1][:spec.components]
    top = top[values[top] > max(1e-11 * values[-1], 0.0)]
    if not len(top):
        return None
    model = Model(n, sums, values[top], basis @ turn[:, top], float(np.trace(gram)))

    def spread(state: Sums, x: np.ndarray) -> None:
        y = np.concatenate([model.whitened(x)[1], np.ones((len(x), 1))], axis=1)
        state.total = state.total + y.T @ y

    size = len(top)
    moments = _folded(_per_partition(vectors, spec, dims, lambda: Sums(np.zeros((size + 1, size + 1))), spread), spec.fan).total / n
    covariance = moments[:size, :size] - np.outer(moments[:size, size], moments[:size, size])
    model.identity_error = float(np.abs(covariance - np.eye(size)).max())
    return model


def whiten(embeddings: DataFrame, spec: WhitenSpec = WhitenSpec()) -> DataFrame:
    """One row per vector of ``embeddings(vec_id, embedding)`` and component, numbered from 1."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(embeddings, spec)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    dims, size = len(model.sums), len(model.values)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = grid(batch.column("embedding"), dims, spec)
            far, white = model.whitened(x)
            if far.dtype == object or np.abs(far.astype(float)).max(initial=0) >= (1 << 31) / dims ** 0.5:
                exact = [sum(e * e for e in r) for r in far.tolist()]
            else:
                exact = (far * far).sum(axis=1).tolist()
            exact = [e if e < 1 << 63 else None for e in exact]
            n = len(rows) * size
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(rows, size))), pa.array(np.tile(np.arange(1, size + 1), len(rows)), pa.int32()),
                 pa.array(np.full(n, model.n), pa.int64()), pa.array(exact, pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), size))),
                 pa.array(white.ravel()), pa.array(np.tile(model.values / model.trace, len(rows))), pa.array(np.full(n, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return embeddings.select("vec_id", "embedding").mapInArrow(task, schema)
