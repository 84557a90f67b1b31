"""Whitening of embeddings: eigenvectors in float32, refined by matrix products in higher precision.

Entries are taken as integers, x = floor(scale * c) + shift, so counts and sums are exact. Three passes over the
vectors, each a sum of one small matrix per task: count and sums, the covariance (centred before multiplying), and the
covariance of what whitening gives. Only d x d matrices meet in the driver, d being the vectors' dimension.

The driver takes the float32 eigenvectors of the covariance and refines them as Ogita and Aishima do: with
R = I - X'X and S = X'VX, every eigenvalue is s_i / (1 - r_i), the correction E has (s_ij + l_j r_ij) / (l_j - l_i) off
the diagonal and X becomes X + XE; errors square at each step. Products are in extended precision. Eigenvalues that lie
closer than the current error can't be told apart by that quotient: there E only makes X orthogonal (r_ij / 2), and the
vectors of such a cluster are turned by a small eigenproblem of their own, X_k'(V - mu I)X_k, whose shift by the
cluster's mean makes the differences between its eigenvalues large against rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
_MOST = 2.0**52  # beyond this a double holds no fraction, so floor(scale * c) would mean nothing
_WIDE = np.longdouble


def refine(v: np.ndarray, x: np.ndarray, steps: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and eigenvectors of a symmetric matrix from approximate ones, in extended precision."""
    v, x = v.astype(_WIDE), x.astype(_WIDE)
    d, norm = len(v), float(np.abs(v).sum(1).max(initial=0))
    if norm == 0:
        return np.zeros(d, _WIDE), np.eye(d, dtype=_WIDE)
    least = d * float(np.finfo(_WIDE).eps)
    before = np.inf
    for _ in range(steps):
        x, r, s, values, error = _state(v, x, norm, least)
        turned = False
        for a, b in _clusters(values, error):
            small = s[a:b, a:b] - values[a:b].mean() * (np.eye(b - a) - r[a:b, a:b])
            if np.abs(small - np.diag(np.diag(small))).max() > least * norm:
                x[:, a:b] = x[:, a:b] @ np.linalg.eigh(((small + small.T) / 2).astype(float))[1][:, ::-1].astype(_WIDE)
                turned = True
        if turned:
            x, r, s, values, error = _state(v, x, norm, least)
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= error
        e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        now = float(np.abs(e).max())
        if now <= least or now >= before and now < 1e-16:
            break
        before = now
    for _ in range(4):  # rounding over the smallest gaps leaves some of R, which these steps square
        x, r, _, values, _ = _state(v, x, norm, least)
        if np.abs(r).max() <= least:
            break
        x = x + x @ (r / 2)
    return values, x


def _state(v: np.ndarray, x: np.ndarray, norm: float, least: float):
    """The vectors by falling eigenvalue, I - X'X, X'VX, the eigenvalues and a bound of their error."""
    gram, s = x.T @ x, x.T @ v @ x
    s = (s + s.T) / 2  # only then do e_ij and e_ji add up to r_ij, which keeps the vectors orthogonal
    values = np.diag(s) / np.diag(gram)
    order = np.argsort(-values, kind="stable")
    x, gram, s, values = x[:, order], gram[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
    r = np.eye(len(v), dtype=_WIDE) - gram
    off = np.linalg.norm((s - np.diag(values)).astype(float), 2)
    return x, r, s, values, max(2 * (off + norm * np.linalg.norm(r.astype(float), 2)), norm * least)


def _clusters(values: np.ndarray, error: float) -> Iterator[tuple[int, int]]:
    """Ranges of falling eigenvalues that follow each other within the error."""
    cuts = [0, *(np.flatnonzero(values[:-1] - values[1:] > error) + 1).tolist(), len(values)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1)


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors of a symmetric matrix, to double precision, from float32 ones."""
    size = np.abs(v).max() if v.size else 0
    start = np.linalg.eigh((v / (size or 1)).astype(np.float32))[1]
    values, x = refine(v, start[:, ::-1].astype(float))
    x = x / np.sqrt((x * x).sum(0))
    return values.astype(float), x.astype(float)


@dataclass
class Whitening:
    """What the fit list gives: n, sums per dimension, the components and their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], float) + np.array([s % self.n / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        """Components over the root of their eigenvalue; zero where the eigenvalue is rounding alone."""
        live = self.values > max(self.trace, 0) * 1e-13
        return self.vectors * np.where(live, 1 / np.sqrt(np.where(live, self.values, 1)), 0.0)


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null, not empty and holds only finite entries that the integers can hold."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE > _MOST))
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad)


def _entries(column: pa.Array, dim: int) -> np.ndarray:
    """The integers of a column of vectors, one row each."""
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dim) + SHIFT


def _batches(batches: Iterator[pa.RecordBatch], column: str, dim: int, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, _entries(part.column(part.schema.get_field_index(column)), dim)


def _sums(vectors: DataFrame, column: str, dim: int) -> tuple[int, list[int]]:
    """Count and exact sums per dimension."""

    def run(batches):
        n, total = 0, [0] * dim
        for _, x in _batches(batches, column, dim):
            n += len(x)
            # halves of 26 bits: no sum of a batch leaves 64 bits
            high, low = x >> 26, x & ((1 << 26) - 1)
            total = [t + (int(h) << 26) + int(k) for t, h, k in zip(total, high.sum(0), low.sum(0), strict=True)]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, dim), pa.int32()), "total": pa.array([str(t) for t in [n, *total]])})

    parts = vectors.select(column).mapInArrow(run, "at int, total string")
    rows = dict(parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect())  # dim + 1 rows
    return int(rows.get(-1, 0)), [int(rows.get(k, 0)) for k in range(dim)]


def _scatter(vectors: DataFrame, column: str, dim: int, mean: np.ndarray, projection: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the centred (and projected) vectors: a vector and a matrix."""
    k = dim if projection is None else projection.shape[1]

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _batches(batches, column, dim):
            y = x - mean
            if projection is not None:
                y = y @ projection
            first += y.sum(0)
            second += y.T @ y
        total = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "total": pa.array(total)})

    parts = vectors.select(column).mapInArrow(run, "at int, total double")
    total = np.zeros(k + k * k)
    for at, value in parts.groupBy("at").agg(F.sum("total")).collect():  # k + k * k rows
        total[at] = value
    return total[:k], total[k:].reshape(k, k)


def dimension(vectors: DataFrame, column: str) -> int:
    """The commonest length of vector (ties: the longest); 0 without vectors."""
    counts = vectors.groupBy(F.size(column).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).head(1)
    return counts[0]["dim"] if counts else 0


def fit(vectors: DataFrame, column: str, dim: int, components: int | None = None) -> Whitening:
    """The whitening of usable vectors of one dimension."""
    n, sums = _sums(vectors, column, dim)
    whole = Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    if not n:
        return whole
    first, second = _scatter(vectors, column, dim, whole.mean)
    covariance = second / n - np.outer(first / n, first / n)  # first is what the mean's rounding leaves
    covariance = (covariance + covariance.T) / 2
    values, x = eigen(covariance)
    k = min(components or dim, dim)
    return Whitening(n, sums, values[:k], x[:, :k], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, column: str, dim: int, w: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components that have variance."""
    projection = w.projection
    live = np.flatnonzero(np.abs(projection).max(0) > 0) if projection.size else []
    if not len(live):
        return 0.0
    first, second = _scatter(vectors, column, dim, w.mean, projection[:, live])
    return float(np.abs(second / w.n - np.outer(first / w.n, first / w.n) - np.eye(len(live))).max())


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n * x - sum)^2; None where it doesn't fit a long."""
    near = [s // n for s in sums]  # n * x - s = n * (x - near) - rest, which is small
    rest = np.array([s - n * k for s, k in zip(sums, near, strict=True)], object)
    off = x - np.array(near, np.int64)
    if n * (int(np.abs(off).max(initial=0)) + 1) < 2**31 // max(1, int(len(sums) ** 0.5) + 1):
        part = n * off - rest.astype(np.int64)
        return (part * part).sum(1).tolist()
    part = n * off.astype(object) - rest
    return [t if t < 2**63 else None for t in (part * part).sum(1).tolist()]


def whiten(df: DataFrame, column: str = "embedding", components: int = 8) -> DataFrame:
    """df's usable rows with n, deviation, whitened (array<double>), explained (array<double>) and identity_error.

    Rows whose vector is null, empty or holds a null, NaN or infinite entry (or one beyond 2^52 / 1024 in magnitude, which
    the integers can't hold) go; so do vectors of another length than the commonest (ties: the longest), as they have no
    covariance with the rest. Repeated rows count each. With fewer dimensions than `components` there are as many components
    as dimensions. A component whose eigenvalue is rounding alone (below 1e-13 of the trace), as when all vectors agree, has
    whitened null and is left out of identity_error; explained is null where the trace is 0. deviation is null where it
    doesn't fit a long. An empty table gives no rows. Columns named like the results are replaced. No key groups rows, so
    none can be hot: every pass sums within tasks first.
    """
    made = ["n", "deviation", "whitened", "explained", "identity_error"]
    df = usable(df.drop(*made), column)
    dim = dimension(df, column)
    vectors = df.where(F.size(column) == dim)
    w = fit(vectors, column, dim, components)
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    error = identity_error(vectors, column, dim, w)
    k = len(w.values)
    mean, projection = (w.mean, w.projection) if w.n else (np.zeros(dim), np.zeros((dim, 0)))
    explained = [float(e) / w.trace if w.trace > 0 else None for e in w.values]
    dead = np.abs(projection).max(0) == 0 if projection.size else np.zeros(k, bool)

    def run(batches):
        for batch, x in _batches(batches, column, dim):
            y = (x - mean) @ projection
            values = pa.array(y.ravel(), mask=np.tile(dead, len(y)))
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * k)
            shares = pa.array([explained] * len(y), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(y), w.n)), pa.array(_deviation(x, w.n, w.sums), pa.int64()), pa.ListArray.from_arrays(ends, values), shares, pa.array(np.full(len(y), error))],
                [*batch.schema.names, *made],
            )

    return vectors.mapInArrow(run, fields)


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    rows = whitened.select("vec_id", "n", "deviation", "identity_error", pairs)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error")


def query(spark, sf_dir: str) -> DataFrame:
    return by_component(whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))
