"""Embedding whitening by principal components, to double precision.

The covariance is summed up by Spark over the distinct vectors. Its eigenvectors are first taken in float32, then
corrected by matrix products in higher precision (the iterative refinement of Ogita and Aishima): the products X'X and X'AX
tell how far X is from orthonormal and from diagonal, and the correction that follows converges quadratically.
Eigenvectors whose eigenvalues lie too close together for that are rotated by the solution of their own small problem,
shifted to the cluster's middle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The offset and scale of whole-numbered vectors; entries are held to what doubles count exactly.
OFFSET, SCALE, MOST = 1_000_000, 64, float(1 << 52)
#: Rows multiplied at a time.
BLOCK = 4096
HIGH = np.longdouble


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, x array<long>: floor(64 * c) + 1000000 of every entry c, of the rows whose entries are all finite."""
    c = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), c.alias("c")).where((F.size("c") > 0) & ~bad)
    held = F.transform("c", lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(MOST)), F.lit(-MOST))).cast("long") + OFFSET)
    return rows.select("vec_id", held.alias("x"))


def _by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch, np.ndarray]]:
    """dimension, places of the rows, their batch and vectors, for every dimension of every block of rows."""
    for whole in batches:
        for lo in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(lo, BLOCK)
            lists = batch.column("x")
            offsets = lists.offsets.to_numpy()
            flat, dims = lists.values.to_numpy(zero_copy_only=False), np.diff(offsets)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                yield dim, at, batch, flat[offsets[at][:, None] + np.arange(dim)]


def dimension_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each dimension the number of vectors and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for dim, _, _, x in _by_dimension(batches):
            now = held.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
            now[0] += len(x)
            now[1] += (x >> 32).sum(0)
            now[2] += (x & 0xFFFFFFFF).sum(0)
        for dim, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, v)) for v in (dim,)] + [pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)], ["dim", "i", "n", "high", "low"])

    sums = fit.mapInArrow(run, "dim long, i long, n long, high long, low long").groupBy("dim", "i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("dim", "i").collect():  # as many rows as the vectors have entries
        out.setdefault(r.dim, (r.n, []))[1].append((r.high << 32) + r.low)
    return out


def _products(fit: DataFrame, dims: dict[int, int], of) -> dict[int, np.ndarray]:
    """For each dimension the sum of y'y over all vectors, y = of(dim, x) with dims[dim] columns; summed entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {dim: np.zeros((w, w)) for dim, w in dims.items()}
        for dim, _, _, x in _by_dimension(batches):
            y = of(dim, x)
            held[dim] += y.T @ y
        for dim, total in held.items():
            if total.any():
                i, j = np.triu_indices(len(total))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim)), pa.array(i * len(total) + j), pa.array(total[i, j])], ["dim", "cell", "v"])

    out = {dim: np.zeros((w, w)) for dim, w in dims.items()}
    for r in fit.mapInArrow(run, "dim long, cell long, v double").groupBy("dim", "cell").agg(F.sum("v").alias("v")).collect():
        i, j = divmod(r.cell, dims[r.dim])
        out[r.dim][i, j] = out[r.dim][j, i] = r.v
    return out


def _clusters(e: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of places whose sorted eigenvalues follow each other within near."""
    order = np.argsort(e)
    cut = np.flatnonzero(np.diff(e[order]) > near) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def refined_eigh(a: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix in extended precision.

    Starts from float32 eigenvectors. A step has four matrix products; it stops once corrections are below the precision
    or no longer halve. Eigenvalues that agree to that precision have any orthonormal basis of their space.
    """
    scale = HIGH(np.abs(a).max())
    if not scale > 0:
        return np.zeros(len(a), HIGH), np.eye(len(a), dtype=HIGH)
    a = a.astype(HIGH) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    one, last = np.eye(len(a), dtype=HIGH), np.inf
    size = np.linalg.norm(a.astype(float), 2)
    for step in range(steps):
        r = one - x.T @ x
        s = x.T @ a @ x
        e = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(e)
        near = 2 * (np.linalg.norm(off.astype(float), 2) + size * np.linalg.norm(r.astype(float), 2))
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > near
        turn = (s + s.T) / 2 + (e[None, :] + e[:, None]) / 2 * r  # symmetric, so that over the gaps it keeps X orthonormal
        change = r / 2 + np.where(apart, turn / np.where(apart, gap, 1), 0)
        x = x + x @ change
        for c in _clusters(e, near):  # the shifted problem of a cluster has small entries, so doubles tell its values apart
            own = x[:, c]
            small = own.T @ (a @ own - e[c].mean() * own)
            x[:, c] = own @ np.linalg.eigh(((small + small.T) / 2).astype(float))[1].astype(HIGH)
        now = float(np.abs(change).max())
        if now < 1e-17 or step > 1 and now >= last / 2:
            break
        last = now
    x = x + x @ (one - x.T @ x) / 2
    e = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-e, kind="stable")
    return e[order] * scale, x[:, order]


@dataclass
class Whitening:
    """What the vectors of one dimension need: their number and sums, and the components found."""

    n: int
    sums: list[int]
    middle: np.ndarray  # of each entry: the mean, rounded to a whole number
    rest: np.ndarray  # the mean less that
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float | None = None  # of the whitened covariance against the identity

    def used(self) -> np.ndarray:
        """Components with an eigenvalue above what rounding makes of 0."""
        return self.values > 1e-13 * max(self.trace, 0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((x - self.middle) - self.rest) @ (self.vectors / np.sqrt(np.where(self.used(), self.values, np.nan)))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over entries of (n * x - sum)^2, exact; none where it doesn't fit a long."""
        left = [s - self.n * m for s, m in zip(self.sums, self.middle.tolist(), strict=True)]
        z = x - self.middle
        most = (self.n * float(np.abs(z).max(initial=0)) + max(map(abs, left), default=0)) ** 2 * max(len(left), 1)
        if most < 2**62:
            return ((self.n * z - np.array(left, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, left, strict=True)) for row in z.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def fit_whitening(fit: DataFrame, components: int) -> dict[int, Whitening]:
    """The whitening of every dimension in fit (rows of distinct vectors x).

    Covariances are centred first: whole numbers less the rounded mean are multiplied, which doubles do exactly, and what
    is left of the mean, below one half, is taken off in extended precision. The driver gets sums of as many entries as
    a vector has, and their products, whatever the number of rows.
    """
    sums = dimension_sums(fit)
    middle = {dim: np.array([(2 * s + n) // (2 * n) for s in total], np.int64) for dim, (n, total) in sums.items()}
    products = _products(fit, {dim: dim for dim in sums}, lambda dim, x: (x - middle[dim]).astype(np.float64))
    found = {}
    for dim, (n, total) in sums.items():
        rest = np.array([HIGH(s - n * m) / n for s, m in zip(total, middle[dim].tolist(), strict=True)])
        covariance = products[dim].astype(HIGH) / n - np.outer(rest, rest)
        values, x = refined_eigh(covariance)
        k = min(components, dim)
        found[dim] = Whitening(n, total, middle[dim], rest.astype(float), values[:k].astype(float), x[:, :k].astype(float), float(np.trace(covariance)))
    with_one = _products(fit, {dim: len(w.values) + 1 for dim, w in found.items()}, lambda dim, x: np.hstack([np.nan_to_num(found[dim].whitened(x)), np.ones((len(x), 1))]))
    for dim, w in found.items():
        mean = with_one[dim][-1, :-1] / w.n
        off = np.abs(with_one[dim][:-1, :-1] / w.n - np.outer(mean, mean) - np.eye(len(mean)))[np.ix_(w.used(), w.used())]
        w.error = float(off.max()) if off.size else None
    return found


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 16) -> DataFrame:
    """For each row and component (numbered from 1 by falling eigenvalue): vec_id, component int, n long, deviation long,
    whitened double, explained double, identity_error double.

    Rows whose vector is null, empty or holds null or non-finite entries take no part; a null id is an id like others.
    Each entry c counts as the whole number floor(64 * c) + 1000000, held to 2^52 either side. The fit list holds every
    distinct vector once; repeated rows each get their rows. Vectors of another dimension have a fit of their own, so
    a table should hold few dimensions; fewer entries than components give as many components as entries. A component without
    variance has no whitened value, and explains 0 (nothing, if there is no variance at all). deviation is the exact
    sum of (n * x - sum)^2, null where it is beyond a long.

    The fit list is stored and read by three jobs that send sums per task and entry. Component tables hang on the
    dimension alone and go to all tasks. Rows are whitened without a shuffle.
    """
    rows = whole_vectors(vectors, vec_id, embedding)
    fit = stored(rows.select("x").dropDuplicates(["x"]), "fit-list")
    found = fit_whitening(fit, components)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, at, batch, x in _by_dimension(batches):
            w = found[dim]
            k, m = len(w.values), len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
            explained = w.values / w.trace if w.trace > 0 else np.full(k, np.nan)
            arrays = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), pa.array(w.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))]
            arrays += [pa.array(v, pa.float64(), from_pandas=True) for v in (w.whitened(x).reshape(-1), np.tile(np.where(w.used(), explained, explained * 0), m))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([w.error] * (m * k), pa.float64())], names)

    kind = vectors.schema[vec_id].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
