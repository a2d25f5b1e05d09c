"""Embedding whitening by incremental eigendecomposition.

A partition holds the mean and the spectrum (eigenvalues and eigenvectors of the scatter about the mean) of
the vectors it has seen. A further vector, centred on the mean, is a rank-one update: its eigenvalues are the
roots of a secular equation, solved for all at once, after deflation has taken out the eigenpairs that the
update does not move. Spectra of partitions are combined in a tree: each eigenpair of the one is a rank-one
update of the other, and so is the step between their means. The leading vectors at last span a space in which
the covariance, applied by a distributed pass, is diagonalised (Rayleigh-Ritz), again until residuals are at
rounding level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded, grid, written

EPS = np.finfo(np.float64).eps
SPECTRUM = "part long, n long, mean array<double>, eigenvalues array<double>, eigenvectors array<double>, sums array<string>"
_NUMBERS = pa.list_(pa.float64())
SPECTRUM_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", _NUMBERS), ("eigenvalues", _NUMBERS), ("eigenvectors", _NUMBERS), ("sums", pa.list_(pa.string()))])
PRODUCT_ARROW = pa.schema([("part", pa.int64()), ("product", _NUMBERS), ("trace", pa.float64())])


def secular(d: np.ndarray, w: np.ndarray, most: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + w w' and the differences d[i] - eigenvalue[j], at [j, i].

    d rises strictly and no w is 0. Root j lies between d[j] and d[j + 1] (the last: d[-1] + w'w). It is
    sought as a distance from the nearer end, so that the differences are exact to the last digits. A
    step takes the sums over the poles on either side for simple fractions of the two next poles; one
    that leaves the interval is replaced by halving. Roots that are found leave the work.
    """
    w2 = w * w
    ends = np.append(d, d[-1] + w2.sum())
    left, right = ends[:-1], ends[1:]
    half = (right - left) / 2
    from_left = 1 + (1 / (d[None, :] - d[:, None] - np.maximum(half, EPS * EPS)[:, None])) @ w2 >= 0
    from_left[-1] = True
    base = np.where(from_left, left, right)
    gaps = d[None, :] - base[:, None]
    mus = np.where(from_left, half, -half) / 2
    lo, hi = np.where(from_left, 0.0, -half), np.where(from_left, half, 0.0)
    hi[-1] = right[-1] - left[-1]
    near, far = left - base, right - base
    under = np.tri(len(d)) * w2  # pole i is at or under root j
    at, gap, mu = np.arange(len(d)), gaps, mus.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(most):
            each = gap - mu[:, None]
            np.reciprocal(each, out=each)
            total, low = each @ w2, np.einsum("ji,ji->j", under, each)
            f = 1 + total
            np.multiply(each, each, out=each)
            slope, left_slope = each @ w2, np.einsum("ji,ji->j", under, each)
            lo, hi = np.where(f < 0, mu, lo), np.where(f > 0, mu, hi)
            d1, d2 = near - mu, far - mu
            a, b, c = (d1 + d2) * f - d1 * d2 * slope, d1 * d2 * f, f - d1 * left_slope - d2 * (slope - left_slope)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = mu + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
            open_ = (np.abs(f) > EPS * len(d) * (1 + total - 2 * low)) & (np.abs(new - mu) > EPS * np.abs(mu))
            mus[at] = mu
            if not open_.any():
                break
            at, gap, under, mu, lo, hi, near, far = (x[open_] for x in (at, gap, under, new, lo, hi, near, far))
    return base + mus, gaps - mus[:, None]


@dataclass
class Spectrum:
    """How many vectors, their mean and exact sums, and the eigenpairs of their scatter sum((x - mean)(x - mean)')."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    sums: list[int]
    updates: int = 0

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, np.zeros(size), np.zeros(0), np.zeros((size, 0)), [0] * size)

    def update(self, v: np.ndarray) -> None:
        """The scatter grows by v v'."""
        length = math.sqrt(float(v @ v))
        if length == 0:
            return
        u, d = self.vectors, self.values
        w = u.T @ v
        if u.shape[1] < len(v):
            rest = v - u @ w
            again = u.T @ rest
            w, rest = w + again, rest - u @ again
            size = math.sqrt(float(rest @ rest))
            if size > 1e-13 * length:
                u, d, w = np.column_stack([u, rest / size]), np.append(d, 0.0), np.append(w, size)
        order = np.argsort(d, kind="stable")
        d, w, u = d[order], w[order], u[:, order]
        tolerance = 8 * EPS * max(d[-1] if len(d) else 0.0, length * length)
        moved = np.flatnonzero(np.abs(w) * length > tolerance)
        if len(moved) > 1:
            s, t = w[moved[:-1]], w[moved[1:]]
            if (np.diff(d[moved]) * np.abs(s * t) <= tolerance * (s * s + t * t)).any():
                moved = self._deflate(d, w, u, moved, tolerance)
        if len(moved):
            roots, gap = secular(d[moved], w[moved])
            q = _weights(d[moved], w[moved], gap) / gap
            q /= np.sqrt((q * q).sum(1))[:, None]
            u[:, moved] = u[:, moved] @ q.T
            d[moved] = roots
        self.updates += 1
        if self.updates % 256 == 0:
            # rounding slowly bends the axes: one step towards orthogonality
            u = u @ (1.5 * np.eye(u.shape[1]) - 0.5 * (u.T @ u))
        self.values, self.vectors = d, u

    @staticmethod
    def _deflate(d: np.ndarray, w: np.ndarray, u: np.ndarray, moved: np.ndarray, tolerance: float) -> np.ndarray:
        """Of two eigenvalues that are as good as equal, turn their axes so that the update lies along one; the other then stays."""
        kept = [moved[0]]
        for j in moved[1:]:
            i = kept[-1]
            r = math.hypot(w[i], w[j])
            c, s = w[j] / r, w[i] / r
            if (d[j] - d[i]) * abs(c * s) <= tolerance:
                turned = u[:, i] * s + u[:, j] * c
                u[:, i] = u[:, i] * c - u[:, j] * s
                u[:, j] = turned
                d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                w[i], w[j] = 0.0, r
                kept[-1] = j
            else:
                kept.append(j)
        return np.array(kept)

    def add(self, x: np.ndarray) -> None:
        """One more vector: a rank-one update by what it differs from the mean so far. The exact sums are kept by the caller."""
        v = x - self.mean
        if self.n:
            self.update(v * math.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + v / self.n

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(vector * math.sqrt(value))
        total = self.n + other.n
        if self.n and other.n:
            self.update((other.mean - self.mean) * math.sqrt(self.n / total * other.n))
        self.mean = self.mean + (other.mean - self.mean) * (other.n / total)
        self.n = total
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self) -> tuple:
        return self.n, self.mean, self.values, self.vectors.ravel(), [str(s) for s in self.sums]

    @staticmethod
    def of(row) -> Spectrum:
        size = len(row.mean)
        return Spectrum(int(row.n), np.array(row.mean), np.array(row.eigenvalues), np.array(row.eigenvectors).reshape(size, -1), [int(s) for s in row.sums])


def _weights(d: np.ndarray, w: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The update for which the roots found are exact; eigenvectors made of it are orthogonal to the last digits."""
    k = len(d)
    between = d[:, None] - d[None, :]
    by = np.empty((k, k))  # root j over pole j where that is under pole i, else over pole j + 1
    by[:-1] = np.where(np.tri(k - 1, k, dtype=bool), between[1:], between[:-1])
    by[-1] = -1.0
    return np.copysign(np.sqrt(np.prod(np.abs(gap / by), axis=0)), w)


def _exact(x: np.ndarray, factor: float) -> np.ndarray:
    """x as int64 where results of up to factor times its largest entry fit, else as Python integers."""
    return x if not x.size or np.abs(x.astype(np.float64)).max() * factor < 2.0**62 else x.astype(object)


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def _spectra(fit: DataFrame, size: int) -> DataFrame:
    """One spectrum of each partition that has rows."""
    names = ("part", "n", "mean", "eigenvalues", "eigenvectors", "sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum.empty(size)
        for batch in batches:
            rows = _matrix(batch.column(0), size)
            for x in rows.astype(np.float64):
                s.add(x)
            s.sums = [a + int(b) for a, b in zip(s.sums, _exact(rows, len(rows)).sum(0), strict=True)]
        if s.n:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([dict(zip(names, (part, *s.row()), strict=True))], schema=SPECTRUM_ARROW)

    return fit.select("x").mapInArrow(run, SPECTRUM)


def _combined(rows: pd.DataFrame) -> pd.DataFrame:
    spectra = [Spectrum.of(r) for r in rows.sort_values("part").itertuples()]
    for s in spectra[1:]:
        spectra[0].merge(s)
    return pd.DataFrame([spectra[0].row()], columns=["n", "mean", "eigenvalues", "eigenvectors", "sums"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums, exactly, and divided by n."""
    largest = max([abs(v) for v in sums], default=0)
    by_n = _exact(x, n) if largest < 2**61 else x.astype(object)
    moved = by_n * n - np.array(sums, dtype=by_n.dtype)
    return moved, (moved / n).astype(np.float64)


def covariance_times(fit: DataFrame, parts: int, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """The fit list's covariance applied to the columns of q, and its trace: one pass, partial sums combined in a tree."""
    size = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trace, seen = np.zeros(q.shape), 0.0, 0
        for batch in batches:
            _, c = _centred(_matrix(batch.column(0), size), n, sums)
            out += c.T @ (c @ q)
            trace += float((c * c).sum())
            seen += len(c)
        if seen:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "product": out.ravel(), "trace": trace}], schema=PRODUCT_ARROW)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"product": [np.sum(np.stack(rows["product"].to_list()), axis=0)], "trace": [rows["trace"].sum()]})

    row = folded(fit.select("x").mapInArrow(run, "part long, product array<double>, trace double"), parts, add).first()
    return np.array(row["product"]).reshape(q.shape) / n, row["trace"] / n


@dataclass
class Whitening:
    """n, exact sums, leading eigenvalues and eigenvectors (columns) of the covariance, its trace, and how far from the identity the whitened covariance is."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None
    passes: int


def fit_components(fit: DataFrame, size: int, components: int, extra: int = 12, most_passes: int = 20, tolerance: float = 1e-13) -> Whitening | None:
    """The leading components of the vectors x (array<long>, all of `size` numbers) of fit, a written table; None if it is empty.

    Only one spectrum (size * size numbers) and products of size * (components + extra) numbers reach
    the driver. Passes are repeated until each leading pair's residual is under tolerance * trace,
    at most `most_passes` times.
    """
    parts = max(1, fit.rdd.getNumPartitions())
    row = folded(_spectra(fit, size), parts, _combined).first()
    if row is None:
        return None
    s = Spectrum.of(row)
    k = min(components, size)
    order = np.argsort(-s.values, kind="stable")[: k + extra]
    q = s.vectors[:, order]
    if q.shape[1] < min(k, size):
        # fewer directions than components: any others have the eigenvalue 0
        q = np.column_stack([q, np.eye(size)])
    q = np.linalg.qr(q)[0][:, : min(size, k + extra)]
    best = None
    for passes in range(1, most_passes + 1):
        product, trace = covariance_times(fit, parts, s.n, s.sums, q)
        inner = q.T @ product
        theta, y = np.linalg.eigh((inner + inner.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        found = q @ y
        residual = np.sqrt(((product @ y - found * theta)[:, :k] ** 2).sum(0)).max()
        if best is None or residual < best[0]:
            best = (residual, np.maximum(theta[:k], 0), found[:, :k], trace)
        if residual <= tolerance * trace or passes > 2 and residual > 0.5 * best[0]:
            break
        # what the covariance makes of the leading vectors goes into the next space
        q = np.linalg.qr(np.column_stack([found[:, :k], product @ y]))[0][:, : min(size, 2 * k + extra)]
    _, values, vectors, trace = best
    vectors = vectors / np.sqrt((vectors * vectors).sum(0))
    real = values > 1e-14 * trace
    error = None
    if real.any():
        w = vectors[:, real] / np.sqrt(values[real])
        error = float(np.abs(w.T @ covariance_times(fit, parts, s.n, s.sums, w)[0] - np.eye(real.sum())).max())
    return Whitening(s.n, s.sums, np.where(real, values, 0.0), vectors, trace, error, passes)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """Every sound row on the leading components: key, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double.

    Entries become x = floor(scale * entry). The components are fitted on each distinct x once. Rows whose
    vector is null, empty, holds a null or non-finite entry, or has another length than most (of equally
    many the shortest) take no part. A null key and repeated rows are kept as they are. A component
    without variance has explained 0 and whitened null; so have all, with identity_error null, where the
    vectors are all alike. An empty table gives no rows. Other columns are not looked at. An entry beyond
    what a long holds becomes the nearest long; a deviation beyond 38 digits is null.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and size(v) > 0")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, length, flat = grid(batch.column(0), scale)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.append(0, length.cumsum()).astype(np.int32), flat)], names=["x"])

    distinct = written(rows.select("v").mapInArrow(whole, "x array<long>").groupBy("x").agg(F.count("*").alias("copies")), "fit")
    length = distinct.groupBy(F.size("x").alias("size")).agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), "size").first()
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if length is None:
        return spark.createDataFrame([], schema)
    size = length["size"]
    model = fit_components(distinct.filter(F.size("x") == size), size, components)
    m = len(model.values)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(model.values > 0, model.vectors / np.sqrt(model.values), np.nan)
    explained = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values]
    n, sums, error = model.n, model.sums, model.identity_error
    digits = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                at, _, flat = grid(part.column(1), scale, size)
                moved, c = _centred(flat.reshape(-1, size), n, sums)
                small = moved.dtype != object and float(np.abs(moved.astype(np.float64)).max(initial=0)) ** 2 * size < 2.0**62
                deviation = ((moved if small else moved.astype(object)) ** 2).sum(1)
                y = c @ np.nan_to_num(w)
                out = [
                    part.column(0).take(pa.array(np.repeat(at, m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * m, n)),
                    pa.array([Decimal(int(d)) if d < digits else None for d in np.repeat(deviation, m)], pa.decimal128(38, 0)),
                    pa.array(y.ravel(), mask=np.tile(np.isnan(w).any(0), len(at))),
                    pa.array(np.tile(explained, len(at))),
                    pa.array([error] * (len(at) * m), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(out, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
