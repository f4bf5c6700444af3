"""Embedding whitening: principal components by a randomised range finder, rows projected on them.

The fit list has each distinct vector once. A pass over it multiplies the
covariance with a narrow block of directions: every partition adds up
c (c' Q) of its centred rows c, the sums merge through groupBy, and what
reaches the driver has the size of the block. The block starts as random
directions, more of them than components are asked for, and each pass both
checks it (Rayleigh-Ritz: the covariance within the block, eigenvectors there,
what they leave over) and turns it further towards the large eigenvalues. If
what is left over does not become small enough in a few passes, as with equal
or nearly equal eigenvalues, the block is filled up to the full dimension, where
one pass is exact up to rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import map_arrow, materialize
from thalweg.llm.vectors import MOST, add_up, clamp, float_sums, largest, matrix, total, whole_rows


@dataclass
class Whitening:
    """What a fit found; ``components`` are columns, ``values`` their eigenvalues, largest first."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float
    passes: int
    full: bool

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def scaled(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; zero where there is no variance."""
        return np.where(self.values > 0, self.components / np.sqrt(np.where(self.values > 0, self.values, 1)), 0.0)


def _product(batch: pa.RecordBatch, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    c = matrix(batch) - mean
    return np.append((c.T @ (c @ q)).ravel(), (c * c).sum())


def _outer(batch: pa.RecordBatch, mean: np.ndarray, p: np.ndarray) -> np.ndarray:
    w = (matrix(batch) - mean) @ p
    return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])


def _ritz(q: np.ndarray, z: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the covariance within the block ``q`` (``z`` is its product), and what the first ones leave over.

    A vector is off by about its left-over divided by the distance to the next
    eigenvalue, so that quotient is what is given.
    """
    t = q.T @ z
    values, u = np.linalg.eigh((t + t.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    left = np.linalg.norm(z @ u - (q @ u) * values, axis=0)[:keep]
    gaps = np.abs(values[:keep, None] - values[None, :])
    gaps[np.arange(len(left)), np.arange(len(left))] = np.inf
    return values, q @ u, left / np.maximum(gaps.min(axis=1, initial=np.inf), 1e-300)


def fit_whitening(rows: DataFrame, keep: int = 4, more: int = 8, passes: int = 8, tolerance: float = 1e-12, seed: int = 12) -> Whitening | None:
    """Components of the distinct vectors of ``rows`` (x, all of one length); None without rows.

    Covariances have the divisor n. ``more`` directions are carried beyond the
    ``keep`` asked for; ``passes`` bounds the passes before the block is filled
    up. Sums of doubles are merged in no fixed order, so figures agree between
    layouts to rounding.
    """
    fit = materialize(rows.select("x").distinct(), "fit-list")
    sums = add_up(fit, lambda batch: np.append(total(x := matrix(batch), largest(x)), batch.num_rows))
    if not sums:
        return None
    n, sums = sums[-1], sums[:-1]
    size, mean = len(sums), np.array([s / n for s in sums])
    rng = np.random.default_rng(seed)
    keep = min(keep, size)
    q = np.linalg.qr(rng.standard_normal((size, min(size, keep + more))))[0]
    before, used = np.inf, 0
    while True:
        out = float_sums(fit, _product, mean, q) / n
        used += 1
        z, trace = out[:-1].reshape(size, -1), float(out[-1])
        values, vectors, left = _ritz(q, z, keep)
        worst, full = left.max(initial=0.0), q.shape[1] == size
        if full or trace == 0 or worst <= tolerance:
            break
        # at the rate of the last pass, would those that are left be enough?
        if used >= passes or (used > 2 and worst * (worst / before) ** (passes - used) > tolerance):
            q = np.linalg.qr(np.hstack([vectors, rng.standard_normal((size, size - q.shape[1]))]))[0]
        else:
            q = np.linalg.qr(z)[0]
        before = worst
    values, vectors = np.maximum(values[:keep], 0), vectors[:, :keep]
    values = np.where(values > 1e-13 * max(trace, 1e-300), values, 0.0)
    model = Whitening(n, sums, vectors, values, trace, 0.0, used, full)
    if (some := values > 0).any():
        out = float_sums(fit, _outer, mean, model.scaled()[:, some]) / n
        k = int(some.sum())
        at = out[k * k :]
        model.error = float(np.abs(out[: k * k].reshape(k, k) - np.outer(at, at) - np.eye(k)).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over the components of (n * x - sums)**2 for each row; exact, in Python's integers where 64 bits might not do."""
    wide = (n * largest(x) + max(map(abs, sums))) ** 2 * len(sums) > MOST
    kind = object if wide else np.int64
    return ((n * x.astype(kind) - np.array(sums, kind)) ** 2).sum(axis=1)


def whiten(vectors: DataFrame, keep: int = 4, scale: float = 256.0) -> DataFrame:
    """Whitened coordinates of the rows (vec_id, embedding), one row for each row and component.

    Returns vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error. Left out are rows whose vector is null, empty or holds null
    or non-finite entries, and rows of another length than most of the rest have
    (of equally frequent lengths the larger counts). Repeated vectors count once
    in the fit and get one row each time; rows without an id are rows like the
    others; an empty table gives no rows. With fewer dimensions than ``keep``
    there are as many components. Where a component has no variance (one distinct
    vector, say) whitened is 0, and it is left out of identity_error. Entries and
    deviations that 64 bits cannot hold are given as the nearest long. Equal
    eigenvalues have no order of their own: any basis of their space is right.
    Other columns are not looked at.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    every = materialize(whole_rows(vectors, scale), "vectors")
    sizes = every.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = every.where(F.size("x") == sizes[0]["size"])
    model = fit_whitening(rows, keep)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # ``keep`` components

    def project(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, x = shared.value, matrix(batch)
        w = (x - m.mean) @ m.scaled()
        k, rows = w.shape[1], np.repeat(np.arange(len(x)), w.shape[1])
        every = lambda v, t: pa.array(np.full(len(rows), v), t)
        return pa.record_batch(
            [
                batch.column("vec_id").take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                every(m.n, pa.int64()),
                pa.array(clamp(deviations(x, m.n, m.sums))[rows], pa.int64()),
                pa.array(w.ravel(), pa.float64()),
                pa.array(np.tile(m.values / m.trace if m.trace else m.values, len(x)), pa.float64()),
                every(m.error, pa.float64()),
            ],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    return map_arrow(rows, project, schema)
