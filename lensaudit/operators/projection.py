"""Two-dimensional projections of vectors: PCA over all rows; t-SNE over all rows (tsne.py), or exact for a bounded sample in which all other rows are placed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import usable, vectors_from

#: Of t-SNE on a sample: fitted rows whose coordinates a further row is placed by, and their perplexity.
NEAR, NEAR_PERPLEXITY = 15, 5.0


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for _, x in vectors_from(batches, 0):
        if len(x):
            x1 = np.column_stack((np.ones(len(x)), x))
            total = x1.T @ x1 if total is None else total + x1.T @ x1
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "sums"])


def principal_axes(df: DataFrame, vector: str, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean, k axes (largest weight positive) and their shares of the variance; None below 2 rows.

    A task sums products of its own rows; sums meet by row of the matrix, so only one matrix reaches the driver.
    """
    cells = df.where(F.col(vector).isNotNull()).select(vector).mapInArrow(_moments, "i int, sums array<double>")
    rows = cells.select("i", F.posexplode("sums").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    i, j, x = (rows.column(c).to_numpy() for c in ("i", "j", "x"))
    if not len(i):
        return None
    m = np.zeros((i.max() + 1, i.max() + 1))
    m[i, j] = x
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    if n < 2:
        return None
    values, axes = np.linalg.eigh(m[1:, 1:] / n - np.outer(mean, mean))
    order = np.argsort(values)[::-1][:k]
    axes = axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return mean, axes, np.maximum(values[order], 0) / max(values.clip(0).sum(), 1e-300)


def pca(df: DataFrame, index: str, vector: str, prefix: str = "pca") -> DataFrame:
    """(index, x, y); null coordinates below 2 rows, and for vectors that usable() leaves out."""
    sound, others = usable(df, vector)
    found = principal_axes(sound, vector)
    nowhere = [F.lit(None).cast("double").alias(f"{prefix}_{a}") for a in "xy"]
    none = others.where(F.col(vector).isNotNull()).select(F.col(index), *nowhere)
    rows = sound.select(F.col(index), vector)
    names = f"`{index}` {df.schema[index].dataType.simpleString()}, {prefix}_x double, {prefix}_y double"
    if found is None:
        return rows.select(index, *nowhere).union(none)
    mean, axes, _ = found
    axes = np.vstack((axes, np.zeros_like(axes)))[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in vectors_from(batches, 1):
            at = (x - mean) @ axes.T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[:, 0]), pa.array(at[:, 1])], [index, f"{prefix}_x", f"{prefix}_y"])

    return rows.mapInArrow(run, names).union(none)


def tsne_layout(x: np.ndarray, perplexity: float, seed: int = 42, steps: int = 500) -> np.ndarray:
    """Exact t-SNE from a PCA start."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2) if n <= 400 else np.maximum((x * x).sum(1)[:, None] - 2 * x @ x.T + (x * x).sum(1)[None], 0)
    d = d.astype(np.float32)
    np.fill_diagonal(d, np.inf)
    d -= d.min(1, keepdims=True)
    lo, hi, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    finite, e = np.where(np.isinf(d), np.float32(0), d), np.empty_like(d)
    for _ in range(60):
        np.exp(np.multiply(d, -np.maximum(beta, 1e-30).astype(np.float32)[:, None], out=e), out=e)
        total = np.maximum(e.sum(1, dtype=np.float64), 1e-300)
        entropy = np.log(total) + beta * np.einsum("ij,ij->i", finite, e) / total
        high = entropy > np.log(perplexity)
        lo, hi = np.where(high, beta, lo), np.where(high, hi, beta)
        beta = np.where(np.isinf(hi), np.minimum(beta * 2, 1e30), (lo + hi) / 2)
    p = e / total[:, None].astype(np.float32)
    p = np.maximum((p + p.T) / (2 * n), np.float32(1e-12))
    centred = x - x.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    y = (u[:, :2] * s[:2]) if s.shape[0] >= 2 else np.column_stack((u[:, 0] * s[0], np.zeros(n)))
    y = y / max(y[:, 0].std(), 1e-12) * 1e-4 + np.random.default_rng(seed).normal(0, 1e-7, y.shape)
    move, gain = np.zeros_like(y), np.ones_like(y)
    rate = max(n / 12 / 4, 50)
    early, q, w = 12 * p, np.empty_like(p), np.empty_like(p)
    for step in range(steps):
        at = y.astype(np.float32)
        near = (at * at).sum(1)
        np.matmul(at, -2 * at.T, out=q)
        q += near[:, None] + 1
        q += near
        np.reciprocal(np.maximum(q, 1, out=q), out=q)
        np.fill_diagonal(q, 0)
        np.multiply(q, np.float32(-1 / q.sum(dtype=np.float64)), out=w)
        w += early if step < 150 else p
        w *= q
        grad = 4 * (w.sum(1, dtype=np.float64)[:, None] * y - w @ at)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if step < 150 else 0.8) * move - rate * gain * grad
        y = y + move
    return y - y.mean(0)


def place(x: np.ndarray, fitted: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coordinates for rows x: means of the layout y over the nearest of the fitted rows, weighted as t-SNE weights neighbours."""
    k = min(NEAR, len(fitted))
    out = np.empty((len(x), 2))
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512]
        rough = (part * part).sum(1)[:, None] - 2 * part @ fitted.T + (fitted * fitted).sum(1)[None]
        near = np.argpartition(rough, k - 1, axis=1)[:, :k]
        d = ((part[:, None] - fitted[near]) ** 2).sum(2)
        d -= d.min(1, keepdims=True)
        low, high, beta = np.zeros(len(part)), np.full(len(part), np.inf), 1 / np.maximum(d.mean(1), 1e-300)
        for _ in range(60):
            p = np.exp(-d * beta[:, None])
            p /= p.sum(1, keepdims=True)
            wide = -(p * np.log(np.maximum(p, 1e-300))).sum(1) > np.log(min(NEAR_PERPLEXITY, k / 2))
            low, high = np.where(wide, beta, low), np.where(wide, high, beta)
            beta = np.where(np.isinf(high), np.minimum(beta * 2, 1e300), (low + high) / 2)
        out[lo : lo + 512] = (p[:, :, None] * y[near]).sum(1)
    return out


def tsne(df: DataFrame, index: str, vector: str, seed: int = 42, most: int | None = None, prefix: str = "tsne") -> DataFrame:
    """(index, x, y) of a layout of all rows, as tsne.tsne() gives it; null below 5 rows.

    With `most` a cheaper sketch for the caller who asks for one: above so many rows the layout is fitted on those first by hash, at quadratic cost, and each other row is placed by its neighbours among them.
    """
    if most is None:
        from .tsne import tsne as of_all_rows

        return of_all_rows(df, index, vector, seed, prefix=prefix)
    sound, others = usable(df, vector)
    rows = sound.select(F.col(index), vector)
    some = rows.orderBy(F.xxhash64(index), index).limit(most).toArrow()
    names = [index, f"{prefix}_x", f"{prefix}_y"]
    n = some.num_rows
    nowhere = [F.lit(None).cast("double").alias(c) for c in names[1:]]
    none = others.where(F.col(vector).isNotNull()).select(F.col(index), *nowhere)
    if n < 5:
        return rows.select(index, *nowhere).union(none)
    fitted = np.array(some.column(vector).to_pylist(), float)
    y = tsne_layout(fitted, max(2, min(30, n // 4)), seed)
    ids = some.column(index).to_pylist()
    shared = df.sparkSession.sparkContext.broadcast((ids, fitted, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fitted, y = shared.value
        where = {(i, v.tobytes()): at for at, (i, v) in enumerate(zip(ids, fitted, strict=True))}
        for batch, x in vectors_from(batches, 1):
            if len(x):
                own = np.array([where.get((i, v.tobytes()), -1) for i, v in zip(batch.column(0).to_pylist(), x, strict=True)])
                at = y[own]
                at[own < 0] = place(x[own < 0], fitted, y)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[:, 0]), pa.array(at[:, 1])], names)

    return rows.mapInArrow(run, f"`{index}` {df.schema[index].dataType.simpleString()}, {prefix}_x double, {prefix}_y double").union(none)
