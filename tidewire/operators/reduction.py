"""Projection to few dimensions, hulls and matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.features import NAMES, Scaler
from tidewire.operators.clustering import _by_products, bounded, coarse, gathered


def covariance(df: DataFrame, columns: list[str] = NAMES) -> DataFrame:
    """(i, j, value) of the population covariances of scaled columns, from one pass."""
    matrix = covariance_matrix(df, columns)
    cells = [(i, j, float(matrix[i, j])) for i in range(len(columns)) for j in range(len(columns))]
    return df.sparkSession.createDataFrame(cells, "i int, j int, value double")


def covariance_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The same as a matrix, for scaled columns: each task sums its rows' products, which takes far less generated code
    than an aggregate per pair."""
    d = len(columns)

    def sums(_, x: np.ndarray) -> np.ndarray:
        return np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))

    total = gathered(df.select(*columns), columns, 1 + d + d * d, sums)
    n, mean = max(total[0], 1.0), total[1 : 1 + d] / max(total[0], 1.0)
    return total[1 + d :].reshape(d, d) / n - np.outer(mean, mean)


def principal_axes(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k variances, k axes as rows); the largest loading of each axis is positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)[:k]
    axes = vectors[:, order].T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return np.maximum(values[order], 0), axes * signs[:, None]


def pca(df: DataFrame, k: int = 2, columns: list[str] = NAMES, scale: str = "min_max") -> tuple[DataFrame, list[float]]:
    """Rows (id, pc0, ...) projected on the axes of their scaled columns, and the share of each axis in the k axes'
    variance. min_max rows are projected as they are, z_score ones are centred by their scale."""
    scaler = Scaler.min_max(df, columns) if scale == "min_max" else Scaler.z_score(df, columns)
    scaled = scaler.apply(df)
    values, axes = principal_axes(covariance_matrix(scaled, columns), k)
    total = values.sum() or 1.0
    parts = [sum((F.col(c) * float(a) for c, a in zip(columns, axis, strict=True)), F.lit(0.0)).alias(f"pc{i}") for i, axis in enumerate(axes)]
    return scaled.select("id", *parts), (values / total).tolist()


def reconstruction_error(df: DataFrame, k: int = 5, columns: list[str] = NAMES) -> DataFrame:
    """(id, error): mean squared difference between each z-scored row and what k principal axes give back of it."""
    scaled = Scaler.z_score(df, columns).apply(df)
    _, axes = principal_axes(covariance_matrix(scaled, columns), k)
    parts = [sum((F.col(c) * float(a) for c, a in zip(columns, axis, strict=True)), F.lit(0.0)) for axis in axes]
    whole = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    kept = sum((p * p for p in parts), F.lit(0.0))
    return scaled.select("id", (F.greatest(whole - kept, F.lit(0.0)) / len(columns)).alias("error"))


def to_range(df: DataFrame, columns: list[str], low: float, high: float, flip: str | None = None) -> DataFrame:
    """Columns brought to [low, high] by their extremes; a constant column goes to low; `flip` runs downwards."""
    row = df.agg(*[F.min(c) for c in columns], *[F.max(c) for c in columns]).first()
    n = len(columns)
    out = {}
    for i, c in enumerate(columns):
        a, span = row[i] or 0.0, (row[n + i] or 0.0) - (row[i] or 0.0)
        unit = (F.col(c) - a) / (span or 1.0)
        out[c] = low + (1 - unit if c == flip else unit) * (high - low)
    return df.withColumns(out)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of matrices of cells (i, j, value): cells that are absent are 0."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("value").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chains, counter-clockwise; fewer than three points give none."""
    if len(points) < 3:
        return points[:0]
    order = sorted(map(tuple, points.tolist()))

    def half(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(order) + half(order[::-1]))


def cluster_hulls(points: DataFrame) -> DataFrame:
    """(cluster_id, corner, x, y) from cluster_id, x, y. Each task reduces its rows to their own hulls, so that only
    corners are gathered per cluster."""
    schema = "cluster_id int, x double, y double"

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for part in parts:
            for c, rows in part.groupby("cluster_id"):
                every = np.concatenate((held.get(c, np.zeros((0, 2))), rows[["x", "y"]].to_numpy(float)))
                held[c] = hull(every) if len(np.unique(every, axis=0)) > 2 else every
        for c, corners in held.items():
            yield pd.DataFrame({"cluster_id": np.int32(c), "x": corners[:, 0], "y": corners[:, 1]})

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        corners = hull(part[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"cluster_id": np.full(len(corners), part["cluster_id"].iloc[0], np.int32), "corner": np.arange(len(corners), dtype=np.int32), "x": corners[:, 0] if len(corners) else [], "y": corners[:, 1] if len(corners) else []})

    return points.select("cluster_id", "x", "y").mapInPandas(local, schema).groupBy("cluster_id").applyInPandas(whole, "cluster_id int, corner int, x double, y double")


def _embedded(x: np.ndarray, perplexity: float, iterations: int, rate: float, seed: int) -> np.ndarray:
    """t-SNE of the rows of an array: each point's bandwidth is found by bisection, then gradient descent with momentum
    0.5 and per-value gains."""
    n = len(x)
    y = np.random.default_rng(seed).normal(0, 1e-2, (n, 2))
    if n > 2:
        far = ((x[:, None] - x[None]) ** 2).sum(2)
        target, p = np.log(min(perplexity, (n - 1) / 3)), np.zeros((n, n))
        for i in range(n):
            low, high, beta = 0.0, np.inf, 1.0
            for _ in range(50):
                w = np.exp(-far[i] * beta)
                w[i] = 0
                total = max(w.sum(), 1e-300)
                gap = np.log(total) + beta * (far[i] * w).sum() / total - target
                if abs(gap) < 1e-5:
                    break
                low, high = (beta, high) if gap > 0 else (low, beta)
                beta = beta * 2 if high == np.inf else (low + high) / 2
            p[i] = w / total
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        step, gains = np.zeros_like(y), np.ones_like(y)
        for _ in range(iterations):
            q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
            np.fill_diagonal(q, 0)
            pull = (p - q / q.sum()) * q
            grad = 4 * (np.diag(pull.sum(1)) - pull) @ y
            gains = np.maximum(np.where(np.sign(grad) == np.sign(step), gains * 0.8, gains + 0.2), 0.01)
            step = 0.5 * step - rate * gains * grad
            y = y + step
            y -= y.mean(0)
    return y


def tsne(df: DataFrame, perplexity: float = 30.0, iterations: int = 100, rate: float = 200.0, seed: int = 0, columns: list[str] = NAMES, most: int = 1000) -> DataFrame:
    """Two-dimensional t-SNE of at most `most` rows. Quadratic in the rows and not distributed."""
    rows = bounded(df, most, columns)
    y = _embedded(rows[columns].to_numpy(float), perplexity, iterations, rate, seed)
    return df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in zip(rows["id"], y)], "id string, x double, y double")


def tsne_of_landmarks(df: DataFrame, perplexity: float = 30.0, iterations: int = 100, rate: float = 200.0, seed: int = 0, columns: list[str] = NAMES, landmarks: int = 150) -> DataFrame:
    """Two-dimensional t-SNE of any number of rows, at every size alike: `landmarks` k-means centres are embedded, and each
    row lies at the mean of its three nearest ones, weighted by a kernel whose squared width is their mean squared distance."""
    _, points, _ = coarse(df, landmarks, columns, seed=seed)
    at = _embedded(points, perplexity, iterations, rate, seed)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = part[columns].to_numpy(float)
            far = _by_products(x, points, root=False)
            near = np.zeros((len(x), min(3, len(points))), int)
            for k in range(near.shape[1]):
                near[:, k] = far.argmin(1)
                far[np.arange(len(x)), near[:, k]] = np.inf
            d = ((x[:, None, :] - points[near]) ** 2).sum(2)
            w = np.exp(-(d - d[:, :1]) / np.maximum(d.mean(1, keepdims=True), 1e-300))
            y = (at[near] * w[:, :, None]).sum(1) / w.sum(1)[:, None]
            yield pd.DataFrame({"id": part["id"], "x": y[:, 0], "y": y[:, 1]})

    return df.select("id", *columns).mapInPandas(place, "id string, x double, y double")
