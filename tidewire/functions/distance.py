"""Distances as expressions over pairs of columns or over two arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "manhattan", "cosine", "chebyshev", "minkowski")


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def distance(a: Sequence[Column], b: Sequence[Column], metric: str = "euclidean", p: float = 3.0) -> Column:
    """Between two lists of columns; a zero vector is at cosine distance 1 from all."""
    diff = [x - y for x, y in zip(a, b, strict=True)]
    if metric == "euclidean":
        return F.sqrt(_sum([d * d for d in diff]))
    if metric == "manhattan":
        return _sum([F.abs(d) for d in diff])
    if metric == "chebyshev":
        return F.greatest(*map(F.abs, diff)) if len(diff) > 1 else F.abs(diff[0])
    if metric == "minkowski":
        return F.pow(_sum([F.pow(F.abs(d), F.lit(p)) for d in diff]), F.lit(1 / p))
    if metric == "cosine":
        norms = F.sqrt(_sum([x * x for x in a])) * F.sqrt(_sum([y * y for y in b]))
        return F.when(norms == 0, 1.0).otherwise(1 - _sum([x * y for x, y in zip(a, b, strict=True)]) / F.when(norms == 0, 1.0).otherwise(norms))
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def array_distance(a: str, b: str, size: int, metric: str = "euclidean", p: float = 3.0) -> Column:
    """Between two array columns of known size."""
    return distance([F.col(a)[i].cast("double") for i in range(size)], [F.col(b)[i].cast("double") for i in range(size)], metric, p)
