"""Matrices in table cells and streams of groups, for operators that compute on blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector takes part: it and its components are neither null nor NaN nor infinite, and it has some."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def padded(vector: str, width: int) -> Column:
    """The vector's first `width` components, zeros where it has fewer."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0).cast("float"), F.greatest(F.lit(width) - F.size(vector), F.lit(0)))), 1, width)


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The runs of equal keys (integers) in batches sorted by them; what is held is one group and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        bounds = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1).tolist(), len(batch)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if held and (values[:, a] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[:, a]
    if held:
        yield pa.Table.from_batches(held)
