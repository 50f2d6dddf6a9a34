"""Operator 9: exact top-k search by inner product with a pivot-distance index.

Vectors are lifted by one component so that all have the same norm; then the inner product falls as the distance
grows, and triangle inequalities bound it. The index keys every vector by its nearest pivot and its distance to it;
pivots are centres fitted on a bounded sample, and each pivot's distances are cut at quantiles into annuli (cells) of
about CELL vectors, at most RINGS, so the list of cells is of bounded size while every vector is indexed.

A query first searches the cell it would lie in itself, then expands over the cells in the order of the least distance
that the triangle inequality leaves between it and their annuli, ever more of them in a round. The k-th score so far
bounds the distance and tightens with every round; a query stops at the first cell that lies beyond it, since all
later ones do too. A cell is skipped only if each of its vectors is worse than the k-th: the result is exact. Cells and
queries meet as blocks of rows dealt by cell and salt, so a cell that holds a third of all rows is many tasks.

Components become floor(256 x), products are exact integers; a table whose products may exceed 64 bits is refused. Null
vectors and those with null, non-finite or no components take no part. Vectors of fewer components than others count as
filled up with zeros. Repeated vectors are candidates each, and each row whose vec_id is divisible is a query of its
own, whose own row alone is no candidate; ties go to the smaller vec_id. Rows without vec_id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.blocks import matrix, padded, usable
from tidewire.llm.common import map_arrow, written

PIVOTS, RINGS, CELL, SAMPLE = 16, 64, 4096, 8192
#: Rows of a block of vectors and of a block of queries; blocks of a cell that share a salt.
BLOCK, QUERIES, BLOCKS_PER_SALT = 512, 128, 8
#: A round expands over this many times the cells of all rounds before it.
GROWTH = 7

_NONE = -(1 << 62)


@dataclass
class Index:
    pivots: np.ndarray
    height: float  # the norm that all lifted vectors have, squared
    edges: list[np.ndarray]  # per pivot: inner bounds of its annuli
    lows: np.ndarray = None
    highs: np.ndarray = None
    of_pivot: np.ndarray = None
    salts: np.ndarray = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(self.height - (x * x).sum(1), 0))[:, None]), 1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        sq = (lifted * lifted).sum(1)[:, None] - 2 * lifted @ self.pivots.T + (self.pivots * self.pivots).sum(1)
        return np.sqrt(np.maximum(sq, 0))

    def cells(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot)"""
        d = self.distances(lifted)
        pivot = d.argmin(1)
        near = d[np.arange(len(d)), pivot]
        ring = np.zeros(len(d), np.int64)
        for p in np.unique(pivot).tolist():
            own = pivot == p
            ring[own] = np.searchsorted(self.edges[p], near[own], "right")
        return pivot * RINGS + ring, near


def integers(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x)


def fit_pivots(sample: np.ndarray, height: float, rows: int, seed: int = 7) -> Index:
    """Lloyd's steps from random rows; quantiles of the sample's distances cut the annuli."""
    rng = np.random.default_rng(seed)
    index = Index(sample[:0], height, [])
    lifted = index.lifted(sample)
    index.pivots = lifted[rng.choice(len(lifted), min(PIVOTS, len(lifted)), replace=False)]
    for _ in range(5):
        near = index.distances(lifted).argmin(1)
        index.pivots = np.array([lifted[near == p].mean(0) if (near == p).any() else index.pivots[p] for p in range(len(index.pivots))])
    d = index.distances(lifted)
    near = d.argmin(1)
    for p in range(len(index.pivots)):
        own = d[near == p, p]
        rings = int(np.clip(rows * len(own) / len(lifted) / CELL, 1, RINGS))
        index.edges.append(np.unique(np.quantile(own, np.arange(1, rings) / rings)) if len(own) and rings > 1 else np.zeros(0))
    return index


def _search(vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query's row, row, vec_id, score) of each query's k best rows of one block; ids ascend in the block."""
    scores = (queries @ vectors.T).astype(np.int64)
    scores[query_rows[:, None] == rows[None, :]] = _NONE
    best = np.argsort(~scores, axis=1, kind="stable")[:, :k]
    value = np.take_along_axis(scores, best, 1).reshape(-1)
    got, best = value > _NONE, best.reshape(-1)
    return np.repeat(query_rows, len(best) // max(len(query_rows), 1))[got], rows[best][got], ids[best][got], value[got]


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the rows whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    base = embeddings.filter(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    component = lambda x: F.floor(x.cast("double") * 256).cast("double")
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + component(x) * component(x))
    about = base.agg(F.count("*").alias("n"), F.max(squares).alias("height"), F.max(F.size("embedding")).alias("width")).first()
    if not about.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if about.height >= 0.999 * 2.0**63:
        raise ValueError("inner products of these vectors may exceed 64 bits")
    # by Cauchy and Schwarz no sum of products exceeds the height: below 2**53 doubles hold it exactly
    kind, exact = (np.int64, np.int64) if about.height >= 2.0**53 else (np.int32, np.float64)
    element = "bigint" if kind is np.int64 else "int"
    base = base.select("vec_id", padded("embedding", about.width).alias("embedding"))
    sample = base.select("vec_id", "embedding", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(SAMPLE).toArrow()
    index = fit_pivots(integers(matrix(sample["embedding"].combine_chunks())), float(about.height), about.n)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = integers(matrix(batch.column("embedding")))
                cell, far = index.cells(index.lifted(x))
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).astype(kind)), x.shape[1])
                yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "vec_id": batch.column("vec_id"), "cell": cell.astype(np.int32), "far": far, "v": rows.cast(pa.list_(rows.type.value_type))})

    numbered = base.withColumn("row", F.monotonically_increasing_id())
    keyed = written(numbered.transform(map_arrow, placed, f"row long, vec_id long, cell int, far double, v array<{element}>"))
    cells = keyed.groupBy("cell").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n")).collect()  # at most PIVOTS * RINGS
    size = PIVOTS * RINGS
    index.lows, index.highs, index.salts = np.full(size, np.inf), np.full(size, -np.inf), np.zeros(size, np.int64)
    for c in cells:
        index.lows[c.cell], index.highs[c.cell] = c.lo, c.hi
        index.salts[c.cell] = -(-c.n // (BLOCK * BLOCKS_PER_SALT))
    index.of_pivot = np.minimum(np.arange(size) // RINGS, len(index.pivots) - 1)
    filled = np.flatnonzero(index.salts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell and distance become blocks."""
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            bounds = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                for i in range(a, b, BLOCK):
                    part = batch.slice(i, min(BLOCK, b - i))
                    ids, rows = part.column("vec_id").to_numpy(), part.column("row").to_numpy()
                    order = np.lexsort((rows, ids))
                    v = _integers_of(part.column("v"))[order]
                    salt = int(rows.min()) % int(index.salts[cell[a]])
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([int(cell[a])], pa.int32()), "salt": pa.array([salt], pa.int32()), "ids": [ids[order].tobytes()], "rows": [rows[order].tobytes()], "vectors": [v.tobytes()]})

    spread = keyed.repartitionByRange("cell", "far", "row").sortWithinPartitions("cell", "far", "row")
    blocks = written(spread.transform(map_arrow, packed, "cell int, salt int, ids binary, rows binary, vectors binary"))

    def asks(start: int, width: int):
        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Query blocks for the next cells of each query, as far as they may hold better rows."""
            for batch in batches:
                if not len(batch):
                    continue
                rows, v, home = batch.column("row").to_numpy(), _integers_of(batch.column("v")), batch.column("cell").to_numpy()
                least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)
                x = v.astype(np.float64)
                d = index.distances(np.concatenate((x, np.zeros((len(x), 1))), 1))[:, index.of_pivot[filled]]
                gap = np.maximum(np.maximum(index.lows[filled] - d, d - index.highs[filled]), 0)
                gap[home[:, None] == filled] = -1.0  # its own cell comes first
                order = np.argsort(gap, axis=1, kind="stable")[:, start : start + width]
                reach = (x * x).sum(1) + index.height - 2 * np.where(np.isnan(least), -np.inf, least)
                near = np.take_along_axis(gap, order, 1) ** 2 <= reach[:, None] + 1e-9 * (1 + index.height)
                query, nth = np.nonzero(near)
                cell = filled[order[query, nth]]
                for c in np.unique(cell).tolist():
                    own = query[cell == c]
                    for i in range(0, len(own), QUERIES):
                        part, n = own[i : i + QUERIES], int(index.salts[c])
                        yield pa.RecordBatch.from_pydict({"cell": pa.array([c] * n, pa.int32()), "salt": pa.array(range(n), pa.int32()), "query_rows": [rows[part].tobytes()] * n, "queries": [v[part].tobytes()] * n})

        return asked

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, ids, query_rows = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "query_rows"))
                vectors, queries = (np.frombuffer(row[c], kind).reshape(n, -1).astype(exact) for c, n in (("vectors", len(ids)), ("queries", len(query_rows))))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _search(vectors, rows, ids, queries, query_rows, k)], ["query", "row", "vec_id", "score"])

    queries = written(keyed.filter(F.col("vec_id") % every == 0).repartitionByRange("cell", "far", "row").sortWithinPartitions("cell", "far", "row"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    best = spark.createDataFrame([], "query long, row long, vec_id long, score long, rank int")
    start, width = 0, 1
    while start < len(filled):
        bound = best.filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("least"))
        wanted = queries.join(bound, "row", "left").select("row", "cell", "v", "least")
        wanted = written(wanted.transform(map_arrow, asks(start, width), "cell int, salt int, query_rows binary, queries binary"))
        if not wanted.limit(1).count():
            break
        found = wanted.join(blocks, ["cell", "salt"]).transform(map_arrow, met, "query long, row long, vec_id long, score long")
        best = written(best.drop("rank").union(found).withColumn("rank", rank).filter(F.col("rank") <= k))
        start, width = start + width, GROWTH * (start + width)
    named = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(named, "query").select("query_id", "rank", "vec_id", "score")


def _integers_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
