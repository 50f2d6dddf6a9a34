"""What several operators of this subpackage share: written intermediate tables, membership bitmaps, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder name in the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, as in tests on one machine, a temporary folder stands for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidewire-"))
    return f"{base.rstrip('/')}/tidewire-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: lost executors don't lose them, lineage is cut."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(documents: DataFrame, columns: list[str] | tuple[str, ...]) -> Column:
    """The listed columns but doc_id and text as one struct named documents, so that no name clashes with an operator's
    own."""
    names = [c for c in columns if c not in ("doc_id", "text")]
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("documents") if names else F.lit(None).cast("string").alias("documents")


def restored(result: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The carried columns in their order, and doc_id and text, as columns again; `changed` stand for others."""
    return result.select(*[changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col("documents").getField(c)).alias(c) for c in columns])


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


@cache
def _trim() -> Callable[[int], int] | None:
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system, since a worker process outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose batches are brought to the declared types."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(declared)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in function(batches):
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in arrow], schema=arrow)
        finally:
            give_back()

    return df.mapInArrow(typed, declared)


class Bitmap:
    """A set of 64-bit keys as a bitmap (a Bloom filter with one hash): may hold more, never less.

    Its size follows the number of keys up to 2**MOST bits, 32 MB, so that it may be sent to every task; beyond, it
    holds more that isn't listed, and what it is used for shuffles more rows, with the same result.
    """

    LEAST, MOST = 16, 28

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = 64 * len(words) - 1

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> Bitmap:
        """keys: a written table. Bits are or-ed on the executors; the words that hold any reach the driver."""
        bits = int(np.clip((16 * keys.count()).bit_length(), cls.LEAST, cls.MOST))
        bit = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        rows = (
            keys.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
            .groupBy("w")
            .agg(F.bit_or("b").alias("b"))
            .toArrow()
        )
        words = np.zeros(1 << (bits - 6), np.int64)
        words[rows["w"].to_numpy()] = rows["b"].to_numpy()
        return cls(words.view(np.uint64))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bit = keys.astype(np.uint64) & np.uint64(self.mask)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node that can be reached.

    Alternates the large-star and the small-star step (Kiveris et al. 2014): each joins every node's neighbours to its
    smallest one. Both sides of each join are written tables, so that a hub's rows can be split among tasks.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: from each node, its larger neighbours to its smallest neighbour or itself
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        larger = now.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = larger.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large)
        # small star: each node and its smaller neighbours to the smallest of these
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(least.select("u", F.col("m").alias("v")).union(small).distinct())
        stars = after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0
        many = after.groupBy("u").count().filter("count > 1").limit(1).count()
        now = after
        if stars and not many:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
