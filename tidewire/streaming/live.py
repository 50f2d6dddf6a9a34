"""Live capture as a structured stream: lines become flows, batches are appended once, and what dashboards read is kept
up to date without reading the history.

What a batch leaves stands in folders named by its number:

- flows: all flows, a folder per batch, so that a batch that runs again replaces itself;
- recent: the latest `window` flows, made of the batch and the recent flows of the batch before;
- clusters: centres with decayed weights, made of the batch and the centres of the batch before;
- serving: the tables totals, protocols, ports, talkers and series of the recent flows, and those centres.

A mark is written last. Readers take the tables of the latest marked batch (served), so they never see tables that are
missing, mixed or half written. Recent flows, centres and tables of older batches than the last KEPT are removed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.functions.features import NAMES, Scaler, features
from tidewire.operators import statistics
from tidewire.operators.clustering import nearest
from tidewire.sources.capture import parse_lines

KEPT = 3
CENTRES = "cluster_id int, weight double, centre array<double>, offsets array<double>, scales array<double>"
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "totals": statistics.totals,
    "protocols": lambda recent: statistics.distribution(recent, "protocol"),
    "ports": lambda recent: statistics.distribution(recent, "destination_port"),
    "talkers": statistics.top_talkers,
    "series": statistics.time_series,
}


def read_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A folder to which capture files are added; other line sources (Kafka, sockets) give the same column."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


class _Folder:
    """Folders of batches in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.path = spark, folder.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def of(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/batch={number}"

    def has(self, kind: str, number: int) -> bool:
        return self.store.exists(self.path(f"{self.of(kind, number)}/_SUCCESS"))

    def mark(self, number: int) -> None:
        self.store.create(self.path(f"{self.of('serving', number)}/_DONE"), True).close()

    def marked(self) -> list[int]:
        found = self.store.globStatus(self.path(f"{self.folder}/serving/batch=*/_DONE")) or []
        return sorted(int(s.getPath().getParent().getName().removeprefix("batch=")) for s in found)

    def remove_before(self, number: int) -> None:
        for kind in ("recent", "clusters", "serving"):
            for s in self.store.globStatus(self.path(f"{self.folder}/{kind}/batch=*")) or []:
                if int(s.getPath().getName().removeprefix("batch=")) < number:
                    self.store.delete(s.getPath(), True)


def served(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A serving table as of the latest complete batch."""
    at = _Folder(spark, folder)
    done = at.marked()
    if not done:
        raise FileNotFoundError(f"{folder} has no complete batch yet")
    return spark.read.parquet(f"{at.of('serving', done[-1])}/{name}")


def recent_flows(own: DataFrame, before: DataFrame | None, number: int, window: int) -> DataFrame:
    """The latest `window` of a batch's flows and the recent ones before it: by batch, then by time; each with the batch
    it came with as `arrived`."""
    own = own.withColumn("arrived", F.lit(number).cast("long"))
    every = own if before is None else own.unionByName(before)
    return every.orderBy(F.desc("arrived"), F.desc("ts_ms"), F.desc("seq")).limit(window)


def next_centres(flows: DataFrame, before: list | None, k: int, decay: float) -> list[tuple]:
    """Mini-batch k-means: rows of CENTRES after a batch.

    Each flow goes to its nearest centre; a centre is the mean of all its flows so far, in which those of a batch weigh
    `decay` times less with each batch that follows. The first batch with flows gives the scale of the features (its
    minima and maxima) and, by its first k flows, the centres to begin with. A centre that never had flows stays.
    """
    rows = features(flows, "seq")
    if before:
        scaler = Scaler(NAMES, list(before[0].offsets), list(before[0].scales))
        weights, centres = np.array([r.weight for r in before]), np.array([r.centre for r in before])
    else:
        first = rows.orderBy("seq").limit(k)
        scaler = Scaler.min_max(rows)
        centres = np.array([list(r)[1:] for r in scaler.apply(first).orderBy("seq").collect()])
        weights = np.zeros(len(centres))
    if not len(centres):
        return []
    sums = nearest(scaler.apply(rows), centres.tolist()).groupBy("cluster_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in NAMES])
    n, total = np.zeros(len(centres)), np.zeros(centres.shape)
    for r in sums.collect():
        n[r.cluster_id], total[r.cluster_id] = r.n, [r[c] for c in NAMES]
    old = decay * weights
    after = old + n
    means = (old[:, None] * centres + total) / np.where(after > 0, after, 1.0)[:, None]
    centres = np.where(after[:, None] > 0, means, centres)
    return [(i, float(after[i]), centres[i].tolist(), scaler.offsets, scaler.scales) for i in range(len(centres))]


def _update_clusters(spark: SparkSession, at: _Folder, own: DataFrame, number: int, k: int, decay: float) -> None:
    before = spark.read.schema(CENTRES).parquet(at.of("clusters", number - 1)).orderBy("cluster_id").collect() if at.has("clusters", number - 1) else None
    rows = spark.createDataFrame(next_centres(own, before, k, decay), CENTRES).coalesce(1)
    rows.write.mode("overwrite").parquet(at.of("clusters", number))
    rows.write.mode("overwrite").parquet(f"{at.of('serving', number)}/clusters")


def start(lines: DataFrame, folder: str, checkpoint: str, window: int = 1000, seconds: int = 5, clusters: int = 0, decay: float = 0.9) -> StreamingQuery:
    """Runs the pipeline of the module's text over capture lines. clusters: how many centres are kept; 0: none."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = _Folder(spark, folder)
        # the order within a batch is of no meaning beyond being the same each time
        row = F.row_number().over(Window.partitionBy("part").orderBy("ts_ms", "source_ip", "source_port", "destination_ip", "destination_port"))
        flows = parse_lines(batch).withColumn("part", F.pmod(F.xxhash64("source_ip", "destination_ip", "ts_ms"), F.lit(256)))
        flows = flows.withColumn("seq", F.lit(number) * F.lit(1 << 40) + F.col("part") * F.lit(1 << 32) + row).drop("part")
        flows = flows.withColumn("id", F.concat_ws("-", F.lit(number), "seq"))
        flows.write.mode("overwrite").parquet(at.of("flows", number))
        own = spark.read.schema(flows.schema).parquet(at.of("flows", number))
        before = spark.read.parquet(at.of("recent", number - 1)) if at.has("recent", number - 1) else None
        recent_flows(own, before, number, window).coalesce(1).write.mode("overwrite").parquet(at.of("recent", number))
        recent = spark.read.parquet(at.of("recent", number)).withColumn("geo", F.lit(None).cast("struct<country:string>"))
        for name, make in TABLES.items():
            make(recent).coalesce(1).write.mode("overwrite").parquet(f"{at.of('serving', number)}/{name}")
        if clusters:
            _update_clusters(spark, at, own, number, clusters, decay)
        at.mark(number)
        at.remove_before(number - KEPT + 1)

    return lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def start_clusters(flows: DataFrame, folder: str, checkpoint: str, k: int, decay: float = 0.9, seconds: int = 5) -> StreamingQuery:
    """Centres alone, over a stream of flows."""

    def handle(batch: DataFrame, number: int) -> None:
        at = _Folder(batch.sparkSession, folder)
        own = batch.persist()
        try:
            _update_clusters(batch.sparkSession, at, own, number, k, decay)
        finally:
            own.unpersist()
        at.mark(number)
        at.remove_before(number - KEPT + 1)

    return flows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def windowed_counts(flows: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Flows and bytes per interval of event time, for a stream of flows; rows later than the watermark are dropped."""
    return flows.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("flow_count"), F.sum("byte_count").alias("byte_count"))
