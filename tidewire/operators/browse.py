"""Listing flows and anomalies: filters, search, sorting, pages, numbered rows and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORTABLE = ("ts_ms", "source_ip", "destination_ip", "protocol", "byte_count", "packet_count", "duration")
PAGE_SIZES = (25, 50, 100, 200)


def _contains(column: Column, text: str) -> Column:
    return F.lower(column.cast("string")).contains(text.lower())


def search_flows(flows: DataFrame, text: str = "", protocol: str = "all") -> DataFrame:
    """Case-insensitive search in addresses, ports and protocol; protocol `all` lets every one pass."""
    if protocol != "all":
        flows = flows.filter(F.col("protocol") == protocol)
    if text:
        hits = [_contains(F.col(c), text) for c in ("source_ip", "destination_ip", "protocol", "source_port", "destination_port")]
        flows = flows.filter(reduce(lambda a, b: a | b, hits))
    return flows


def sort_flows(flows: DataFrame, by: str = "ts_ms", descending: bool = True) -> DataFrame:
    if by not in SORTABLE:
        raise ValueError(f"can't sort by {by!r}; known: {', '.join(SORTABLE)}")
    return flows.orderBy(F.desc(by) if descending else F.asc(by), "seq")


def page(ordered: DataFrame, number: int, size: int = 50) -> DataFrame:
    """Page `number` from 1 of an ordered table; numbers beyond the ends give the first or the last page."""
    last = max(1, -(-ordered.count() // size))
    return ordered.offset((min(max(1, number), last) - 1) * size).limit(size)


def browse_anomalies(anomalies: DataFrame, severity: str = "all", kind: str = "all", text: str = "", by: str = "time") -> DataFrame:
    if severity != "all":
        anomalies = anomalies.filter(F.col("severity") == severity)
    if kind != "all":
        anomalies = anomalies.filter(F.array_contains("types", kind))
    if text:
        hits = [_contains(F.col(c), text) for c in ("source_ip", "destination_ip", "description")]
        anomalies = anomalies.filter(reduce(lambda a, b: a | b, [*hits, F.exists("types", lambda t: _contains(t, text))]))
    level = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    order = {"score": F.desc("score"), "severity": level.desc(), "time": F.desc("ts_ms")}[by]
    return anomalies.orderBy(order, "seq")


def latest(flows: DataFrame, n: int = 1000) -> DataFrame:
    return flows.orderBy(F.desc("seq")).limit(n)


def numbered(df: DataFrame, *order: str, name: str = "row") -> DataFrame:
    """Adds the place of each row in the whole order, from 0, without gathering all rows in one task.

    Rows are range-partitioned and numbered in their partition; the partitions' counts, summed up, are added.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = parts.groupBy("_part").count()
    ahead = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_ahead"))  # a row per partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, within).join(F.broadcast(ahead), "_part").withColumn(name, F.col(name) + F.col("_ahead")).drop("_part", "_ahead")


def systematic_sample(flows: DataFrame, limit: int = 500) -> DataFrame:
    """Every ceil(n / limit)-th row by arrival if there are more than limit."""
    n = flows.count()
    if n <= limit:
        return flows
    return numbered(flows, "seq", name="_row").filter(F.col("_row") % -(-n // limit) == 0).drop("_row")


def train_test_split(flows: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds is_train: the first floor(share * n) rows by arrival."""
    cut = int(flows.count() * share + 1e-9)
    return numbered(flows, "seq", name="_row").withColumn("is_train", F.col("_row") < cut).drop("_row")


def nearest_point(points: DataFrame, x: float, y: float, within: float = 20.0) -> DataFrame:
    """The point (x, y columns) nearest to a place, if it is less than `within` away."""
    far = F.hypot(F.col("x") - x, F.col("y") - y)
    return points.withColumn("distance", far).filter(F.col("distance") < within).orderBy("distance", "seq").limit(1)
