"""The host graph of flows, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.network import edge_width, node_radius


def edges(flows: DataFrame) -> DataFrame:
    """One row per ordered pair of addresses."""
    out = flows.groupBy("source_ip", "destination_ip").agg(
        F.count("*").alias("flow_count"),
        F.sum("byte_count").alias("byte_count"),
        F.bool_or("is_anomaly").alias("is_anomaly"),
        F.min_by("protocol", "seq").alias("protocol"),
    )
    return out.withColumn("width", edge_width(F.col("flow_count")))


def nodes(flows: DataFrame) -> DataFrame:
    """One row per address, counted in both roles; its kind is the role in its first flow. Edges are summed first, so
    an address has no more rows to gather than neighbours."""
    pair = flows.groupBy("source_ip", "destination_ip").agg(F.count("*").alias("n"), F.sum("byte_count").alias("b"), F.bool_or("is_anomaly").alias("a"), F.min("seq").alias("seq"))
    roles = pair.select(F.col("source_ip").alias("ip"), F.lit(0).alias("role"), "n", "b", "a", "seq").union(pair.select(F.col("destination_ip").alias("ip"), F.lit(1).alias("role"), "n", "b", "a", "seq"))
    out = roles.groupBy("ip").agg(
        F.sum("n").alias("flow_count"),
        F.sum("b").alias("byte_count"),
        F.bool_or("a").alias("is_anomaly"),
        F.when(F.min_by("role", F.struct("seq", "role")) == 0, "source").otherwise("destination").alias("kind"),
        F.count_if(F.col("role") == 0).alias("targets"),
    )
    return out.withColumn("radius", node_radius(F.col("flow_count")))


def components(links: DataFrame, limit: int = 1000) -> DataFrame:
    """(node, component) of an undirected graph (a, b): the smallest node within reach. Labels spread to neighbours
    and then jump to their label's label, so long chains take few rounds; each round is a checkpoint."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")).checkpoint()
    for _ in range(limit):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("low"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("component", F.coalesce("low", "component")).alias("to"), F.col("component").alias("was"))
        jump = spread.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new = spread.join(jump, "to", "left").select("node", F.coalesce("far", "to").alias("component"), "was").checkpoint()
        labels = new.select("node", "component")
        if not new.filter("component <> was").limit(1).count():
            return labels
    raise RuntimeError(f"labels still change after {limit} rounds")
