"""Rule-based and cluster-based anomaly detection.

All rules are columns of one table: flows with the global baseline (one row), with their source's aggregates and with
the count around them at their destination. Sources with a large share of the flows are dealt to many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.network import is_broadcast, is_mismatch, is_private, recommendation, severity
from tidewire.operators.skew import heavy_keys, spread_join
from tidewire.operators.statistics import baseline as baseline_of
from tidewire.operators.statistics import burst_counts, drop_exact_duplicates, interarrival


@dataclass(frozen=True)
class Thresholds:
    """Defaults are the production values."""

    least_baseline: int = 50
    z: float = 4.0
    ports: int = 50
    burst: int = 1000
    burst_ms: int = 60_000
    deviations: float = 3.0
    least_bytes: int = 1024
    least_flows: int = 10
    cv: float = 0.05
    countries: int = 8
    listed: tuple[str, ...] = ("CN", "RU", "KP", "IR")
    outlier_factor: float = 3.0


RULES = ("High Volume", "Port Scan", "DDoS Attack", "Data Exfiltration", "Suspicious Protocol", "Timing Anomaly", "Geographic Anomaly")


def enrich(flows: DataFrame, baseline: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds base (struct), distinct_ports, distinct_countries, source_flows, cv and near_count, taken from the baseline
    flows (the flows themselves if none are given)."""
    known = flows if baseline is None else baseline
    row = baseline_of(known).select("n", "byte_count_mean", "byte_count_std", "packet_count_mean", "packet_count_std").first()
    base = F.struct(*[F.lit(v).cast("double").alias(n) for n, v in row.asDict().items()])
    gaps = interarrival(known).select("source_ip", F.col("flows").alias("source_flows"), "cv")
    seen = known.groupBy("source_ip").agg(F.countDistinct("destination_port").alias("distinct_ports"), F.countDistinct(F.nullif("geo.country", F.lit(""))).alias("distinct_countries"))
    per_source = gaps.join(seen, "source_ip")
    counted = burst_counts(flows, t.burst_ms, baseline)
    fill = {"distinct_ports": 0, "distinct_countries": 0, "source_flows": 0}
    return spread_join(counted, per_source, "source_ip", heavy_keys(flows, "source_ip"), "seq").fillna(fill).withColumn("base", base)


def rule_columns(t: Thresholds = Thresholds()) -> list[tuple[str, Column, Column]]:
    """(type, fired, score) in the order in which types are listed."""
    one = F.lit(1.0)
    b = lambda n: F.col(f"base.{n}")
    enough = b("n") >= t.least_baseline
    z = lambda c: F.abs(F.col(c) - b(f"{c}_mean")) / F.coalesce(F.nullif(b(f"{c}_std"), F.lit(0.0)), one)
    zmax = F.greatest(z("byte_count"), z("packet_count"))
    limit = b("byte_count_mean") + t.deviations * b("byte_count_std")
    private, outside = is_private(F.col("source_ip")), ~is_private(F.col("destination_ip"))
    single = ~is_broadcast(F.col("destination_ip"))
    large = F.col("byte_count") > limit
    icmp = F.col("protocol") == "ICMP"
    unknown = F.col("protocol") == "UNKNOWN"
    wrong = is_mismatch(F.col("destination_port"), F.col("protocol"))
    listed = F.col("geo.country").isin(*t.listed)
    tests = [
        (enough & (zmax > t.z), F.least(one, zmax / 6)),
        (F.col("distinct_ports") > t.ports, F.least(one, F.col("distinct_ports") / (2 * t.ports))),
        (single & (F.col("near_count") > t.burst), F.least(one, F.col("near_count") / (2 * t.burst))),
        (enough & private & outside & single & (limit >= t.least_bytes) & large, F.least(one, F.col("byte_count") / F.greatest(2 * limit, one))),
        (single & F.when(icmp, outside & enough & large).otherwise(unknown | wrong), F.when(icmp, 0.65).when(unknown, 0.6).otherwise(0.55)),
        (single & (F.col("source_flows") >= t.least_flows) & (F.col("cv") < t.cv), F.least(one, (t.cv - F.col("cv")) / t.cv)),
        (F.col("geo").isNotNull() & (listed | (F.col("distinct_countries") > t.countries)), F.when(listed, 0.75).otherwise(F.least(one, F.col("distinct_countries") / 15))),
    ]
    return [(name, F.coalesce(fired, F.lit(False)), score) for name, (fired, score) in zip(RULES, tests, strict=True)]


def rule(flows: DataFrame, name: str, baseline: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """The flows on which one rule fires, with its score."""
    _, fired, score = next(r for r in rule_columns(t) if r[0] == name)
    return enrich(flows, baseline, t).filter(fired).withColumn("score", score)


def _description(kind: Column) -> Column:
    """What each type says."""
    return (
        F.when(kind == "High Volume", F.concat(F.lit("High traffic volume ("), F.col("byte_count"), F.lit(" bytes, "), F.col("packet_count"), F.lit(" packets)")))
        .when(kind == "Port Scan", F.concat(F.lit("Port scanning detected from "), F.col("source_ip")))
        .when(kind == "DDoS Attack", F.concat(F.lit("Possible DDoS toward "), F.col("destination_ip")))
        .when(kind == "Data Exfiltration", F.concat(F.lit("Large outbound transfer to "), F.col("destination_ip")))
        .when(kind == "Suspicious Protocol", F.lit("Protocol/port mismatch or unknown protocol"))
        .when(kind == "Timing Anomaly", F.concat(F.lit("Robotic timing pattern from "), F.col("source_ip")))
        .when(kind == "Geographic Anomaly", F.lit("Suspicious geographic origin"))
        .when(kind == "Cluster Outlier", F.lit("Statistical outlier from cluster"))
        .otherwise(kind)
    )


def detect(flows: DataFrame, baseline: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Flows on which a rule fires, with types (in rule order), score, severity, confidence, description, action."""
    hits = F.array(*[F.when(fired, F.struct(F.lit(name).alias("type"), score.alias("score"))) for name, fired, score in rule_columns(t)])
    found = enrich(flows, baseline, t).withColumn("hits", F.filter(hits, lambda h: h.isNotNull())).filter(F.size("hits") > 0)
    found = found.withColumn("types", F.col("hits.type")).withColumn("score", F.array_max("hits.score"))
    found = found.withColumn("severity", severity(F.col("score")))
    found = found.withColumn("confidence", F.least(F.lit(1.0), F.col("score") * 0.75 + F.when(F.size("types") > 1, 0.1).otherwise(0.0)))
    found = found.withColumn("description", F.concat_ws("; ", F.transform("types", _description))).withColumn("recommended_action", recommendation(F.col("severity")))
    return found.drop("hits", "base", "distinct_ports", "distinct_countries", "source_flows", "cv", "near_count")


def cluster_outliers(scaled: DataFrame, assignments: DataFrame, centroids: list[list[float]], columns: list[str], t: Thresholds = Thresholds()) -> DataFrame:
    """id, nearest_id, distance, score, severity, confidence of rows further from their nearest centroid than three times
    the mean distance of that cluster's members. scaled: id and the columns, by the scale that the centroids have."""
    from tidewire.operators.clustering import distances_to

    near = scaled.select("id", distances_to(columns, centroids).alias("d")).join(assignments.select("id", "cluster_id"), "id", "left")
    near = near.withColumn("distance", F.array_min("d")).withColumn("nearest_id", (F.array_position("d", F.col("distance")) - 1).cast("int"))
    means = near.filter(F.col("cluster_id") >= 0).groupBy("cluster_id").agg(F.avg(F.get("d", F.col("cluster_id"))).alias("mean_distance"))
    out = near.join(F.broadcast(means.withColumnRenamed("cluster_id", "nearest_id")), "nearest_id")  # a row per cluster
    limit = F.col("mean_distance") * t.outlier_factor
    out = out.filter(F.col("distance") > limit)
    out = out.withColumn("score", F.when(limit > 0, F.least(F.lit(1.0), F.col("distance") / (2 * limit))).otherwise(1.0))
    out = out.withColumn("confidence", F.when(limit > 0, F.least(F.lit(1.0), F.col("distance") / limit - 1)).otherwise(1.0))
    return out.select("id", "nearest_id", "distance", "score", severity(F.col("score")).alias("severity"), "confidence")


def detect_all(flows: DataFrame, outliers: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Duplicates go, rules are judged on what is left, and cluster outliers without a rule's finding are appended."""
    unique = drop_exact_duplicates(flows)
    found = detect(unique, None, t)
    if outliers is None:
        return found
    new = outliers.join(found.select("id"), "id", "left_anti").join(unique, "id")
    new = new.withColumn("types", F.array(F.lit("Cluster Outlier")))
    # fixed values: what cluster outliers say
    text = F.format_string("Outlier from cluster %d (dist: %.2f)", "nearest_id", "distance")
    new = new.withColumn("description", text).withColumn("recommended_action", F.lit("Review flow details and consider blocking if suspicious"))
    return found.unionByName(new.select(*found.columns))


def rollup(anomalies: DataFrame) -> DataFrame:
    """(group, name, n, avg_score): all, by severity, by type."""
    part = lambda df, group, name: df.groupBy(F.lit(group).alias("grp"), name.alias("name")).agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"))
    by_type = part(anomalies.select("score", F.explode("types").alias("type")), "type", F.col("type"))
    return part(anomalies, "total", F.lit("all")).union(part(anomalies, "severity", F.col("severity"))).union(by_type)
