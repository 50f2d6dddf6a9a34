"""Traffic statistics. Every function takes a flow table and returns a table; sums are built before shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.browse import numbered


def totals(flows: DataFrame) -> DataFrame:
    return flows.agg(
        F.count("*").alias("total_flows"),
        F.coalesce(F.sum("byte_count"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum("packet_count"), F.lit(0)).alias("total_packets"),
        F.coalesce(F.avg("duration"), F.lit(0.0)).alias("avg_duration"),
    )


def distribution(flows: DataFrame, column: str) -> DataFrame:
    return flows.groupBy(column).agg(F.count("*").alias("flow_count"))


def anomaly_flag_count(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count_if("is_anomaly").alias("anomaly_count"))


def top_talkers(flows: DataFrame, n: int = 10) -> DataFrame:
    """Sources by bytes; equal ones in order of their first flow, whose place is reported."""
    by_source = flows.groupBy("source_ip").agg(
        F.count("*").alias("flow_count"),
        F.sum("byte_count").alias("byte_count"),
        F.sum("packet_count").alias("packet_count"),
        F.min_by("geo.country", F.when(F.col("geo").isNotNull(), F.col("seq"))).alias("country"),
        F.min("seq").alias("first_seq"),
    )
    return by_source.orderBy(F.desc("byte_count"), "first_seq").limit(n).drop("first_seq")


def time_series(flows: DataFrame, least_ms: int = 60_000, buckets: int = 100) -> DataFrame:
    """Equal intervals from the first flow on, at least least_ms long and at most about `buckets` of them; empty
    intervals are kept. The bounds are one row, from which both the counts and the intervals are derived."""
    bounds = flows.agg(F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1")).filter("t0 is not null").first()
    t0, t1 = (bounds.t0, bounds.t1) if bounds else (0, -1)
    width = max(least_ms, (t1 - t0) // buckets)
    bucket = F.floor((F.col("ts_ms") - t0) / width)
    counted = flows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("f"), F.sum("byte_count").alias("b"), F.sum("packet_count").alias("p"), F.count_if("is_anomaly").alias("a"))
    spine = flows.sparkSession.range((t1 - t0) // width + 1 if t1 >= t0 else 0).withColumnRenamed("id", "bucket")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return spine.join(counted, "bucket", "left").select(
        (F.lit(t0) + F.col("bucket") * width).alias("start_ms"), zero("f").alias("flow_count"), zero("b").alias("byte_count"), zero("p").alias("packet_count"), zero("a").alias("anomaly_count")
    )


def top_with_rest(counts: DataFrame, name: str = "protocol", n: int = 8, rest: str = "OTHER") -> DataFrame:
    """The n most frequent names and one row for all others, which stays apart from a name that is spelled the same."""
    counts = counts.filter("flow_count > 0")
    top = counts.orderBy(F.desc("flow_count"), name).limit(n).withColumn("is_rest", F.lit(False))
    others = counts.join(top.select(name), name, "left_anti").agg(F.sum("flow_count").alias("flow_count")).filter("flow_count > 0")
    return top.select(name, "is_rest", "flow_count").unionByName(others.select(F.lit(rest).alias(name), F.lit(True).alias("is_rest"), "flow_count"))


def merge_flows(flows: DataFrame) -> DataFrame:
    """One row per directed five-tuple: its first row with packets and bytes summed and the longest duration."""
    key = ["source_ip", "source_port", "destination_ip", "destination_port", "protocol"]
    rest = [c for c in flows.columns if c not in {*key, "seq", "packet_count", "byte_count", "duration"}]
    merged = flows.groupBy(*key).agg(
        F.min("seq").alias("seq"),
        F.sum("packet_count").alias("packet_count"),
        F.sum("byte_count").alias("byte_count"),
        F.max("duration").alias("duration"),
        F.count("*").alias("merged"),
        F.min_by(F.struct(*rest), "seq").alias("first"),
    )
    return merged.select("seq", *key, "packet_count", "byte_count", "duration", "merged", "first.*")


def drop_exact_duplicates(flows: DataFrame) -> DataFrame:
    """The first of the rows that agree in addresses, ports, protocol, sizes and time."""
    key = ["source_ip", "source_port", "destination_ip", "destination_port", "protocol", "byte_count", "packet_count", "ts_ms"]
    rest = [c for c in flows.columns if c not in key]
    first = flows.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("first"))
    return first.select(*key, "first.*").select(*flows.columns)


def baseline(flows: DataFrame) -> DataFrame:
    """Count, population means and deviations of sizes, and the mean flow rate per ms with its deviation."""
    out = flows.agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{c}_{s}") for c in ("byte_count", "packet_count", "duration") for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))],
        F.greatest(F.lit(1), F.max("ts_ms") - F.min("ts_ms")).alias("span_ms"),
    )
    return out.withColumn("rate_mean", F.col("n") / F.col("span_ms")).withColumn("rate_std", F.sqrt("n") / F.col("span_ms"))


def distinct_ports(flows: DataFrame) -> DataFrame:
    return flows.groupBy("source_ip").agg(F.countDistinct("destination_port").alias("distinct_ports"))


def distinct_countries(flows: DataFrame) -> DataFrame:
    return flows.groupBy("source_ip").agg(F.countDistinct(F.nullif("geo.country", F.lit(""))).alias("distinct_countries"))


def interarrival(flows: DataFrame, piece_ms: int = 600_000) -> DataFrame:
    """Per source: number of flows, mean and deviation of the times between them, and their coefficient of variation.

    Each source's flows are cut into pieces of time, so that a busy source is many groups; the times between pieces
    come from the pieces' first and last flows."""
    piece = F.floor(F.col("ts_ms") / piece_ms)
    before = F.lag("ts_ms").over(Window.partitionBy("source_ip", "piece").orderBy("ts_ms", "seq"))
    inside = flows.select("source_ip", "ts_ms", "seq", piece.alias("piece")).select("source_ip", (F.col("ts_ms") - before).alias("gap"), F.lit(1).alias("one"))
    ends = flows.groupBy("source_ip", piece.alias("piece")).agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    last = F.lag("last").over(Window.partitionBy("source_ip").orderBy("piece"))
    between = ends.select("source_ip", (F.col("first") - last).alias("gap"), F.lit(0).alias("one"))
    out = inside.union(between).groupBy("source_ip").agg(F.sum("one").alias("flows"), F.avg("gap").alias("gap_mean"), F.stddev_pop("gap").alias("gap_std"))
    return out.withColumn("cv", F.col("gap_std") / F.coalesce(F.nullif("gap_mean", F.lit(0.0)), F.lit(1.0)))


def near_counts(times: DataFrame, within_ms: int, pieces: int = 10) -> DataFrame:
    """near_count for each destination_ip and ts_ms of a table of both and n: the sum of n less than within_ms away.

    Rows are added up per millisecond and cut into pieces of time, each with the margins that its neighbours lend it, so
    that a flooded destination is many groups."""
    length = within_ms * pieces
    piece, offset = F.floor(F.col("ts_ms") / length), F.pmod("ts_ms", F.lit(length))
    lent = F.array_compact(F.array(piece, F.when(offset < within_ms - 1, piece - 1), F.when(offset > length - within_ms, piece + 1)))
    spread = times.groupBy("destination_ip", "ts_ms").agg(F.sum("n").alias("n")).withColumn("own", piece).withColumn("piece", F.explode(lent))
    near = Window.partitionBy("destination_ip", "piece").orderBy("ts_ms").rangeBetween(1 - within_ms, within_ms - 1)
    return spread.withColumn("near_count", F.sum("n").over(near)).filter("own = piece").select("destination_ip", "ts_ms", "near_count")


def burst_counts(flows: DataFrame, within_ms: int = 60_000, known: DataFrame | None = None) -> DataFrame:
    """Adds near_count: flows (of known, or the same) to the same destination less than within_ms away, itself included."""
    times = (flows if known is None else known).select("destination_ip", "ts_ms", F.lit(1).alias("n"))
    if known is not None:
        times = times.union(flows.select("destination_ip", "ts_ms", F.lit(0)))
    counted = near_counts(times, within_ms).withColumnsRenamed({"destination_ip": "_to", "ts_ms": "_at"})
    same = F.col("destination_ip").eqNullSafe(F.col("_to")) & F.col("ts_ms").eqNullSafe(F.col("_at"))
    return flows.join(counted, same, "left").drop("_to", "_at")


def trailing_zscore(series: DataFrame, value: str, n: int = 10, threshold: float = 2.0, partition: str | None = None, piece: int = 100_000) -> DataFrame:
    """z of each value against the n before it (none of which may lack), whether it exceeds the threshold, and a score.

    The series, or the series of all values of the partition column one behind the other, is cut into pieces of rows,
    each with the n rows before it, so that a long series is many groups and short ones share a group."""
    names = series.columns
    order = [*([partition] if partition else []), "ts_ms", "seq"]
    series = numbered(series, *order, name="_row").withColumn("_piece", F.floor(F.col("_row") / piece)).withColumn("_own", F.lit(True))
    ahead = series.filter(F.col("_row") % piece >= piece - n).withColumn("_piece", F.col("_piece") + 1).withColumn("_own", F.lit(False))
    past = Window.partitionBy("_piece", *([partition] if partition else [])).orderBy("_row").rowsBetween(-n, -1)
    out = series.unionByName(ahead).withColumns({"_mean": F.avg(value).over(past), "_std": F.stddev_pop(value).over(past), "_have": F.count(value).over(past)}).filter("_own")
    z = F.abs(F.col(value) - F.col("_mean")) / F.coalesce(F.nullif("_std", F.lit(0.0)), F.lit(1.0))
    flag = F.coalesce(F.col("z") > threshold, F.lit(False))
    score = F.when(F.col("is_outlier"), F.least(F.lit(1.0), F.col("z") / (2 * threshold))).otherwise(0.0)
    return out.withColumn("z", F.when(F.col("_have") == n, z)).withColumn("is_outlier", flag).withColumn("score", score).select(*names, "z", "is_outlier", "score")


def value_at_rank(df: DataFrame, column: str, rank: int, buckets: int = 4096) -> float | None:
    """The value that stands at a rank (from 1, ascending) among those that are neither null nor NaN; None outside of it.

    Distributed selection: values are counted by equal intervals, then only those of the interval that holds the rank,
    between its least and greatest value, and so on until these are the same; ties are no special case."""
    value = F.col(column).cast("double")
    held = df.select(value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, low, high = held.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not 1 <= rank <= n:
        return None
    while low < high:
        if low == float("-inf") or high == float("inf"):  # infinite values have no intervals: they are counted first
            below, above = held.agg(F.count_if(F.col("v") == float("-inf")), F.count_if(F.col("v") == float("inf"))).first()
            if rank <= below:
                return float("-inf")
            if rank > n - above:
                return float("inf")
            rank -= below
            held = held.filter(F.abs("v") < float("inf"))
            n, low, high = held.agg(F.count("*"), F.min("v"), F.max("v")).first()
            continue
        span = 0.5 * high - 0.5 * low  # halves can't overflow
        share = (F.lit(0.5) * F.col("v") - 0.5 * low) / span if span > 0 else (F.col("v") > low).cast("double")
        at = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        counts = held.filter(F.col("v").between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for r in sorted(counts, key=lambda r: r.at):
            if rank <= r.n:
                break
            rank -= r.n
        low, high = r.low, r.high
    return low


def reaching_rank(df: DataFrame, column: str, share: float) -> DataFrame:
    """Adds is_top: the value reaches that of rank floor(share * n) + 1 from above; values equal to that one do too."""
    n = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    cut = value_at_rank(df, column, n - int(share * n + 1e-9)) if n else None
    return df.withColumn("is_top", F.coalesce(F.col(column) >= F.lit(cut), F.lit(False)))
