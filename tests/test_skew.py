"""Half of all flows from one source: results as without, and no task that has them all."""

import statistics as python_statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import detect, statistics
from tidewire.operators.skew import heavy_keys, spread_join
from tidewire.plans.views import flows

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark):
    """A flood: every other flow is from one source, some are from none."""
    f = flows(spark, SMALLEST)
    source = F.when(F.col("seq") % 2 == 0, "10.9.9.9").when(F.col("seq") % 29 == 0, F.lit(None)).otherwise(F.col("source_ip"))
    return f.withColumn("source_ip", source).repartition(8, "seq").persist()


def test_join(spark, hot):
    table = hot.filter("source_ip is not null").groupBy("source_ip").agg(F.count("*").alias("n"))
    heavy = heavy_keys(hot, "source_ip", 100)
    assert heavy["10.9.9.9"] == 50 and len(heavy) < 100
    got = spread_join(hot, table, "source_ip", heavy, "seq")
    want = hot.join(table, "source_ip", "left")
    assert sorted(map(tuple, got.select("seq", "n").collect()), key=str) == sorted(map(tuple, want.select("seq", "n").collect()), key=str)
    assert spread_join(hot, table, "source_ip", {}, "seq").count() == 1000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spread_join(hot, table, "source_ip", heavy, "seq")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) <= 3 * python_statistics.median(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_of_a_hot_source(hot):
    found = {r.seq: r for r in detect.enrich(hot).select("seq", "source_ip", "distinct_ports", "source_flows").collect()}
    rows = hot.select("seq", "source_ip", "destination_port").collect()
    ports, counts = {}, {}
    for r in rows:
        ports.setdefault(r.source_ip, set()).add(r.destination_port)
        counts[r.source_ip] = counts.get(r.source_ip, 0) + 1
    assert len(found) == 1000
    for r in rows:
        if r.source_ip is not None:
            assert (found[r.seq].distinct_ports, found[r.seq].source_flows) == (len(ports[r.source_ip]), counts[r.source_ip])


@pytest.mark.parametrize("piece", [20, 37, 100_000])
def test_trailing_zscore_by_source(hot, piece):
    got = {r.seq: r for r in statistics.trailing_zscore(hot, "byte_count", partition="source_ip", piece=piece).collect()}
    series = {}
    for r in sorted(hot.collect(), key=lambda r: (r.ts_ms, r.seq)):
        past = series.setdefault(r.source_ip, [])
        z = None
        if len(past) >= 10:
            x = np.array(past[-10:], float)
            z = abs(r.byte_count - x.mean()) / (x.std() or 1.0)
        assert (got[r.seq].z is None) == (z is None) and (z is None or got[r.seq].z == pytest.approx(z))
        past.append(r.byte_count)
    assert len(got) == 1000


def test_value_at_rank(spark):
    rng = np.random.default_rng(2)
    tiny = 5e-324
    for values in (rng.normal(0, 1, 500), rng.integers(0, 3, 300), np.exp(rng.normal(0, 50, 400)), [1.0], [2.0, 2.0], [-1e308, 1e308, 0.0], [0.0, tiny, 2 * tiny, tiny], [float("-inf"), 1.0, 2.0, float("inf"), float("inf")]):
        values = [float(v) for v in values]
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        ranked = sorted(values)
        for rank in {1, 2, len(values) // 3, len(values) // 2, len(values)}:
            assert statistics.value_at_rank(df, "v", rank, 16) == (ranked[rank - 1] if 1 <= rank <= len(values) else None), (values[:5], rank)
        assert statistics.value_at_rank(df, "v", 0) is None and statistics.value_at_rank(df, "v", len(values) + 1) is None
    top = statistics.reaching_rank(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "v double"), "v", 0.3)
    assert [tuple(r) for r in top.orderBy("v").collect()] == [(None, False), (1.0, False), (2.0, True), (2.0, True), (3.0, True)]
