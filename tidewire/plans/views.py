"""Deterministic flow tables derived from the events table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.features import NAMES

COUNTRIES = ("US", "CN", "RU", "DE", "GB", "FR", "JP", "BR", "IN", "KR")
GEO = "struct<country:string,city:string,latitude:double,longitude:double,asn:string,isp:string>"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _derived(e: DataFrame) -> DataFrame:
    u, k, i = F.col("user_id"), F.col("k"), F.col("event_id")
    high, low = F.floor(u / 256), u % 256
    kind = F.col("event_type")
    bytes_ = F.round(F.col("value") * 1000).cast("long")
    port = F.element_at(F.array(*[F.lit(p) for p in (80, 443, 53, 22, 25, 8080)]), k % 10 + 1)
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), ((u + F.when(k % 5 == 0, F.floor(k / 5)).otherwise(0)) % 10 + 1).cast("int"))
    flags = [(i % n == 0).alias(name) for name, n in (("syn", 2), ("ack", 3), ("fin", 5), ("rst", 7), ("psh", 11))]
    return e.select(
        i.alias("seq"),
        i.cast("string").alias("id"),
        "ts_ms",
        F.when(u % 4 == 3, F.concat_ws(".", F.lit("198.51"), 100 + high, low)).otherwise(F.concat_ws(".", F.lit("10.0"), high, low)).alias("source_ip"),
        F.concat(F.when(k < 60, "203.0.113.").when(k < 90, "192.168.1.").otherwise("224.0.0."), k).alias("destination_ip"),
        (1024 + i * 7 % 60000).cast("int").alias("source_port"),
        F.when(k % 10 < 6, F.when(k % 10 < 6, port)).otherwise(9000 + k).cast("int").alias("destination_port"),
        F.when(kind == "click", "HTTP").when(kind == "view", "HTTPS").when(kind == "signup", "DNS").when(kind == "purchase", "TCP").when(k % 7 == 0, "UNKNOWN").when(k % 7 == 1, "ICMP").otherwise("UDP").alias("protocol"),
        (1 + F.floor(bytes_ / 1500)).alias("packet_count"),
        bytes_.alias("byte_count"),
        (F.col("value") / 10).alias("duration"),
        F.struct(*flags, F.lit(False).alias("urg")).alias("flags"),
        (32 + u % 128).cast("int").alias("ttl"),
        (i * 31 % 65536).cast("int").alias("window_size"),
        ((kind == "error") & (F.col("value") > 100)).alias("is_anomaly"),
        F.struct(country.alias("country"), *[F.lit(None).cast(t).alias(n) for n, t in (("city", "string"), ("latitude", "double"), ("longitude", "double"), ("asn", "string"), ("isp", "string"))]).alias("geo"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(_events(spark, sf_dir))


def flows_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the flows a second time, later and by another id."""
    f = flows(spark, sf_dir)
    again = f.filter("seq % 10 = 0").withColumn("seq", F.col("seq") + 10**9).withColumn("id", F.concat(F.lit("d"), "id"))
    return f.union(again)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few five-tuples with many rows each."""
    f = _derived(_events(spark, sf_dir).withColumn("k", F.col("k") % 10))
    e = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), "user_id", "event_type")
    kind = F.col("event_type")
    name = F.when(kind == "click", "HTTP").when(kind == "view", "HTTPS").when(kind == "signup", "DNS").when(kind == "purchase", "TCP").otherwise("UDP")
    out = f.join(e, "seq").withColumn("source_ip", F.concat(F.lit("10.0.0."), F.col("user_id") % 15)).withColumn("source_port", F.lit(1024)).withColumn("protocol", name)
    return out.select(*f.columns)


def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows as capture lines."""
    f, empty = flows(spark, sf_dir), F.lit("")
    proto = F.when(F.col("protocol").isin("HTTP", "HTTPS", "TCP"), 6).when(F.col("protocol").isin("DNS", "UDP"), 17).when(F.col("protocol") == "ICMP", 1).otherwise(18)
    side = lambda n, c: F.when(proto == n, F.col(c).cast("string")).otherwise(empty)
    mask = sum((F.when(F.col(f"flags.{n}"), b).otherwise(0) for n, b in (("syn", 2), ("ack", 16), ("fin", 1), ("rst", 4), ("psh", 8))), F.lit(0))
    stamp = F.concat(F.floor(F.col("ts_ms") / 1000), F.lit("."), F.lpad((F.col("ts_ms") % 1000).cast("string"), 3, "0"))
    line = F.concat_ws("\t", stamp, "source_ip", "destination_ip", side(6, "source_port"), side(6, "destination_port"), side(17, "source_port"), side(17, "destination_port"), proto.cast("string"), F.col("byte_count").cast("string"), F.col("ttl").cast("string"), F.col("window_size").cast("string"), F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(mask)), 4, "0")))
    return f.select("seq", line.alias("value"))


def _flow_sql(k: str = "k0") -> str:
    country = "[" + ", ".join(f"'{c}'" for c in COUNTRIES) + "]"
    return f"""
SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, user_id, event_type,
  CASE WHEN user_id % 4 = 3 THEN '198.51.' || (100 + user_id // 256) || '.' || (user_id % 256) ELSE '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS source_ip,
  (CASE WHEN k < 60 THEN '203.0.113.' WHEN k < 90 THEN '192.168.1.' ELSE '224.0.0.' END) || k AS destination_ip,
  CAST(1024 + event_id * 7 % 60000 AS INTEGER) AS source_port,
  CAST(CASE k % 10 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 25 WHEN 5 THEN 8080 ELSE 9000 + k END AS INTEGER) AS destination_port,
  CASE event_type WHEN 'click' THEN 'HTTP' WHEN 'view' THEN 'HTTPS' WHEN 'signup' THEN 'DNS' WHEN 'purchase' THEN 'TCP' ELSE CASE k % 7 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'ICMP' ELSE 'UDP' END END AS protocol,
  1 + CAST(round(value * 1000) AS BIGINT) // 1500 AS packet_count, CAST(round(value * 1000) AS BIGINT) AS byte_count, value / 10 AS duration,
  event_id % 2 = 0 AS syn, event_id % 3 = 0 AS ack, event_id % 5 = 0 AS fin, event_id % 7 = 0 AS rst, event_id % 11 = 0 AS psh, false AS urg,
  CAST(32 + user_id % 128 AS INTEGER) AS ttl, CAST(event_id * 31 % 65536 AS INTEGER) AS window_size, event_type = 'error' AND value > 100 AS is_anomaly,
  {country}[(user_id + CASE WHEN k % 5 = 0 THEN k // 5 ELSE 0 END) % 10 + 1] AS country
FROM (SELECT *, {k} AS k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k0 FROM events))"""


#: Common table expressions; each query uses those that it needs.
FLOWS = f"flows AS ({_flow_sql()})"
FLOWS_DUP = "flows_dup AS (SELECT * FROM flows UNION ALL SELECT * REPLACE (seq + 1000000000 AS seq, 'd' || id AS id) FROM flows WHERE seq % 10 = 0)"
PACKETS = f"""packets AS (SELECT * REPLACE ('10.0.0.' || (user_id % 15) AS source_ip, 1024 AS source_port,
  CASE event_type WHEN 'click' THEN 'HTTP' WHEN 'view' THEN 'HTTPS' WHEN 'signup' THEN 'DNS' WHEN 'purchase' THEN 'TCP' ELSE 'UDP' END AS protocol) FROM ({_flow_sql('k0 % 10')}))"""

_NUMBERS = ["byte_count", "packet_count", "duration", "source_port", "destination_port", "ttl", "window_size"]
_ONE_HOT = [f"protocol = '{p}'" for p in ("TCP", "UDP", "HTTP", "HTTPS", "DNS")]
_TIMES = ["hour(make_timestamp(ts_ms * 1000))", "dayofweek(make_timestamp(ts_ms * 1000))"]
_CELLS = [*_NUMBERS, *_ONE_HOT, *_TIMES, "syn", "ack", "fin", "rst", "psh", "urg"]
FEATURES = "feats AS (SELECT seq, id, " + ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for x, n in zip(_CELLS, NAMES, strict=True)) + " FROM flows)"


def scaled_sql() -> str:
    """CTE of the min-max scaled features of all flows."""
    parts = ", ".join(f"CASE WHEN max({n}) OVER () > min({n}) OVER () THEN ({n} - min({n}) OVER ()) / (max({n}) OVER () - min({n}) OVER ()) ELSE 0.0 END AS {n}" for n in NAMES)
    return f"scaled AS (SELECT seq, id, {parts} FROM feats)"


def distance_sql(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{n} - {b}.{n}) * ({a}.{n} - {b}.{n})" for n in NAMES) + ")"
