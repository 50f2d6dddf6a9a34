"""All queries on flow data by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.distance import array_distance
from tidewire.functions.features import NAMES, Scaler, features, visual_columns
from tidewire.functions.network import display_units, simulated_protocol
from tidewire.operators import browse, clustering, detect, graph, linkage, models, reduction, sinks, statistics
from tidewire.operators.stored import scratch
from tidewire.plans.views import FEATURES, FLOWS, FLOWS_DUP, PACKETS, distance_sql, flows, flows_dup, packets, scaled_sql, tsv_lines
from tidewire.sources import capture, generator
from tidewire.streaming.alerts import Rule

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Thresholds at which every rule has flows that fire and flows that don't on the test tables.
SHOWN = detect.Thresholds(ports=25, burst=1, cv=0.9)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a number of digits, for comparison between engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scaled(df: DataFrame) -> DataFrame:
    rows = features(df, "seq", "id")
    return Scaler.min_max(rows).apply(rows)


SCALED = f"WITH RECURSIVE {FLOWS}, {FEATURES}, {scaled_sql()}"


# --- statistics


@query(f"""WITH {FLOWS} SELECT count(*) AS total_flows, CAST(coalesce(sum(byte_count), 0) AS BIGINT) AS total_bytes,
CAST(coalesce(sum(packet_count), 0) AS BIGINT) AS total_packets, round(coalesce(avg(duration), 0), 6) AS avg_duration FROM flows""")
def traffic_totals(spark, sf_dir):
    return rounded(statistics.totals(flows(spark, sf_dir)))


@query(f"WITH {FLOWS} SELECT protocol, count(*) AS flow_count FROM flows GROUP BY protocol")
def protocol_distribution(spark, sf_dir):
    return statistics.distribution(flows(spark, sf_dir), "protocol")


@query(f"WITH {FLOWS} SELECT destination_port, count(*) AS flow_count FROM flows GROUP BY destination_port")
def port_distribution(spark, sf_dir):
    return statistics.distribution(flows(spark, sf_dir), "destination_port")


@query(f"""WITH {FLOWS} SELECT source_ip, flow_count, byte_count, packet_count, country FROM (
SELECT source_ip, count(*) AS flow_count, CAST(sum(byte_count) AS BIGINT) AS byte_count, CAST(sum(packet_count) AS BIGINT) AS packet_count, arg_min(country, seq) AS country, min(seq) AS first_seq
FROM flows GROUP BY source_ip) ORDER BY byte_count DESC, first_seq LIMIT 10""")
def top_talkers(spark, sf_dir):
    return statistics.top_talkers(flows(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT count(*) FILTER (WHERE is_anomaly) AS anomaly_count FROM flows")
def anomaly_flag_count(spark, sf_dir):
    return statistics.anomaly_flag_count(flows(spark, sf_dir))


@query(f"""WITH {FLOWS}, {PACKETS} SELECT source_ip, source_port, destination_ip, destination_port, protocol, min(seq) AS seq, CAST(sum(packet_count) AS BIGINT) AS packet_count,
CAST(sum(byte_count) AS BIGINT) AS byte_count, round(max(duration), 6) AS duration, count(*) AS merged, arg_min(ts_ms, seq) AS ts_ms, arg_min(ttl, seq) AS ttl
FROM packets GROUP BY source_ip, source_port, destination_ip, destination_port, protocol""")
def merge_flows(spark, sf_dir):
    out = statistics.merge_flows(packets(spark, sf_dir))
    return rounded(out.select("source_ip", "source_port", "destination_ip", "destination_port", "protocol", "seq", "packet_count", "byte_count", "duration", "merged", "ts_ms", "ttl"))


@query(f"""WITH {FLOWS}, {FLOWS_DUP} SELECT seq, id, ts_ms, source_ip, destination_ip, byte_count FROM flows_dup
QUALIFY row_number() OVER (PARTITION BY source_ip, source_port, destination_ip, destination_port, protocol, byte_count, packet_count, ts_ms ORDER BY seq) = 1""")
def dedup_flows(spark, sf_dir):
    return statistics.drop_exact_duplicates(flows_dup(spark, sf_dir)).select("seq", "id", "ts_ms", "source_ip", "destination_ip", "byte_count")


@query(f"""WITH {FLOWS} SELECT count(*) AS n, round(avg(byte_count), 6) AS byte_count_mean, round(stddev_pop(byte_count), 4) AS byte_count_std, round(avg(packet_count), 6) AS packet_count_mean,
round(stddev_pop(packet_count), 6) AS packet_count_std, round(avg(duration), 6) AS duration_mean, round(stddev_pop(duration), 6) AS duration_std FROM flows""")
def baseline_stats(spark, sf_dir):
    out = statistics.baseline(flows(spark, sf_dir)).drop("span_ms", "rate_mean", "rate_std")
    return rounded(out.withColumn("byte_count_std", F.round("byte_count_std", 4)))


@query(f"""WITH {FLOWS} SELECT greatest(1, max(ts_ms) - min(ts_ms)) AS span_ms, round(1e6 * count(*) / greatest(1, max(ts_ms) - min(ts_ms)), 6) AS flows_per_million_ms,
round(1e6 * sqrt(count(*)) / greatest(1, max(ts_ms) - min(ts_ms)), 6) AS deviation FROM flows""")
def flow_rate(spark, sf_dir):
    out = statistics.baseline(flows(spark, sf_dir))
    return rounded(out.select("span_ms", (1e6 * F.col("rate_mean")).alias("flows_per_million_ms"), (1e6 * F.col("rate_std")).alias("deviation")))


@query(f"WITH {FLOWS} SELECT source_ip, count(DISTINCT destination_port) AS distinct_ports FROM flows GROUP BY source_ip")
def distinct_ports(spark, sf_dir):
    return statistics.distinct_ports(flows(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT source_ip, count(DISTINCT nullif(country, '')) AS distinct_countries FROM flows GROUP BY source_ip")
def distinct_countries(spark, sf_dir):
    return statistics.distinct_countries(flows(spark, sf_dir))


@query(f"""WITH {FLOWS}, b AS (SELECT min(ts_ms) AS t0, max(ts_ms) AS t1, greatest(60000, (max(ts_ms) - min(ts_ms)) // 100) AS w FROM flows),
c AS (SELECT (ts_ms - t0) // w AS i, count(*) AS f, sum(byte_count) AS b, sum(packet_count) AS p, count(*) FILTER (WHERE is_anomaly) AS a FROM flows, b GROUP BY 1),
s AS (SELECT unnest(range(0, (t1 - t0) // w + 1)) AS i, t0, w FROM b)
SELECT t0 + s.i * w AS start_ms, coalesce(f, 0) AS flow_count, CAST(coalesce(c.b, 0) AS BIGINT) AS byte_count, CAST(coalesce(p, 0) AS BIGINT) AS packet_count, coalesce(a, 0) AS anomaly_count
FROM s LEFT JOIN c ON s.i = c.i""")
def time_series(spark, sf_dir):
    return statistics.time_series(flows(spark, sf_dir))


@query(f"""WITH {FLOWS}, c AS (SELECT protocol, count(*) AS n FROM flows GROUP BY protocol), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, protocol) AS rn FROM c)
SELECT CASE WHEN rn <= 4 THEN protocol ELSE 'OTHER' END AS protocol, rn > 4 AS is_rest, CAST(sum(n) AS BIGINT) AS flow_count FROM r GROUP BY 1, 2""")
def protocol_top_n_other(spark, sf_dir):
    return statistics.top_with_rest(statistics.distribution(flows(spark, sf_dir), "protocol"), n=4)


@query(f"""WITH {FLOWS}, g AS (SELECT source_ip, ts_ms - lag(ts_ms) OVER (PARTITION BY source_ip ORDER BY ts_ms, seq) AS gap FROM flows)
SELECT source_ip, count(*) AS flows, round(avg(gap), 3) AS gap_mean, round(stddev_pop(gap) / coalesce(nullif(avg(gap), 0), 1), 6) AS cv FROM g GROUP BY source_ip""")
def interarrival_cv(spark, sf_dir):
    return rounded(statistics.interarrival(flows(spark, sf_dir)).select("source_ip", "flows", F.round("gap_mean", 3).alias("gap_mean"), "cv"))


@query(f"""WITH {FLOWS} SELECT seq, destination_ip, count(*) OVER (PARTITION BY destination_ip ORDER BY ts_ms RANGE BETWEEN 59999 PRECEDING AND 59999 FOLLOWING) AS near_count FROM flows""")
def dst_burst_count(spark, sf_dir):
    return statistics.burst_counts(flows(spark, sf_dir)).select("seq", "destination_ip", "near_count")


@query(f"""WITH {FLOWS}, w AS (SELECT seq, source_ip, byte_count, avg(byte_count) OVER p AS m, stddev_pop(byte_count) OVER p AS s, count(byte_count) OVER p AS n FROM flows
WINDOW p AS (PARTITION BY source_ip ORDER BY ts_ms, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN n = 10 THEN abs(byte_count - m) / coalesce(nullif(s, 0), 1) END AS z FROM w)
SELECT seq, source_ip, round(z, 5) AS z, coalesce(z > 2, false) AS is_outlier, round(CASE WHEN z > 2 THEN least(1, z / 4) ELSE 0 END, 5) AS score FROM z""")
def trailing_zscore(spark, sf_dir):
    return rounded(statistics.trailing_zscore(flows(spark, sf_dir), "byte_count", partition="source_ip").select("seq", "source_ip", "z", "is_outlier", "score"), 5)


# --- graph


@query(f"""WITH {FLOWS}, r AS (SELECT source_ip AS ip, 0 AS role, destination_ip AS target, byte_count, is_anomaly, seq FROM flows UNION ALL SELECT destination_ip, 1, NULL, byte_count, is_anomaly, seq FROM flows)
SELECT ip, count(*) AS flow_count, CAST(sum(byte_count) AS BIGINT) AS byte_count, bool_or(is_anomaly) AS is_anomaly, CASE WHEN arg_min(role, seq * 2 + role) = 0 THEN 'source' ELSE 'destination' END AS kind,
count(DISTINCT target) AS targets, round(8 + 3 * log10(count(*) + 1), 6) AS radius FROM r GROUP BY ip""")
def topology_nodes(spark, sf_dir):
    return rounded(graph.nodes(flows(spark, sf_dir)))


@query(f"""WITH {FLOWS} SELECT source_ip, destination_ip, count(*) AS flow_count, CAST(sum(byte_count) AS BIGINT) AS byte_count, bool_or(is_anomaly) AS is_anomaly, arg_min(protocol, seq) AS protocol,
round(greatest(1, 2 * log10(count(*))), 6) AS width FROM flows GROUP BY source_ip, destination_ip""")
def topology_edges(spark, sf_dir):
    return rounded(graph.edges(flows(spark, sf_dir)))


@query(f"""WITH RECURSIVE {FLOWS}, e AS (SELECT DISTINCT user_id AS a, user_id // 3 * 3 + (user_id * 7) % 3 AS b FROM flows), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, low) AS (SELECT a, a FROM u UNION SELECT u.b, r.low FROM u JOIN r ON u.a = r.node) SELECT node, min(low) AS component FROM r GROUP BY node""")
def graph_components(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    u = F.col("user_id")
    return graph.components(e.select(u.alias("a"), (F.floor(u / 3) * 3 + u * 7 % 3).alias("b")))


@query(f"""WITH RECURSIVE {FLOWS}, e AS (SELECT DISTINCT source_ip AS a, destination_ip AS b FROM flows WHERE is_anomaly AND byte_count > 250000), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, low) AS (SELECT a, a FROM u UNION SELECT u.b, r.low FROM u JOIN r ON u.a = r.node) SELECT node, min(low) AS component FROM r GROUP BY node""")
def host_components(spark, sf_dir):
    """Hosts that large flagged flows connect."""
    large = flows(spark, sf_dir).filter("is_anomaly and byte_count > 250000")
    return graph.components(large.select(F.col("source_ip").alias("a"), F.col("destination_ip").alias("b")))


# --- browsing


@query(f"""WITH {FLOWS} SELECT seq, source_ip, destination_ip, protocol FROM flows WHERE protocol = 'HTTPS' AND (lower(source_ip) LIKE '%443%' OR lower(destination_ip) LIKE '%443%' OR lower(protocol) LIKE '%443%'
OR CAST(source_port AS VARCHAR) LIKE '%443%' OR CAST(destination_port AS VARCHAR) LIKE '%443%')""")
def flow_search(spark, sf_dir):
    return browse.search_flows(flows(spark, sf_dir), "443", "HTTPS").select("seq", "source_ip", "destination_ip", "protocol")


@query(f"WITH {FLOWS} SELECT seq, byte_count FROM flows ORDER BY byte_count DESC, seq LIMIT 50 OFFSET 100")
def flow_page(spark, sf_dir):
    return browse.page(browse.sort_flows(flows(spark, sf_dir), "byte_count"), 3).select("seq", "byte_count")


@query(f"WITH {FLOWS} SELECT seq, ts_ms FROM flows ORDER BY seq DESC LIMIT 1000")
def last_n(spark, sf_dir):
    return browse.latest(flows(spark, sf_dir)).select("seq", "ts_ms")


@query(f"""WITH {FLOWS}, n AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS r, count(*) OVER () AS c FROM flows) SELECT seq FROM n WHERE c <= 500 OR r % CAST(ceil(c / 500) AS BIGINT) = 0""")
def systematic_sample(spark, sf_dir):
    return browse.systematic_sample(flows(spark, sf_dir)).select("seq")


@query(f"""WITH {FLOWS}, n AS (SELECT seq, row_number() OVER (ORDER BY seq) AS r, count(*) OVER () AS c FROM flows) SELECT seq, r <= floor(c * 0.8) AS is_train FROM n""")
def train_test_split(spark, sf_dir):
    return browse.train_test_split(flows(spark, sf_dir)).select("seq", "is_train")


@query(f"""WITH {FLOWS} SELECT seq, round(byte_count / 1024.0, 2) AS kb, round(byte_count / 1048576.0, 2) AS mb, round(byte_count / 1073741824.0, 2) AS gb, source_ip || ':' || source_port AS endpoint,
CASE WHEN is_anomaly THEN 'Yes' ELSE 'No' END AS anomaly, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp FROM flows""")
def display_columns(spark, sf_dir):
    f = flows(spark, sf_dir)
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("stamp")
    return f.select("seq", *display_units(F.col("byte_count")), F.concat_ws(":", "source_ip", "source_port").alias("endpoint"), F.when(F.col("is_anomaly"), "Yes").otherwise("No").alias("anomaly"), stamp)


@query(f"""WITH {FLOWS} SELECT seq, round(sqrt(power(ttl - 90, 2) + power(duration - 5, 2)), 6) AS distance FROM flows WHERE sqrt(power(ttl - 90, 2) + power(duration - 5, 2)) < 20 ORDER BY sqrt(power(ttl - 90, 2) + power(duration - 5, 2)), seq LIMIT 1""")
def point_pick(spark, sf_dir):
    points = flows(spark, sf_dir).select("seq", F.col("ttl").cast("double").alias("x"), F.col("duration").alias("y"))
    return rounded(browse.nearest_point(points, 90, 5).select("seq", "distance"))


# --- parsing and expansion

_PROTO = "CASE WHEN protocol IN ('HTTP', 'HTTPS', 'TCP') THEN 6 WHEN protocol IN ('DNS', 'UDP') THEN 17 WHEN protocol = 'ICMP' THEN 1 ELSE 18 END"


def _port_case(port: str, table: dict) -> str:
    return f"CASE {port} " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in table.items()) + " END"


def _tables():
    from tidewire.functions.network import APP_PORTS, SIMULATED_PORTS

    return APP_PORTS, SIMULATED_PORTS


@query(f"""WITH {FLOWS}, p AS (SELECT *, {_PROTO} AS n FROM flows), q AS (SELECT *, CASE WHEN n IN (6, 17) THEN source_port ELSE 0 END AS sp, CASE WHEN n IN (6, 17) THEN destination_port ELSE 0 END AS dp FROM p)
SELECT ts_ms, source_ip, destination_ip, sp AS source_port, dp AS destination_port, CASE WHEN n IN (6, 17) THEN coalesce({_port_case('dp', _tables()[0])}, {_port_case('sp', _tables()[0])}, CASE n WHEN 6 THEN 'TCP' ELSE 'UDP' END)
WHEN n = 1 THEN 'ICMP' ELSE 'OTHER' END AS protocol, CAST(1 AS BIGINT) AS packet_count, coalesce(nullif(byte_count, 0), 64) AS byte_count, syn, ack, fin, rst, psh, urg, ttl, window_size FROM q""")
def parse_tsv(spark, sf_dir):
    out = capture.parse_lines(tsv_lines(spark, sf_dir))
    return out.select("ts_ms", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "packet_count", "byte_count", "flags.*", "ttl", "window_size")


@query(f"WITH {FLOWS} SELECT DISTINCT destination_port, coalesce({_port_case('destination_port', _tables()[1])}, 'TCP') AS protocol FROM flows")
def port_protocol(spark, sf_dir):
    return flows(spark, sf_dir).select("destination_port").distinct().withColumn("protocol", simulated_protocol(F.col("destination_port")))


@query(f"""WITH {FLOWS}, x AS (SELECT *, unnest(range(0, packet_count)) AS packet FROM flows) SELECT id, packet, round(packet * duration * 1000 / packet_count, 6) AS offset_ms, byte_count // packet_count AS length FROM x""")
def packet_expand(spark, sf_dir):
    return rounded(generator.expand_packets(flows(spark, sf_dir)).select("id", "packet", "offset_ms", "length"))


@query(f"WITH {FLOWS} SELECT seq, id, source_ip, byte_count, round(duration, 6) AS duration, syn, country FROM flows")
def csv_roundtrip(spark, sf_dir):
    path = scratch(spark)
    f = flows(spark, sf_dir)
    sinks.write_csv(f, path)
    return rounded(capture.read_csv(spark, path, f.schema).select("seq", "id", "source_ip", "byte_count", "duration", "flags.syn", "geo.country"))


@query(f"WITH {FLOWS} SELECT seq, id, source_ip, byte_count, round(duration, 6) AS duration, syn, country FROM flows")
def json_roundtrip(spark, sf_dir):
    path = scratch(spark)
    f = flows(spark, sf_dir)
    sinks.write_json(f, path)
    return rounded(capture.read_json(spark, path, f.schema).select("seq", "id", "source_ip", "byte_count", "duration", "flags.syn", "geo.country"))


@query(f"WITH {FLOWS} SELECT seq, id, source_ip, byte_count, round(duration, 6) AS duration FROM flows")
def xml_roundtrip(spark, sf_dir):
    path = scratch(spark)
    sinks.write_xml(flows(spark, sf_dir), path)
    got = spark.read.format("xml").option("rowTag", "flow").schema("seq long, id string, source_ip string, byte_count long, duration double").load(path)
    return rounded(got.select("seq", "id", "source_ip", "byte_count", "duration"))


@query(f"WITH {FLOWS} SELECT 'flows' AS part, count(*) AS n, CAST(sum(byte_count) AS BIGINT) AS byte_count FROM flows UNION ALL SELECT 'anomalies', count(*), CAST(coalesce(sum(byte_count), 0) AS BIGINT) FROM flows WHERE is_anomaly")
def export_parts(spark, sf_dir):
    """An export of chosen parts, read back."""
    path = scratch(spark)
    f = flows(spark, sf_dir)
    sinks.export({"flows": f, "anomalies": f.filter("is_anomaly")}, path, "csv")
    of = lambda part: capture.read_csv(spark, f"{path}/{part}", f.schema).agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.coalesce(F.sum("byte_count"), F.lit(0)).alias("byte_count"))
    return of("flows").union(of("anomalies"))


@query(f"WITH {FLOWS} SELECT CAST(sum(16 + CASE WHEN protocol IN ('UDP', 'ICMP') THEN 42 ELSE 54 END) AS BIGINT) AS record_bytes FROM flows")
def upload_list(spark, sf_dir):
    """Bytes of the records of all captures that may be uploaded, by their sizes alone."""
    from tidewire.sources.pcap import FILE_HEADER, hosts, write_pcap

    path, f = scratch(spark), flows(spark, sf_dir)
    write_pcap(f, path, hosts=hosts(f))
    return capture.uploads(spark, path).agg(F.sum(F.col("length") - FILE_HEADER).alias("record_bytes"))


# --- features and distances

_ROUND = ", ".join(f"round({n}, 6) AS {n}" for n in NAMES)


@query(f"WITH {FLOWS}, {FEATURES} SELECT seq, {_ROUND} FROM feats")
def feature_vector(spark, sf_dir):
    return rounded(features(flows(spark, sf_dir), "seq"))


@query(f"WITH {FLOWS}, {FEATURES} SELECT seq, " + ", ".join(f"round(f{i:02d}, 6) AS v{k}" for k, i in enumerate((0, 1, 2, 3, 4, 5, 6, 14, 15))) + " FROM feats")
def visual_features(spark, sf_dir):
    return rounded(flows(spark, sf_dir).select("seq", *visual_columns()))


@query(f"WITH {FLOWS}, {FEATURES}, {scaled_sql()} SELECT seq, {_ROUND} FROM scaled")
def minmax(spark, sf_dir):
    return rounded(scaled(flows(spark, sf_dir)).drop("id"))


@query(f"WITH {FLOWS}, {FEATURES} SELECT seq, " + ", ".join(f"round(CASE WHEN stddev_pop({n}) OVER () > 0 THEN ({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () ELSE 0 END, 5) AS {n}" for n in NAMES) + " FROM feats")
def zscore(spark, sf_dir):
    rows = features(flows(spark, sf_dir), "seq")
    return rounded(Scaler.z_score(rows).apply(rows), 5)


def _vector_distance(metric: str):
    def run(spark, sf_dir):
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
        other = F.lit(e.filter("vec_id = 0").first().embedding)
        return rounded(e.withColumn("other", other).select("vec_id", array_distance("embedding", "other", 64, metric).alias("distance")))

    run.__name__ = f"dist_{metric}"
    body = {
        "euclidean": "sqrt(sum(power(x - y, 2)))",
        "manhattan": "sum(abs(x - y))",
        "chebyshev": "max(abs(x - y))",
        "minkowski": "power(sum(power(abs(x - y), 3)), 1 / 3.0)",
        "cosine": "CASE WHEN sum(x * x) = 0 OR sum(y * y) = 0 THEN 1 ELSE 1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) END",
    }[metric]
    sql = f"""WITH o AS (SELECT embedding AS other FROM embeddings WHERE vec_id = 0), p AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(other) AS DOUBLE) AS y FROM embeddings, o)
SELECT vec_id, round({body}, 6) AS distance FROM p GROUP BY vec_id"""
    query(sql)(run)


for _metric in ("euclidean", "manhattan", "cosine", "chebyshev", "minkowski"):
    _vector_distance(_metric)


_PAIRS = [(i, j, f"covar_pop({a}, {b})") for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)]


@query(f"WITH {FLOWS}, {FEATURES}, {scaled_sql()}, c AS (SELECT [" + ", ".join(f"{{'i': {i}, 'j': {j}, 'value': round({c}, 6)}}" for i, j, c in _PAIRS) + "] AS cells FROM scaled) SELECT unnest(cells, recursive := true) FROM c")
def covariance(spark, sf_dir):
    return rounded(reduction.covariance(scaled(flows(spark, sf_dir)))).withColumn("value", F.col("value") + 0.0)


#: Variances in units in which they have few digits before the point.
_UNITS = {n: 1e6 for n in ("f00", "f03", "f04", "f06")}


@query(f"WITH {FLOWS}, {FEATURES} SELECT " + ", ".join(f"round(var_pop({n}) / {_UNITS.get(n, 1.0)}, 3) AS {n}" for n in NAMES) + " FROM feats")
def variance_vector(spark, sf_dir):
    return rounded(features(flows(spark, sf_dir)).agg(*[(F.var_pop(n) / _UNITS.get(n, 1.0)).alias(n) for n in NAMES]), 3)


@query("""WITH a AS (SELECT l_linenumber AS i, l_suppkey % 7 AS j, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)
SELECT x.i AS i, y.i AS j, round(sum(x.value * y.value), 2) AS value FROM a x JOIN a y ON x.j = y.j GROUP BY 1, 2""")
def matrix_multiply(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("i"), (F.col("l_suppkey") % 7).alias("j")).agg(F.sum("l_quantity").alias("value"))
    return rounded(reduction.multiply(a, reduction.transpose(a)), 2)


# --- detection


def _rule(name: str, label: str, where: str, score: str):
    ctes = f"""{FLOWS}, b AS (SELECT count(*) AS n, avg(byte_count) AS bm, stddev_pop(byte_count) AS bs, avg(packet_count) AS pm, stddev_pop(packet_count) AS ps FROM flows),
g AS (SELECT source_ip, ts_ms - lag(ts_ms) OVER (PARTITION BY source_ip ORDER BY ts_ms, seq) AS gap FROM flows),
s AS (SELECT source_ip, count(*) AS source_flows, stddev_pop(gap) / coalesce(nullif(avg(gap), 0), 1) AS cv FROM g GROUP BY source_ip),
d AS (SELECT source_ip, count(DISTINCT destination_port) AS ports, count(DISTINCT nullif(country, '')) AS countries FROM flows GROUP BY source_ip),
x AS (SELECT f.*, b.*, s.source_flows, s.cv, d.ports, d.countries, count(*) OVER (PARTITION BY destination_ip ORDER BY ts_ms RANGE BETWEEN 59999 PRECEDING AND 59999 FOLLOWING) AS near,
greatest(abs(byte_count - bm) / coalesce(nullif(bs, 0), 1), abs(packet_count - pm) / coalesce(nullif(ps, 0), 1)) AS z, bm + 3 * bs AS lim,
source_ip LIKE '10.%' OR source_ip LIKE '192.168.%' AS own, destination_ip LIKE '10.%' OR destination_ip LIKE '192.168.%' AS inside, destination_ip LIKE '224.%' OR destination_ip LIKE '%.255' AS many,
CASE destination_port WHEN 80 THEN protocol <> 'HTTP' WHEN 443 THEN protocol <> 'HTTPS' WHEN 53 THEN protocol <> 'DNS' WHEN 22 THEN protocol <> 'SSH' WHEN 25 THEN protocol <> 'SMTP' ELSE false END AS wrong
FROM flows f JOIN s USING (source_ip) JOIN d USING (source_ip) CROSS JOIN b)"""

    def run(spark, sf_dir):
        return rounded(detect.rule(flows(spark, sf_dir), label, t=SHOWN).select("seq", "score"), 5)

    run.__name__ = name
    query(f"WITH {ctes} SELECT seq, round({score}, 5) AS score FROM x WHERE {where}")(run)
    return ctes, label, where, score


_RULES = [
    _rule("rule_high_volume", "High Volume", "n >= 50 AND z > 4", "least(1, z / 6)"),
    _rule("rule_port_scan", "Port Scan", "ports > 25", "least(1, ports / 50)"),
    _rule("rule_ddos", "DDoS Attack", "NOT many AND near > 1", "least(1, near / 2)"),
    _rule("rule_exfiltration", "Data Exfiltration", "n >= 50 AND own AND NOT inside AND NOT many AND lim >= 1024 AND byte_count > lim", "least(1, byte_count / (2 * lim))"),
    _rule("rule_protocol", "Suspicious Protocol", "NOT many AND CASE WHEN protocol = 'ICMP' THEN NOT inside AND n >= 50 AND byte_count > lim ELSE protocol = 'UNKNOWN' OR wrong END", "CASE protocol WHEN 'ICMP' THEN 0.65 WHEN 'UNKNOWN' THEN 0.6 ELSE 0.55 END"),
    _rule("rule_timing", "Timing Anomaly", "NOT many AND source_flows >= 10 AND cv < 0.9", "least(1, (0.9 - cv) / 0.9)"),
    _rule("rule_geo", "Geographic Anomaly", "country IN ('CN', 'RU', 'KP', 'IR') OR countries > 8", "CASE WHEN country IN ('CN', 'RU', 'KP', 'IR') THEN 0.75 ELSE least(1, countries / 15) END"),
]
_CTES = _RULES[0][0]
_HITS = "list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{label}' END" for _, label, w, _ in _RULES) + "], lambda t: t IS NOT NULL)"
_BEST = "greatest(" + ", ".join(f"CASE WHEN {w} THEN {s} ELSE 0 END" for _, _, w, s in _RULES) + ")"
_SEVERITY = "CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.65 THEN 'high' WHEN score >= 0.40 THEN 'medium' ELSE 'low' END"
_FOUND = f"WITH {_CTES}, a AS (SELECT seq, ts_ms, source_ip, destination_ip, byte_count, packet_count, {_HITS} AS types, {_BEST} AS score FROM x), found AS (SELECT *, {_SEVERITY} AS severity FROM a WHERE len(types) > 0)"


@query(_FOUND + """ SELECT seq, array_to_string(types, '|') AS types, round(score, 5) AS score, severity, round(least(1, score * 0.75 + CASE WHEN len(types) > 1 THEN 0.1 ELSE 0 END), 5) AS confidence FROM found""")
def detect_anomalies(spark, sf_dir):
    found = detect.detect_all(flows(spark, sf_dir), t=SHOWN)
    return rounded(found.select("seq", F.concat_ws("|", "types").alias("types"), "score", "severity", "confidence"), 5)


_TEXT = """CASE t WHEN 'High Volume' THEN 'High traffic volume (' || byte_count || ' bytes, ' || packet_count || ' packets)' WHEN 'Port Scan' THEN 'Port scanning detected from ' || source_ip
WHEN 'DDoS Attack' THEN 'Possible DDoS toward ' || destination_ip WHEN 'Data Exfiltration' THEN 'Large outbound transfer to ' || destination_ip WHEN 'Suspicious Protocol' THEN 'Protocol/port mismatch or unknown protocol'
WHEN 'Timing Anomaly' THEN 'Robotic timing pattern from ' || source_ip ELSE 'Suspicious geographic origin' END"""


@query(_FOUND + f""" SELECT seq, array_to_string(list_transform(types, lambda t: {_TEXT}), '; ') AS description, CASE severity WHEN 'low' THEN 'Monitor for further anomalies' WHEN 'medium' THEN 'Investigate source and review traffic patterns'
WHEN 'high' THEN 'Consider blocking source IP and alerting security team' ELSE 'Immediate action: block source and initiate incident response' END AS recommended_action FROM found""")
def anomaly_descriptions(spark, sf_dir):
    return detect.detect_all(flows(spark, sf_dir), t=SHOWN).select("seq", "description", "recommended_action")


@query(_FOUND + """, e AS (SELECT unnest(types) AS type, score FROM found)
SELECT 'total' AS grp, 'all' AS name, count(*) AS n, round(avg(score), 5) AS avg_score FROM found UNION ALL SELECT 'severity', severity, count(*), round(avg(score), 5) FROM found GROUP BY severity
UNION ALL SELECT 'type', type, count(*), round(avg(score), 5) FROM e GROUP BY type""")
def anomaly_rollup(spark, sf_dir):
    return rounded(detect.rollup(detect.detect_all(flows(spark, sf_dir), t=SHOWN)), 5)


@query(_FOUND + " SELECT seq, severity FROM found WHERE severity = 'critical' AND list_contains(types, 'High Volume') AND (source_ip LIKE '%10.0%' OR destination_ip LIKE '%10.0%')")
def anomaly_browse(spark, sf_dir):
    found = detect.detect_all(flows(spark, sf_dir), t=SHOWN)
    return browse.browse_anomalies(found, "critical", "High Volume", "10.0", "severity").select("seq", "severity")


# --- clustering with a fixed start


def _first(k: int, source: str = "scaled") -> str:
    return f"c0 AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS c, * EXCLUDE (seq, id) FROM {source} ORDER BY seq LIMIT {k})"


def _nearest(i: int) -> str:
    """Each row's nearest centroid; the lowest of equal ones."""
    return f"n{i} AS (SELECT s.seq, c.c, {distance_sql('s', 'c')} AS d FROM scaled s CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY s.seq ORDER BY {distance_sql('s', 'c')}, c.c) = 1)"


def _update(i: int, k: int) -> str:
    means = ", ".join(f"coalesce(avg({n}), 0) AS {n}" for n in NAMES)
    return f"c{i + 1} AS (SELECT k.c, {means} FROM (SELECT unnest(range(0, {k})) AS c) k LEFT JOIN (SELECT n{i}.c AS nc, s.* FROM n{i} JOIN scaled s USING (seq)) m ON m.nc = k.c GROUP BY k.c)"


@query(f"{SCALED}, {_first(3)}, {_nearest(0)} SELECT seq, CAST(c AS INTEGER) AS cluster_id, round(d, 6) AS distance FROM n0")
def nearest_centroid(spark, sf_dir):
    rows = scaled(flows(spark, sf_dir))
    return rounded(clustering.nearest(rows, clustering.first_rows(rows, 3)).select("seq", "cluster_id", "distance"))


@query(f"{SCALED}, {_first(3)}, {_nearest(0)}, {_update(0, 3)}, {_nearest(1)}, {_update(1, 3)}, {_nearest(2)} SELECT CAST(seq AS VARCHAR) AS id, CAST(c AS INTEGER) AS cluster_id FROM n2")
def kmeans_fixed(spark, sf_dir):
    rows = scaled(flows(spark, sf_dir))
    return clustering.k_means(rows, 3, init=clustering.first_rows(rows, 3), max_iterations=2, fixed=True).assignments


def by_remainder(df: DataFrame, k: int = 3) -> DataFrame:
    return df.select("id", (F.col("seq") % k).cast("int").alias("cluster_id"))


@query(f"""WITH {FLOWS} SELECT CAST(seq % 3 AS INTEGER) AS cluster_id, count(*) AS size, round(avg(byte_count), 6) AS avg_bytes, round(avg(packet_count), 6) AS avg_packets, round(avg(duration), 6) AS avg_duration,
round(count(*) / (SELECT count(*) FROM flows), 6) AS density FROM flows GROUP BY 1""")
def cluster_summary(spark, sf_dir):
    f = flows(spark, sf_dir)
    return rounded(clustering.summary(f, by_remainder(f), 3).select("cluster_id", "size", "avg_bytes", "avg_packets", "avg_duration", "density"))


@query(f"WITH {FLOWS} SELECT CAST(seq % 3 AS INTEGER) AS cluster_id, protocol, count(*) AS flow_count FROM flows GROUP BY 1, 2")
def cluster_protocols(spark, sf_dir):
    f = flows(spark, sf_dir)
    return clustering.cluster_protocols(f, by_remainder(f))


@query(f"""WITH {FLOWS}, c AS (SELECT CAST(seq % 3 AS INTEGER) AS cluster_id, protocol, count(*) AS flow_count FROM flows GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY flow_count DESC, protocol) AS INTEGER) AS rank FROM c QUALIFY rank <= 5""")
def cluster_top_protocols(spark, sf_dir):
    f = flows(spark, sf_dir)
    return clustering.top_protocols(f, by_remainder(f))


@query(f"""WITH {FLOWS} SELECT id, seq, source_ip, destination_ip, CAST(seq % 3 AS INTEGER) AS cluster_id, CAST(row_number() OVER (PARTITION BY seq % 3 ORDER BY seq) AS INTEGER) AS rank FROM flows QUALIFY rank <= 5""")
def cluster_first_members(spark, sf_dir):
    f = flows(spark, sf_dir)
    return clustering.first_members(f, by_remainder(f))


@query(f"""WITH {FLOWS} SELECT CAST(seq % 3 AS INTEGER) AS cluster_id, count(*) AS size, round(min(ttl), 6) AS min_x, round(max(ttl), 6) AS max_x, round(avg(ttl), 6) AS mean_x,
round(min(duration), 6) AS min_y, round(max(duration), 6) AS max_y, round(avg(duration), 6) AS mean_y FROM flows GROUP BY 1 HAVING count(*) >= 4""")
def cluster_boxes(spark, sf_dir):
    f = flows(spark, sf_dir)
    points = f.select(F.col("ttl").cast("double").alias("x"), F.col("duration").alias("y"), (F.col("seq") % 3).cast("int").alias("cluster_id"))
    return rounded(clustering.boxes(points, ["x", "y"]))


@query(f"{SCALED} SELECT CAST(seq % 3 AS INTEGER) AS cluster_id, " + ", ".join(f"round({f}({n}), 6) AS {f}_{n}" for n in NAMES for f in ("min", "max")) + " FROM scaled GROUP BY 1")
def cluster_bounds(spark, sf_dir):
    rows = scaled(flows(spark, sf_dir))
    return rounded(clustering.bounds(rows, by_remainder(rows)))


@query(f"""{SCALED}, p AS (SELECT a.seq, a.seq % 3 AS own, b.seq % 3 AS other, avg({distance_sql('a', 'b')}) AS d FROM scaled a JOIN scaled b ON a.seq <> b.seq GROUP BY ALL),
q AS (SELECT seq, own, coalesce(max(d) FILTER (WHERE own = other), 0) AS a, coalesce(min(d) FILTER (WHERE own <> other), 0) AS b FROM p GROUP BY ALL)
SELECT CAST(seq AS VARCHAR) AS id, CAST(own AS INTEGER) AS cluster_id, round(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS score FROM q""")
def silhouette(spark, sf_dir):
    rows = scaled(flows(spark, sf_dir))
    return rounded(clustering.silhouette(rows, by_remainder(rows)))


@query(f"""{SCALED}, p AS (SELECT a.seq AS a, b.seq AS b FROM scaled a JOIN scaled b ON a.seq <> b.seq WHERE {distance_sql('a', 'b')} <= 0.3),
r(node, low) AS (SELECT seq, seq FROM scaled UNION SELECT p.b, r.low FROM p JOIN r ON p.a = r.node WHERE r.low < p.b), m AS (SELECT node, min(low) AS root FROM r GROUP BY node)
SELECT CAST(node AS VARCHAR) AS id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS cluster_id FROM m""")
def single_linkage(spark, sf_dir):
    """All flows merged up to a height."""
    return linkage.flat(scaled(flows(spark, sf_dir)), 0.3)


_KD = f"kd AS (SELECT a.id, min({distance_sql('a', 'b')}, 5)[5] AS d FROM scaled a JOIN scaled b ON a.seq <> b.seq GROUP BY a.id)"


@query(f"""{SCALED}, r AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS r, count(*) OVER () AS n FROM scaled), t AS (SELECT * FROM r WHERE n <= 200 OR r % CAST(ceil(n / 200) AS BIGINT) = 0),
p AS (SELECT a.seq, a.seq % 3 AS own, b.seq % 3 AS other, avg({distance_sql('a', 'b')}) AS d FROM t a JOIN scaled b ON a.seq <> b.seq GROUP BY ALL),
q AS (SELECT seq, own, coalesce(max(d) FILTER (WHERE own = other), 0) AS a, coalesce(min(d) FILTER (WHERE own <> other), 0) AS b FROM p GROUP BY ALL)
SELECT CAST(seq AS VARCHAR) AS id, CAST(own AS INTEGER) AS cluster_id, round(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS score FROM q""")
def silhouette_sample(spark, sf_dir):
    rows = scaled(flows(spark, sf_dir))
    return rounded(clustering.sampled_silhouette(rows, by_remainder(rows)))


@query(f"""WITH {FLOWS}, r AS (SELECT byte_count AS cut FROM flows ORDER BY byte_count DESC LIMIT 1 OFFSET (SELECT CAST(floor(0.1 * count(*)) AS BIGINT) FROM flows))
SELECT seq, byte_count, byte_count >= cut AS is_top FROM flows, r""")
def rank_threshold(spark, sf_dir):
    """Flows whose bytes reach the rank of a tenth of all flows."""
    return statistics.reaching_rank(flows(spark, sf_dir), "byte_count", 0.1).select("seq", "byte_count", "is_top")


@query(f"{SCALED}, {_KD}, o AS (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM kd) SELECT round(avg(d), 6) AS bandwidth FROM o WHERE i IN ((n + 1) // 2, n // 2 + 1)")
def bandwidth_estimate(spark, sf_dir):
    return spark.createDataFrame([(round(clustering.estimate_bandwidth(scaled(flows(spark, sf_dir))), 6),)], "bandwidth double")


@query(f"""{SCALED}, {_first(3)}, {_nearest(0)}, m AS (SELECT c, avg(d) * 1.2 AS lim FROM n0 GROUP BY c)
SELECT CAST(seq AS VARCHAR) AS id, CAST(n0.c AS INTEGER) AS nearest_id, round(d, 6) AS distance, round(least(1, d / (2 * lim)), 6) AS score, round(least(1, d / lim - 1), 6) AS confidence FROM n0 JOIN m USING (c) WHERE d > lim""")
def cluster_outliers(spark, sf_dir):
    rows = scaled(flows(spark, sf_dir))
    centres = clustering.first_rows(rows, 3)
    assigned = clustering.nearest(rows, centres).select("id", "cluster_id")
    out = detect.cluster_outliers(rows, assigned, centres, NAMES, detect.Thresholds(outlier_factor=1.2))
    return rounded(out.select("id", "nearest_id", "distance", "score", "confidence"))


@query(f"""{_FOUND}, {FEATURES}, {scaled_sql()}, {_first(3)}, {_nearest(0)}, m AS (SELECT c, avg(d) * 1.2 AS lim FROM n0 GROUP BY c),
o AS (SELECT seq, least(1, d / (2 * lim)) AS score FROM n0 JOIN m USING (c) WHERE d > lim AND seq NOT IN (SELECT seq FROM found))
SELECT seq, array_to_string(types, '|') AS types, round(score, 5) AS score, severity FROM found UNION ALL SELECT seq, 'Cluster Outlier', round(score, 5), {_SEVERITY} FROM o""")
def detect_with_outliers(spark, sf_dir):
    """Findings of the rules, and outliers of clusters among the other flows."""
    f = flows(spark, sf_dir)
    rows = scaled(f)
    centres = clustering.first_rows(rows, 3)
    outliers = detect.cluster_outliers(rows, clustering.nearest(rows, centres).select("id", "cluster_id"), centres, NAMES, detect.Thresholds(outlier_factor=1.2))
    return rounded(detect.detect_all(f, outliers, SHOWN).select("seq", F.concat_ws("|", "types").alias("types"), "score", "severity"), 5)


@query(f"""{SCALED}, p AS (SELECT a.seq AS a, b.seq AS b FROM scaled a JOIN scaled b ON a.seq <> b.seq WHERE {distance_sql('a', 'b')} <= 1.0), k AS (SELECT a FROM p GROUP BY a HAVING count(*) >= 5),
l AS (SELECT p.a, p.b FROM p JOIN k ON k.a = p.a JOIN k j ON j.a = p.b), r(node, low) AS (SELECT a, a FROM k UNION SELECT l.b, r.low FROM l JOIN r ON l.a = r.node),
m AS (SELECT node, min(low) AS root FROM r GROUP BY node), i AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS c FROM m), e AS (SELECT p.a, min(i.c) AS c FROM p JOIN i ON i.node = p.b GROUP BY p.a)
SELECT s.id, CAST(coalesce(i.c, e.c, -1) AS INTEGER) AS cluster_id FROM scaled s LEFT JOIN i ON i.node = s.seq LEFT JOIN e ON e.a = s.seq""")
def dbscan(spark, sf_dir):
    return clustering.dbscan(scaled(flows(spark, sf_dir)), 1.0, 5).assignments


@query(f"{SCALED}, {_KD} SELECT id, round(d, 6) AS k_distance FROM kd")
def k_distance(spark, sf_dir):
    return rounded(clustering.k_distances(scaled(flows(spark, sf_dir)), 5))


@query(f"""{SCALED}, {_KD}, o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () - 1 AS n, min(d) OVER () AS lo, max(d) OVER () AS hi FROM kd)
SELECT round(d, 6) AS epsilon FROM o ORDER BY abs((hi - lo) * i - n * (d - lo)) DESC, i LIMIT 1""")
def epsilon_elbow(spark, sf_dir):
    return spark.createDataFrame([(round(clustering.estimate_epsilon(scaled(flows(spark, sf_dir)), 5), 6),)], "epsilon double")


# --- without SQL


@query()
def kmeans_pp(spark, sf_dir):
    return clustering.k_means(scaled(flows(spark, sf_dir)), 5, max_iterations=20).assignments


@query()
def elbow(spark, sf_dir):
    k, inertias = clustering.elbow(scaled(flows(spark, sf_dir)), 6, 8)
    return spark.createDataFrame([(i + 1, float(x), i + 1 == k) for i, x in enumerate(inertias)], "k int, inertia double, chosen boolean")


@query()
def isolation_forest(spark, sf_dir):
    found = clustering.isolation_forest(scaled(flows(spark, sf_dir)))
    return found.assignments.join(found.scores, "id")


@query()
def mean_shift(spark, sf_dir):
    return clustering.mean_shift(scaled(flows(spark, sf_dir)), 1.0, 50).assignments


@query()
def agglomerative(spark, sf_dir):
    return clustering.hierarchical_of_centres(scaled(flows(spark, sf_dir)), 4, "average").assignments


@query()
def gmm(spark, sf_dir):
    return clustering.gaussian_mixture(scaled(flows(spark, sf_dir)), 3, 15).assignments


@query()
def som(spark, sf_dir):
    return clustering.self_organizing_map(scaled(flows(spark, sf_dir)), 3, 10).assignments


@query()
def pca_projection(spark, sf_dir):
    return reduction.pca(features(flows(spark, sf_dir), "id"), 2)[0]


@query()
def pca_reconstruction(spark, sf_dir):
    return reduction.reconstruction_error(features(flows(spark, sf_dir), "id"))


@query("""SELECT * FROM (VALUES (1, 'eth0', 'Wired'), (2, 'lo', NULL)) t(number, name, description)""")
def capture_interfaces(spark, sf_dir):
    return capture.interfaces(spark.createDataFrame([("1. eth0 (Wired)",), ("2. lo",), ("no interface",)], "value string"))


@query()
def viewport(spark, sf_dir):
    points, _ = reduction.pca(features(flows(spark, sf_dir), "id"), 3, scale="z_score")
    return reduction.to_range(points, ["pc0", "pc1", "pc2"], -5.0, 5.0, flip="pc1")


@query()
def tsne(spark, sf_dir):
    return reduction.tsne_of_landmarks(scaled(flows(spark, sf_dir)))


@query()
def cluster_hull(spark, sf_dir):
    rows = features(flows(spark, sf_dir), "seq", "id")
    points, _ = reduction.pca(rows, 2)
    return reduction.cluster_hulls(points.join(by_remainder(rows), "id").select("cluster_id", F.col("pc0").alias("x"), F.col("pc1").alias("y")))


# --- generated flows: every draw is a digest's first 52 bits, which SQL repeats by the draw's number


def _unit(n: int, seed: int = 0, row: str = "seq") -> str:
    return f"(CAST(CAST('0x' || substr(md5({row} || '-{seed}-{n}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496)"


def _whole(n: int, low: int, high: int, *of) -> str:
    return f"CAST({low} + floor({_unit(n, *of)} * {high - low + 1}) AS BIGINT)"


def _pick(n: int, values, *of) -> str:
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{listed}])[{_whole(n, 1, len(values), *of)}]"


def _private(n: int, *of) -> str:
    """Draws n to n + 8."""
    w = lambda i, low, high: _whole(n + i, low, high, *of)
    ten = f"'10.' || {w(0, 0, 255)} || '.' || {w(1, 0, 255)} || '.' || {w(2, 1, 254)}"
    middle = f"'172.' || {w(3, 16, 31)} || '.' || {w(4, 0, 255)} || '.' || {w(5, 1, 254)}"
    return f"([{ten}, {middle}, '192.168.' || {w(6, 0, 255)} || '.' || {w(7, 1, 254)}])[{w(8, 1, 3)}]"


def _public(n: int, *of) -> str:
    """Draws n to n + 3."""
    first, second = _pick(n, generator.FIRST_OCTETS, *of), _whole(n + 1, 0, 255, *of)
    beside = f"CASE WHEN {first} = 172 AND {second} BETWEEN 16 AND 31 THEN {second} + 16 WHEN {first} = 192 AND {second} = 168 THEN 169 ELSE {second} END"
    return f"{first} || '.' || {beside} || '.' || {_whole(n + 2, 0, 255, *of)} || '.' || {_whole(n + 3, 1, 254, *of)}"


def _kinds(normal: str, other: str, high: str, scan: str, flood: str) -> str:
    return f"CASE WHEN kind = 'High Volume' THEN {high} WHEN kind = 'Port Scan' THEN {scan} WHEN kind = 'DDoS Attack' THEN {flood} WHEN kind IS NULL THEN {normal} ELSE {other} END"


def _generated(rows: str, **fixed: str) -> str:
    """Flows from SQL of rows seq, ts_ms, kind."""
    ports = {name: [p for p, n in _tables()[1].items() if n == name] for name in _tables()[1].values()}
    known = "CASE protocol " + " ".join(f"WHEN '{n}' THEN ({p})[CAST(1 + floor({_unit(39)} * {len(p)}) AS BIGINT)]" for n, p in ports.items()) + " END"
    packets = _kinds(_whole(6, 1, 100), _whole(5, 100, 1099), _whole(2, 5000, 14999), _whole(3, 50, 149), _whole(4, 50000, 149999))
    size = _kinds(_whole(9, 64, 563), _whole(8, 100, 1099), _whole(7, 500, 1999), "64", "100")
    r = _unit(42)
    mixed = lambda n, chance: f"({r} >= 0.9 AND {_unit(n)} < {chance})"
    flags = {
        "syn": f"{r} < 0.3 OR {mixed(43, 0.2)}",
        "ack": f"({r} >= 0.3 AND {r} < 0.8) OR {mixed(44, 0.7)}",
        "fin": f"({r} >= 0.6 AND {r} < 0.8) OR {mixed(45, 0.1)}",
        "rst": f"({r} >= 0.8 AND {r} < 0.9) OR {mixed(46, 0.05)}",
        "psh": f"({r} >= 0.3 AND {r} < 0.6 AND {_unit(47)} < 0.5) OR {mixed(48, 0.4)}",
        "urg": mixed(49, 0.02),
    }
    cities = "CASE country " + " ".join(f"WHEN '{c}' THEN {_pick(53, names)}" for c, names in generator.CITIES.items()) + " END"
    drawn = {
        "source_ip": f"CASE WHEN {_unit(10)} < 0.7 THEN {_private(11)} ELSE {_public(20)} END",
        "destination_ip": f"CASE WHEN {_unit(24)} < 0.5 THEN {_private(25)} ELSE {_public(34)} END",
        "source_port": _whole(38, 1, 65535),
        "destination_port": f"coalesce({known}, {_whole(40, 1, 65535)})",
        "packet_count": packets,
        "byte_count": f"({packets}) * ({size})",
        "duration": f"round({_unit(41)} * {_kinds('60', '300', '60', '10', '5')}, 6)",
        **{n: f"(protocol IN ('TCP', 'HTTP', 'HTTPS') AND ({c}))" for n, c in flags.items()},
        "ttl": _pick(50, [32, 64, 128, 255]),
        "window_size": _whole(51, 1, 65535),
        "city": cities,
        "latitude": f"round(({_unit(54)} - 0.5) * 180, 6)",
        "longitude": f"round(({_unit(55)} - 0.5) * 360, 6)",
        "asn": f"'AS' || {_whole(56, 1000, 60999)}",
        "isp": f"'ISP-' || {_whole(57, 0, 999)}",
    }
    named = f"SELECT *, {_pick(1, generator.PROTOCOLS)} AS protocol, {_pick(52, list(generator.CITIES))} AS country FROM ({rows})"
    return "SELECT seq, ts_ms, kind, protocol, country, " + ", ".join(f"{fixed.get(n, c)} AS {n}" for n, c in drawn.items()) + f" FROM ({named})"


def _flat(df: DataFrame) -> DataFrame:
    kind = F.get("anomaly_type", F.lit(0)).alias("kind")
    numbers = [F.col(c).cast("long").alias(c) for c in ("source_port", "destination_port", "window_size")]
    return rounded(df.select(kind, *numbers, "seq", "ts_ms", "protocol", "source_ip", "destination_ip", "packet_count", "byte_count", "duration", "ttl", "flags.*", "geo.*"))


def _rows_sql(n: int, ts_ms: str, kind: str) -> str:
    return _generated(f"SELECT range AS seq, {ts_ms} AS ts_ms, {kind} AS kind FROM range({n})")


_ANY_TIME = _whole(1, 0, 3_599_999, 1, "range")


@query(_rows_sql(2000, _ANY_TIME, f"CASE WHEN {_unit(2, 1, 'range')} < 0.05 THEN {_pick(3, generator.ANOMALIES, 1, 'range')} END"))
def generate_flows(spark, sf_dir):
    return _flat(generator.generate(spark, 2000))


def _phases_sql() -> str:
    """Five phases of twelve minutes at 100 flows a minute times their rates."""
    begin, cases = 0, ""
    for i, (_, rate) in enumerate(generator.PHASES):
        begin += round(1200 * rate)
        cases += f" WHEN range < {begin} THEN {720_000 * i} + {_whole(2 + i, 0, 719_999, 1, 'range')}"
    return _rows_sql(begin + begin // 50, f"CASE{cases} ELSE {_ANY_TIME} END", f"CASE WHEN range >= {begin} THEN {_pick(7, generator.ANOMALIES, 1, 'range')} END")


@query(f"SELECT seq, ts_ms, kind, protocol, byte_count, source_ip FROM ({_phases_sql()})")
def diurnal_flows(spark, sf_dir):
    return _flat(generator.diurnal(spark)).select("seq", "ts_ms", "kind", "protocol", "byte_count", "source_ip")


_ATTACKS = {
    "DDoS Attack": (1000, {"destination_ip": "'203.0.113.9'"}),
    "Port Scan": (1000, {"source_ip": _public(1, 2, "'0'"), "destination_ip": "'203.0.113.9'", "destination_port": _whole(2, 1, 65535, 1)}),
    "Data Exfiltration": (100, {"source_ip": _private(5, 2, "'0'")}),
}


def _attack_sql(kind: str, n: int, fixed: dict) -> str:
    rows = f"SELECT range AS seq, {_whole(1, 0, 59_999, 1, 'range')} AS ts_ms, '{kind}' AS kind FROM range({n})"
    return f"SELECT seq, ts_ms, kind, source_ip, destination_ip, destination_port, byte_count FROM ({_generated(rows, **fixed)})"


@query(" UNION ALL ".join(_attack_sql(k, n, fixed) for k, (n, fixed) in _ATTACKS.items()))
def attack_pattern(spark, sf_dir):
    parts = [_flat(generator.attack(spark, k, "203.0.113.9")) for k in _ATTACKS]
    return parts[0].union(parts[1]).union(parts[2]).select("seq", "ts_ms", "kind", "source_ip", "destination_ip", "destination_port", "byte_count")


_DELETED = ("10.0.0.1", "198.51.100.3")


@query(f"""WITH {FLOWS}, m AS (SELECT min(seq) AS seq, source_ip AS id, avg(duration) / 100 AS quality FROM flows GROUP BY source_ip HAVING source_ip NOT IN {_DELETED})
SELECT count(*) AS n_models, round(avg(quality), 6) AS avg_quality, arg_min(id, (-quality, seq)) AS best, arg_max(id, seq) AS latest FROM m""")
def model_statistics(spark, sf_dir):
    """A registry with a model per source, saved, read, without two that were deleted, summed up."""
    path = scratch(spark)
    rows = flows(spark, sf_dir).groupBy("source_ip").agg(F.min("seq").alias("seq"), (F.avg("duration") / 100).alias("quality"))
    none = lambda t: F.lit(None).cast(t)
    models.save(rows.select("seq", F.col("source_ip").alias("id"), F.lit("baseline").alias("name"), none("long").alias("trained_at_ms"), *[none("double").alias(c) for c in ("silhouette", "test_silhouette", "noise_share")], "quality", F.lit("{}").alias("parameters")), path)
    return rounded(models.statistics(models.without(models.load(spark, path), *_DELETED)))


@query()
def train_models(spark, sf_dir):
    rows = models.compare(flows(spark, sf_dir), [("K-Means++", {"k": 3, "max_iterations": 5}), ("Gaussian Mixture Model", {"k": 3, "max_iterations": 5}), ("Spectral", {})])
    return rows.drop("trained_at_ms", "id")


@query(f"""WITH {FLOWS}, p AS (SELECT *, CASE WHEN protocol = 'UDP' THEN 'UDP' ELSE 'TCP' END AS transport FROM flows WHERE protocol <> 'ICMP'),
q AS (SELECT *, coalesce({_port_case('destination_port', _tables()[0])}, {_port_case('source_port', _tables()[0])}, transport) AS app, greatest(byte_count, CASE transport WHEN 'TCP' THEN 54 ELSE 42 END) AS length FROM p)
SELECT source_ip, destination_ip, app AS protocol, CAST(sum(length) AS BIGINT) AS byte_count, arg_min(ts_ms, seq) AS ts_ms FROM q GROUP BY source_ip, source_port, destination_ip, destination_port, app""")
def pcap_import(spark, sf_dir):
    """All flows written as captures, read back and merged; the reader leaves ICMP packets out."""
    from tidewire.sources.pcap import hosts, read_pcap, write_pcap

    path, f = scratch(spark), flows(spark, sf_dir)
    names = hosts(f)
    write_pcap(f, path, hosts=names)
    got = read_pcap(spark, path, hosts=names)
    order = browse.numbered(got, "path", "offset", name="seq")
    return statistics.merge_flows(order.drop("path", "offset")).select("source_ip", "destination_ip", "protocol", "byte_count", "ts_ms")


@query(f"""WITH {FLOWS} SELECT count(*) AS total_flows, CAST(sum(coalesce(nullif(byte_count, 0), 64)) AS BIGINT) AS total_bytes, count(*) AS total_packets,
CAST(0 AS DOUBLE) AS avg_duration, least(count(*), 1000) AS served_flows FROM flows""")
def stream_stats(spark, sf_dir):
    """Capture lines as a stream: totals of all flows that it appended, and how many the serving tables hold in the end."""
    from tidewire.streaming.live import read_lines, served, start

    path = scratch(spark)
    tsv_lines(spark, sf_dir).select("value").repartition(4).write.text(f"{path}/lines")
    running = start(read_lines(spark, f"{path}/lines", 2), f"{path}/out", f"{path}/state", seconds=0)
    running.processAllAvailable()
    running.stop()
    count = served(spark, f"{path}/out", "totals").select(F.col("total_flows").alias("served_flows"))
    return rounded(statistics.totals(spark.read.parquet(f"{path}/out/flows"))).join(count)


#: Slices of time in which streams are replayed.
SLICES = 3


def sliced(df: DataFrame) -> list[DataFrame]:
    """The rows of equal spans of time, in their order."""
    first, last = df.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    bounds = [first + (last + 1 - first) * i // SLICES for i in range(SLICES + 1)]
    return [df.filter(F.col("ts_ms").between(a, b - 1)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_SLICED = f"x AS (SELECT f.*, (SELECT count(*) FROM range(1, {SLICES}) WHERE f.ts_ms >= t0 + (t1 + 1 - t0) * range // {SLICES}) AS slice FROM flows f, (SELECT min(ts_ms) AS t0, max(ts_ms) AS t1 FROM flows))"


@query(f"""WITH {FLOWS}, p AS (SELECT *, {_PROTO} AS n FROM flows ORDER BY ts_ms DESC LIMIT 1000),
q AS (SELECT ts_ms, source_ip, CASE WHEN n IN (6, 17) THEN source_port ELSE 0 END AS sp, CASE WHEN n IN (6, 17) THEN destination_port ELSE 0 END AS dp, n, coalesce(nullif(byte_count, 0), 64) AS bytes FROM p),
r AS (SELECT *, CASE WHEN n IN (6, 17) THEN coalesce({_port_case('dp', _tables()[0])}, {_port_case('sp', _tables()[0])}, CASE n WHEN 6 THEN 'TCP' ELSE 'UDP' END) WHEN n = 1 THEN 'ICMP' ELSE 'OTHER' END AS protocol FROM q),
b AS (SELECT min(ts_ms) AS t0, max(ts_ms) AS t1, greatest(60000, (max(ts_ms) - min(ts_ms)) // 100) AS w FROM r), c AS (SELECT (ts_ms - t0) // w AS i, count(*) AS f, sum(bytes) AS s FROM r, b GROUP BY 1)
SELECT 'totals' AS "table", 'all' AS key, count(*) AS flow_count, CAST(sum(bytes) AS BIGINT) AS byte_count FROM r UNION ALL SELECT 'protocols', protocol, count(*), 0 FROM r GROUP BY protocol
UNION ALL SELECT 'ports', CAST(dp AS VARCHAR), count(*), 0 FROM r GROUP BY dp UNION ALL (SELECT 'talkers', source_ip, count(*), CAST(sum(bytes) AS BIGINT) FROM r GROUP BY source_ip ORDER BY sum(bytes) DESC LIMIT 10)
UNION ALL SELECT 'series', CAST(t0 + g.i * w AS VARCHAR), coalesce(f, 0), CAST(coalesce(s, 0) AS BIGINT) FROM (SELECT unnest(range(0, (t1 - t0) // w + 1)) AS i, t0, w FROM b) g LEFT JOIN c ON g.i = c.i""")
def stream_serving(spark, sf_dir):
    """All serving tables after capture lines came in slices of time, with a new start of the stream between them."""
    from tidewire.streaming.live import read_lines, served, start

    path = scratch(spark)
    times = tsv_lines(spark, sf_dir).join(flows(spark, sf_dir).select("seq", "ts_ms"), "seq")
    times.limit(0).select("value").write.text(f"{path}/lines")
    for part in sliced(times):
        part.select("value").write.mode("append").text(f"{path}/lines")
        running = start(read_lines(spark, f"{path}/lines"), f"{path}/out", f"{path}/state", seconds=0)
        running.processAllAvailable()
        running.stop()
    of = lambda name: served(spark, f"{path}/out", name)
    none = F.lit(0).cast("long")  # these tables have no bytes
    shown = {
        "totals": (F.lit("all"), F.col("total_flows"), F.col("total_bytes")),
        "protocols": (F.col("protocol"), F.col("flow_count"), none),
        "ports": (F.col("destination_port").cast("string"), F.col("flow_count"), none),
        "talkers": (F.col("source_ip"), F.col("flow_count"), F.col("byte_count")),
        "series": (F.col("start_ms").cast("string"), F.col("flow_count"), F.col("byte_count")),
    }
    parts = [of(name).select(F.lit(name).alias("table"), key.alias("key"), n.alias("flow_count"), size.alias("byte_count")) for name, (key, n, size) in shown.items()]
    return functools.reduce(DataFrame.union, parts)


def _mini_batches_sql(k: int, decay: float) -> str:
    """Centres after each slice, scaled by the first slice's minima and maxima."""
    bounds = ", ".join(f"min({n}) FILTER (WHERE slice = 0) OVER () AS lo_{n}, max({n}) FILTER (WHERE slice = 0) OVER () AS hi_{n}" for n in NAMES)
    scaled_ = ", ".join(f"CASE WHEN hi_{n} > lo_{n} THEN ({n} - lo_{n}) / (hi_{n} - lo_{n}) ELSE 0.0 END AS {n}" for n in NAMES)
    ctes = [FLOWS, _SLICED, FEATURES, f"b AS (SELECT feats.*, slice, {bounds} FROM feats JOIN x USING (seq))", f"scaled AS (SELECT seq, slice, {scaled_} FROM b)"]
    ctes.append(f"c0 AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS c, 0.0 AS weight, * EXCLUDE (seq, slice) FROM scaled WHERE slice = 0 ORDER BY seq LIMIT {k})")
    for i in range(SLICES):
        d = distance_sql("s", "c")
        ctes.append(f"n{i} AS (SELECT s.*, c.c FROM scaled s CROSS JOIN c{i} c WHERE s.slice = {i} QUALIFY row_number() OVER (PARTITION BY s.seq ORDER BY {d}, c.c) = 1)")
        w = f"({decay} * any_value(c.weight) + count(n.c))"
        means = ", ".join(f"CASE WHEN {w} > 0 THEN ({decay} * any_value(c.weight) * any_value(c.{n}) + coalesce(sum(n.{n}), 0)) / {w} ELSE any_value(c.{n}) END AS {n}" for n in NAMES)
        ctes.append(f"c{i + 1} AS (SELECT c.c, {w} AS weight, {means} FROM c{i} c LEFT JOIN n{i} n ON n.c = c.c GROUP BY c.c)")
    return "WITH " + ", ".join(ctes) + f" SELECT CAST(c AS INTEGER) AS cluster_id, round(CAST(weight AS DOUBLE), 6) AS weight, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)} FROM c{SLICES}"


@query(_mini_batches_sql(4, 0.8))
def stream_clusters(spark, sf_dir):
    """Centres kept by a stream of flows that come in slices of time, with a new start of the stream between them."""
    from tidewire.streaming.live import served, start_clusters

    path = scratch(spark)
    f = flows(spark, sf_dir)
    f.limit(0).write.parquet(f"{path}/flows")
    for part in sliced(f):
        part.write.mode("append").parquet(f"{path}/flows")
        running = start_clusters(spark.readStream.schema(f.schema).parquet(f"{path}/flows"), f"{path}/out", f"{path}/state", 4, 0.8, 0)
        running.processAllAvailable()
        running.stop()
    got = served(spark, f"{path}/out", "clusters")
    return rounded(got.select("cluster_id", "weight", *[F.col("centre")[i].alias(n) for i, n in enumerate(NAMES)]))


HOUR_MS, LATE_MS = 3_600_000, 300_000
#: Every metric and operator; windows without flows count where `quiet` and `cluster` are judged.
ALERTS = [
    Rule("busy", "flow_count", ">", 20, HOUR_MS, 2 * HOUR_MS, "high", "Busy hour"),
    Rule("quiet", "flow_count", "<=", 0, HOUR_MS // 6, HOUR_MS, "low"),
    Rule("bytes", "byte_count", ">=", 1_500_000, HOUR_MS),
    Rule("packets", "packet_count", ">", 400, HOUR_MS // 4, HOUR_MS // 2, "critical"),
    Rule("anomaly", "anomaly_count", "=", 1, HOUR_MS // 2, 24 * HOUR_MS),
    Rule("web", "protocol_ratio", ">=", 0.5, HOUR_MS, 6 * HOUR_MS, of="HTTP"),
    Rule("cluster", "cluster_density", "<", 0.2, 2 * HOUR_MS, 12 * HOUR_MS, of=0),
    Rule("off", "flow_count", ">", 0, HOUR_MS, enabled=False),
]


def _alerts_sql() -> str:
    """Each rule's windows without gaps, those that hold, and of these the first and then each one after a cooldown."""
    of = {"flow_count": "count(ts_ms)", "byte_count": "coalesce(sum(byte_count), 0)", "packet_count": "coalesce(sum(packet_count), 0)", "anomaly_count": "count(*) FILTER (WHERE is_anomaly)"}
    parts = []
    for r in ALERTS:
        if r.enabled:
            column = {"protocol_ratio": "protocol", "cluster_density": "cluster"}.get(r.metric)
            value = of.get(r.metric) or f"coalesce(count(*) FILTER (WHERE {column} = {r.of!r}) / nullif(count(ts_ms), 0), 0)"
            spine = f"SELECT unnest(range(t0 // {r.window_ms} * {r.window_ms}, (t1 - {LATE_MS}) // {r.window_ms} * {r.window_ms}, {r.window_ms})) AS s FROM b"
            parts.append(f"SELECT '{r.id}' AS rule, '{r.name or r.id}' AS name, '{r.severity}' AS severity, '{r.metric}' AS metric, s AS window_start, s + {r.window_ms} AS window_end, CAST({value} AS DOUBLE) AS value, CAST({r.threshold} AS DOUBLE) AS threshold, {r.cooldown_ms} AS cooldown FROM ({spine}) LEFT JOIN x ON ts_ms // {r.window_ms} * {r.window_ms} = s GROUP BY s HAVING {value} {r.operator} {r.threshold}")
    return f"""WITH RECURSIVE {FLOWS}, x AS (SELECT *, seq % 3 AS cluster FROM flows), b AS (SELECT min(ts_ms) AS t0, max(ts_ms) AS t1 FROM flows), held AS ({" UNION ALL ".join(parts)}),
following AS (SELECT h.rule, h.window_end, min(i.window_end) AS n FROM held h JOIN held i ON h.rule = i.rule AND i.window_end > h.window_end AND i.window_end >= h.window_end + h.cooldown GROUP BY ALL),
fired(rule, e) AS (SELECT rule, min(window_end) FROM held GROUP BY rule UNION ALL SELECT f.rule, n FROM fired f JOIN following g ON f.rule = g.rule AND f.e = g.window_end)
SELECT rule, name, severity, metric, window_start, window_end, round(value, 6) AS value, threshold FROM held JOIN fired USING (rule) WHERE window_end = e"""


@query(_alerts_sql())
def alert_rules(spark, sf_dir):
    """Flows replayed in slices of time; after each the query is stopped and started again from its checkpoint."""
    from tidewire.streaming.alerts import ALERT, start_alerts

    path = scratch(spark)
    f = flows(spark, sf_dir).select("ts_ms", "byte_count", "packet_count", "is_anomaly", "protocol", (F.col("seq") % 3).cast("int").alias("cluster_id"))
    f.limit(0).write.parquet(f"{path}/flows")
    for part in sliced(f):
        part.write.mode("append").parquet(f"{path}/flows")
        running = start_alerts(spark.readStream.schema(f.schema).parquet(f"{path}/flows"), ALERTS, f"{path}/alerts", f"{path}/state", f"{LATE_MS} milliseconds", 0)
        running.processAllAvailable()
        running.stop()
    return rounded(spark.read.schema(ALERT).parquet(f"{path}/alerts"))


@query(f"WITH {FLOWS} SELECT seq, id, source_ip, destination_ip, byte_count FROM flows WHERE is_anomaly")
def flagged_flows(spark, sf_dir):
    return flows(spark, sf_dir).filter("is_anomaly").select("seq", "id", "source_ip", "destination_ip", "byte_count")


@query(f"WITH {FLOWS} SELECT seq, source_ip, protocol FROM flows WHERE seq % 3 = 2")
def cluster_flows(spark, sf_dir):
    f = flows(spark, sf_dir)
    members = by_remainder(f).filter("cluster_id = 2").select("id")
    return f.join(members, "id", "left_semi").select("seq", "source_ip", "protocol")


@query(f"""WITH {FLOWS} SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "Timestamp", source_ip AS "Source IP", CAST(source_port AS VARCHAR) AS "Source Port", destination_ip AS "Destination IP",
CAST(destination_port AS VARCHAR) AS "Destination Port", protocol AS "Protocol", CAST(byte_count AS VARCHAR) AS "Bytes", CAST(packet_count AS VARCHAR) AS "Packets", round(duration, 6) AS "Duration", CASE WHEN is_anomaly THEN 'Yes' ELSE 'No' END AS "Anomaly" FROM flows""")
def display_csv(spark, sf_dir):
    path = scratch(spark)
    sinks.write_display_csv(flows(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path).withColumn("Duration", F.round(F.col("Duration").cast("double"), 6))


@query(f"""WITH {FLOWS}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE is_anomaly) AS a FROM flows), t AS (SELECT * FROM flows ORDER BY seq LIMIT 10)
SELECT 'Total Flows: ' || n AS line FROM n UNION ALL SELECT 'Anomalies: ' || a FROM n UNION ALL SELECT 'Clusters: 0' UNION ALL SELECT '- ' || id || ' (' || source_ip || ' → ' || destination_ip || ')' FROM t""")
def report_lines(spark, sf_dir):
    """The figures and the first ten flows of a report."""
    f = flows(spark, sf_dir)
    text = sinks.report("Traffic", [("summary", "Summary"), ("flows", "Flows")], f, f.filter("is_anomaly"))
    lines = [(x,) for x in text.splitlines() if x and not x.startswith("#") and x != "Flows:"]
    return spark.createDataFrame(lines, "line string")
