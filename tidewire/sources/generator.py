"""Synthetic flows for tests and demonstrations: seeded, distributed, without loops over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.network import SIMULATED_PORTS

# What simulated flows are of.
PROTOCOLS = ("TCP", "UDP", "ICMP", "HTTP", "HTTPS", "DNS", "FTP")
ANOMALIES = ("High Volume", "Port Scan", "DDoS Attack", "Data Exfiltration", "Suspicious Protocol")
# Phases of a day as (share of the duration, rate).
PHASES = ((0.2, 0.5), (0.2, 1.5), (0.2, 1.0), (0.2, 2.0), (0.2, 0.3))
# Places of simulated addresses.
CITIES = {
    "US": ("New York", "Los Angeles", "Chicago", "Houston", "Phoenix"),
    "CN": ("Beijing", "Shanghai", "Guangzhou", "Shenzhen", "Chengdu"),
    "RU": ("Moscow", "Saint Petersburg", "Novosibirsk", "Yekaterinburg", "Kazan"),
    "DE": ("Berlin", "Hamburg", "Munich", "Cologne", "Frankfurt"),
    "GB": ("London", "Manchester", "Birmingham", "Leeds", "Glasgow"),
    "FR": ("Paris", "Marseille", "Lyon", "Toulouse", "Nice"),
    "JP": ("Tokyo", "Yokohama", "Osaka", "Nagoya", "Sapporo"),
    "BR": ("São Paulo", "Rio de Janeiro", "Brasília", "Salvador", "Fortaleza"),
    "IN": ("Mumbai", "Delhi", "Bangalore", "Hyderabad", "Chennai"),
    "KR": ("Seoul", "Busan", "Incheon", "Daegu", "Daejeon"),
}


class Draw:
    """Uniform numbers by the MD5 digest of a row's number, the seed and the draw's number: the same whatever the
    partitions are, and in any engine."""

    def __init__(self, seed: int, row: str = "seq"):
        self.seed, self.row, self.n = seed, row, 0

    def unit(self) -> Column:
        self.n += 1
        digest = F.md5(F.concat_ws("-", F.col(self.row).cast("string"), F.lit(str(self.seed)), F.lit(str(self.n))))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)

    def whole(self, low: int | Column, high: int | Column) -> Column:
        """low to high, both included"""
        low = F.lit(low) if isinstance(low, int) else low
        return (low + F.floor(self.unit() * (high - low + 1))).cast("long")

    def pick(self, values) -> Column:
        return F.element_at(F.array(*[F.lit(v) if isinstance(v, (str, int)) else v for v in values]), self.whole(1, len(values)).cast("int"))


def private_ip(d: Draw) -> Column:
    """One of the three private ranges."""
    dotted = lambda *p: F.concat_ws(".", *[x.cast("string") for x in p])
    return d.pick([dotted(F.lit(10), d.whole(0, 255), d.whole(0, 255), d.whole(1, 254)), dotted(F.lit(172), d.whole(16, 31), d.whole(0, 255), d.whole(1, 254)), dotted(F.lit(192), F.lit(168), d.whole(0, 255), d.whole(1, 254))])


#: First octets of public addresses; 172 and 192 are public but for a part.
FIRST_OCTETS = [x for x in range(1, 224) if x not in (10, 127)]


def public_ip(d: Draw) -> Column:
    """Any address that isn't private, loopback or multicast; a draw from 172.16-31 or 192.168 lands beside it."""
    first, second = F.element_at(F.array(*map(F.lit, FIRST_OCTETS)), d.whole(1, len(FIRST_OCTETS)).cast("int")), d.whole(0, 255)
    second = F.when((first == 172) & second.between(16, 31), second + 16).when((first == 192) & (second == 168), second + 1).otherwise(second)
    return F.concat_ws(".", first, second, d.whole(0, 255), d.whole(1, 254))


def port_of(d: Draw, protocol: Column) -> Column:
    """A well-known port of the protocol, else any."""
    by_name = {name: [p for p, n in SIMULATED_PORTS.items() if n == name] for name in SIMULATED_PORTS.values()}
    known = F.create_map(*[x for name, ports in by_name.items() for x in (F.lit(name), F.array(*map(F.lit, ports)))])[protocol]
    some = F.get(known, F.floor(d.unit() * F.size(known)).cast("int"))
    return F.coalesce(some, d.whole(1, 65535)).cast("int")


def flags_of(d: Draw, protocol: Column) -> Column:
    """The shares of the kinds of segments."""
    r, bit = d.unit(), lambda chance: d.unit() < chance
    tcp = protocol.isin("TCP", "HTTP", "HTTPS")
    mixed = r >= 0.9
    flags = {
        "syn": (r < 0.3) | (mixed & bit(0.2)),
        "ack": ((r >= 0.3) & (r < 0.8)) | (mixed & bit(0.7)),
        "fin": ((r >= 0.6) & (r < 0.8)) | (mixed & bit(0.1)),
        "rst": ((r >= 0.8) & (r < 0.9)) | (mixed & bit(0.05)),
        "psh": ((r >= 0.3) & (r < 0.6) & bit(0.5)) | (mixed & bit(0.4)),
        "urg": mixed & bit(0.02),
    }
    return F.struct(*[(tcp & c).alias(n) for n, c in flags.items()])


def place_of(d: Draw) -> Column:
    country = d.pick(list(CITIES))
    cities = F.create_map(*[x for c, names in CITIES.items() for x in (F.lit(c), F.array(*map(F.lit, names)))])[country]
    return F.struct(country.alias("country"), F.element_at(cities, d.whole(1, 5).cast("int")).alias("city"), ((d.unit() - 0.5) * 180).alias("latitude"), ((d.unit() - 0.5) * 360).alias("longitude"), F.concat(F.lit("AS"), d.whole(1000, 60999)).alias("asn"), F.concat(F.lit("ISP-"), d.whole(0, 999)).alias("isp"))


def as_flows(rows: DataFrame, seed: int = 0, **fixed: Column) -> DataFrame:
    """Flows from rows of seq, ts_ms and kind (an anomaly's type or null); fixed columns replace drawn ones.

    Fixed values: the ranges of packets, sizes and durations of each kind."""
    d, kind = Draw(seed), F.col("kind")
    by_kind = lambda hv, ps, dd, other, normal: F.when(kind == "High Volume", hv).when(kind == "Port Scan", ps).when(kind == "DDoS Attack", dd).when(kind.isNotNull(), other).otherwise(normal)
    rows = rows.withColumn("protocol", fixed.get("protocol", d.pick(PROTOCOLS)))
    rows = rows.withColumn("packet_count", by_kind(d.whole(5000, 14999), d.whole(50, 149), d.whole(50000, 149999), d.whole(100, 1099), d.whole(1, 100)))
    size = by_kind(d.whole(500, 1999), F.lit(64), F.lit(100), d.whole(100, 1099), d.whole(64, 563))
    either = lambda chance: F.when(d.unit() < chance, private_ip(d)).otherwise(public_ip(d))
    drawn = {
        "id": F.concat_ws("-", F.lit("flow"), F.lit(seed), "seq"),
        "source_ip": either(0.7),
        "destination_ip": either(0.5),
        "source_port": d.whole(1, 65535).cast("int"),
        "destination_port": port_of(d, F.col("protocol")),
        "byte_count": F.col("packet_count") * size,
        "duration": d.unit() * by_kind(F.lit(60), F.lit(10), F.lit(5), F.lit(300), F.lit(60)),
        "flags": flags_of(d, F.col("protocol")),
        "ttl": d.pick([32, 64, 128, 255]),
        "window_size": d.whole(1, 65535).cast("int"),
        "is_anomaly": kind.isNotNull(),
        "anomaly_type": F.when(kind.isNotNull(), F.array(kind)),
        "geo": place_of(d),
    }
    return rows.select("seq", "ts_ms", "protocol", "packet_count", *[fixed.get(n, c).alias(n) for n, c in drawn.items()])


def generate(spark: SparkSession, count: int, start_ms: int = 0, duration_ms: int = 3_600_000, anomaly_share: float = 0.05, seed: int = 0) -> DataFrame:
    d = Draw(seed + 1)
    rows = spark.range(count).withColumnRenamed("id", "seq").withColumn("ts_ms", F.lit(start_ms) + d.whole(0, duration_ms - 1))
    return as_flows(rows.withColumn("kind", F.when(d.unit() < anomaly_share, d.pick(ANOMALIES))), seed)


def diurnal(spark: SparkSession, start_ms: int = 0, duration_ms: int = 3_600_000, per_minute: int = 100, seed: int = 0) -> DataFrame:
    """Five phases of different rates, and two anomalies per hundred flows."""
    d, counts = Draw(seed + 1), []
    at = 0.0
    for share, rate in PHASES:
        counts.append((start_ms + int(at * duration_ms), int(share * duration_ms), int(per_minute * rate * share * duration_ms / 60_000 + 1e-9)))
        at += share
    total = sum(c for _, _, c in counts)
    rows = spark.range(total + total // 50).withColumnRenamed("id", "seq")
    ts, begin = F.lit(start_ms) + d.whole(0, duration_ms - 1), 0
    for first, length, count in counts:
        ts = F.when((F.col("seq") >= begin) & (F.col("seq") < begin + count), F.lit(first) + d.whole(0, length - 1)).otherwise(ts)
        begin += count
    return as_flows(rows.withColumn("ts_ms", ts).withColumn("kind", F.when(F.col("seq") >= total, d.pick(ANOMALIES))), seed)


def attack(spark: SparkSession, kind: str, target: str, start_ms: int = 0, duration_ms: int = 60_000, intensity: int = 1000, seed: int = 0) -> DataFrame:
    """Many sources to one target, one source to many ports, one insider's transfers (a tenth as many), or any other kind."""
    d, one = Draw(seed + 1), Draw(seed + 2, "attack")
    rows = spark.range(intensity // 10 if kind == "Data Exfiltration" else intensity).withColumnRenamed("id", "seq")
    rows = rows.withColumn("ts_ms", F.lit(start_ms) + d.whole(0, duration_ms - 1)).withColumn("kind", F.lit(kind)).withColumn("attack", F.lit(0))
    fixed = {
        "DDoS Attack": {"destination_ip": F.lit(target)},
        "Port Scan": {"source_ip": public_ip(one), "destination_ip": F.lit(target), "destination_port": d.whole(1, 65535).cast("int")},
        "Data Exfiltration": {"source_ip": private_ip(one)},
    }
    return as_flows(rows, seed, **fixed.get(kind, {}))


def inject(flows: DataFrame, now_ms: int, seed: int = 0) -> DataFrame:
    """Five marked test flows after the others."""
    spark = flows.sparkSession
    d = Draw(seed)
    last = flows.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last")).first().last
    rows = spark.range(5).withColumnRenamed("id", "seq").withColumn("ts_ms", F.lit(now_ms)).withColumn("kind", F.lit("injected"))
    fixed = {"id": F.concat(F.lit(f"anomaly-{now_ms}-"), "seq"), "protocol": F.lit("TCP"), "source_ip": F.lit("192.168.1.100"), "destination_ip": F.lit("203.0.113.42"), "destination_port": d.pick([80, 443, 22, 3389]), "byte_count": d.whole(100_000, 1_099_999), "ttl": F.lit(64), "window_size": F.lit(65535), "anomaly_type": F.lit(None).cast("array<string>"), "geo": F.lit(None).cast("struct<country:string,city:string,latitude:double,longitude:double,asn:string,isp:string>")}
    new = as_flows(rows, seed, **fixed).withColumn("packet_count", d.whole(5000, 14999)).withColumn("duration", d.unit() * 5)
    new = new.withColumn("flags", F.struct(*[F.lit(n == "syn").alias(n) for n in ("syn", "ack", "fin", "rst", "psh", "urg")]))
    new = new.withColumn("seq", F.col("seq") + last + 1)
    return flows.unionByName(new, allowMissingColumns=True)


def expand_packets(flows: DataFrame) -> DataFrame:
    """A row per packet: times spread over the flow's duration, lengths floor(bytes / packets)."""
    n = F.greatest(F.col("packet_count"), F.lit(0))
    one = flows.filter("packet_count > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("packet"))
    offset = F.col("packet") * F.col("duration") * 1000 / F.col("packet_count")
    return one.select("id", "packet", offset.alias("offset_ms"), (F.col("ts_ms") + offset).alias("packet_ts_ms"), "source_ip", "destination_ip", "source_port", "destination_port", "protocol", F.floor(F.col("byte_count") / F.col("packet_count")).alias("length"))
