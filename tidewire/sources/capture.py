"""Capture lines (tab-separated), CSV, JSON and the upload filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.network import IP_PROTOCOLS, app_protocol, leading_int, tcp_flags
from tidewire.schema import FLOW

#: The fields of a capture line, in order.
FIELDS = ("time_epoch", "src", "dst", "tcp_src", "tcp_dst", "udp_src", "udp_dst", "proto", "length", "ttl", "window", "flags")
MOST_BYTES = 100 * 1024 * 1024


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Flow columns (without seq and id) from lines; lines without addresses are dropped. Unreadable numbers take
    defaults: ports 0, length 64, time to live 64, and a window that is absent 65535 (a window of 0 stays 0)."""
    # generated, so that each line is split once and not once for every column that reads a part
    lines = lines.select(F.explode(F.array(F.split(column, "\t"))).alias("parts"))
    f = {n: F.coalesce(F.get("parts", F.lit(i)), F.lit("")) for i, n in enumerate(FIELDS)}
    proto = leading_int(f["proto"])

    def port(side: str) -> Column:
        return F.coalesce(F.when(proto == 6, leading_int(f[f"tcp_{side}"])).when(proto == 17, leading_int(f[f"udp_{side}"])), F.lit(0)).cast("int")

    def number(name: str, default: int, keep_zero: bool = False) -> Column:
        n = leading_int(f[name])
        return F.coalesce(n if keep_zero else F.nullif(n, F.lit(0)), F.lit(default))

    transport = F.when(proto == 6, "TCP").when(proto == 17, "UDP")
    other = F.coalesce(F.create_map(*[F.lit(x) for kv in IP_PROTOCOLS.items() for x in kv])[proto.cast("int")], F.lit("OTHER"))
    named = F.when(transport.isNotNull(), app_protocol(port("dst"), port("src"), transport)).otherwise(other)
    return lines.filter((f["src"] != "") & (f["dst"] != "")).select(
        F.round(f["time_epoch"].try_cast("double") * 1000).cast("long").alias("ts_ms"),
        f["src"].alias("source_ip"),
        f["dst"].alias("destination_ip"),
        port("src").alias("source_port"),
        port("dst").alias("destination_port"),
        named.alias("protocol"),
        F.lit(1).cast("long").alias("packet_count"),
        number("length", 64).cast("long").alias("byte_count"),
        F.lit(0.0).alias("duration"),
        tcp_flags(f["flags"]).alias("flags"),
        number("ttl", 64).cast("int").alias("ttl"),
        number("window", 65535, keep_zero=True).cast("int").alias("window_size"),
        F.lit(False).alias("is_anomaly"),
    )


def interfaces(lines: DataFrame, column: str = "value") -> DataFrame:
    """(number, name, description) from the capture tool's list: `1. eth0 (Description)`."""
    get = lambda i: F.regexp_extract(column, r"^\s*(\d+)\.?\s+(\S+)(?:\s+\((.*)\))?\s*$", i)
    return lines.select(get(1).try_cast("int").alias("number"), get(2).alias("name"), F.nullif(get(3), F.lit("")).alias("description")).filter("number is not null")


def _nested(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))


def read_csv(spark: SparkSession, path: str, schema: T.StructType = FLOW) -> DataFrame:
    """What write_csv has written: JSON cells become structs and arrays again. Rows that don't fit have nulls."""
    text = T.StructType([T.StructField(f.name, T.StringType() if _nested(f) or isinstance(f.dataType, T.BinaryType) else f.dataType) for f in schema])
    raw = spark.read.schema(text).option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[F.from_json(f.name, f.dataType).alias(f.name) if _nested(f) else F.unbase64(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in schema])


def read_json(spark: SparkSession, path: str, schema: T.StructType = FLOW, array: bool = False) -> DataFrame:
    """Lines of JSON, or with array=True files that hold one array."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def uploads(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Capture files by name and size, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pcap,pcapng}").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").filter(F.col("length") <= most_bytes)
