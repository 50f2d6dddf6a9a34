"""The flow table: one row per flow. seq is the arrival order, which breaks ties wherever the first row counts."""

from pyspark.sql import types as T

FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg")

GEO = T.StructType([T.StructField(n, T.StringType()) for n in ("country", "city")] + [T.StructField(n, T.DoubleType()) for n in ("latitude", "longitude")] + [T.StructField(n, T.StringType()) for n in ("asn", "isp")])

FLOW = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("destination_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("packet_count", T.LongType()),
        T.StructField("byte_count", T.LongType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("flags", T.StructType([T.StructField(n, T.BooleanType()) for n in FLAGS])),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("window_size", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("anomaly_type", T.ArrayType(T.StringType())),
        T.StructField("geo", GEO),
    ]
)

PROTOCOLS = ("TCP", "UDP", "ICMP", "HTTP", "HTTPS", "DNS", "FTP", "SSH", "SMTP", "UNKNOWN")
SEVERITIES = ("low", "medium", "high", "critical")
