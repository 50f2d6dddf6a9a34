"""Writing flows: raw and display CSV, JSON, XML, and a Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON, binaries as base64: what a text file can hold and give back."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    columns = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.base64(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in df.schema]
    return df.select(*columns)


def write_csv(flows: DataFrame, path: str) -> None:
    flat(flows).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)


def display(flows: DataFrame) -> DataFrame:
    """The ten columns that people read."""
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    named = {"Timestamp": stamp, "Source IP": "source_ip", "Source Port": "source_port", "Destination IP": "destination_ip", "Destination Port": "destination_port", "Protocol": "protocol", "Bytes": "byte_count", "Packets": "packet_count", "Duration": "duration", "Anomaly": F.when(F.col("is_anomaly"), "Yes").otherwise("No")}
    return flows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()])


def write_display_csv(flows: DataFrame, path: str) -> None:
    display(flows).write.mode("overwrite").option("header", True).csv(path)


def write_json(flows: DataFrame, path: str) -> None:
    flows.write.mode("overwrite").json(path)


def write_xml(flows: DataFrame, path: str) -> None:
    flat(flows).write.mode("overwrite").option("rootTag", "flows").option("rowTag", "flow").format("xml").save(path)


def export(parts: dict[str, DataFrame], path: str, kind: str = "json") -> None:
    """Writes each of the parts (flows, clusters, anomalies, statistics) below the path."""
    writers = {"csv": write_csv, "json": write_json, "xml": write_xml}
    if kind not in writers:
        raise ValueError(f"can't write {kind!r}; known: {', '.join(writers)}")
    for name, df in parts.items():
        writers[kind](df, f"{path}/{name}")


def report(title: str, sections: list[tuple[str, str]], flows: DataFrame, anomalies: DataFrame, clusters: int = 0) -> str:
    """Markdown. sections: (kind, heading); kinds summary, flows and anomalies have contents, the first ten rows of the
    latter two."""
    lines = [f"# {title}", ""]
    for kind, heading in sections:
        lines.append(f"## {heading}")
        if kind == "summary":
            lines += [f"Total Flows: {flows.count()}", f"Anomalies: {anomalies.count()}", f"Clusters: {clusters}"]
        elif kind == "flows":
            lines += ["Flows:", *[f"- {r.id} ({r.source_ip} → {r.destination_ip})" for r in flows.orderBy("seq").limit(10).collect()]]
        elif kind == "anomalies":
            lines += ["Anomalies:", *[f"- {r.description} (Severity: {r.severity})" for r in anomalies.orderBy("seq").limit(10).collect()]]
        lines.append("")
    return "\n".join(lines) + "\n"
