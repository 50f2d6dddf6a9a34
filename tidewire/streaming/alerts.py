"""Alert rules over a stream of flows: a metric of each window of event time is held against a threshold, and a rule that
has fired is quiet for a while.

A rule's windows follow each other without gaps, from that of its first flow on, and are judged in their order once the
watermark has passed their ends, so that empty windows count (with values of 0) and results don't depend on how flows
were cut into batches. A rule fires at the end of a window, if its cooldown has passed since it last fired.

Flows are summed up by rule and window within the tasks that read them, so that what is shuffled are some rows a task.
The rest is keyed state with event-time timers (transformWithState): a rule's open windows, the next window to be judged
and the last firing. They are kept in the checkpoint: a query that starts again goes on where it stopped.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

METRICS = ("flow_count", "byte_count", "packet_count", "anomaly_count", "cluster_density", "protocol_ratio")
OPERATORS = {">": operator.gt, "<": operator.lt, "=": operator.eq, ">=": operator.ge, "<=": operator.le}
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

_SUMS = ("flows", "bytes", "packets", "anomalies", "matched")
PARTIAL = "rule string, window_start long, " + ", ".join(f"{c} long" for c in _SUMS) + ", latest timestamp"
ALERT = "rule string, name string, severity string, metric string, window_start long, window_end long, value double, threshold double"


@dataclass(frozen=True)
class Rule:
    """of: the protocol of protocol_ratio, the cluster of cluster_density; times in ms."""

    id: str
    metric: str
    operator: str
    threshold: float
    window_ms: int
    cooldown_ms: int = 0
    severity: str = "medium"
    name: str = ""
    of: str | int | None = None
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric}; known are {', '.join(METRICS)}")
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator}; known are {' '.join(OPERATORS)}")
        if self.window_ms <= 0 or self.cooldown_ms < 0:
            raise ValueError("windows last longer than 0 ms and cooldowns aren't negative")

    def value(self, sums: tuple) -> float:
        flows, size, packets, anomalies, matched = sums
        share = matched / flows if flows else 0.0
        return float({"flow_count": flows, "byte_count": size, "packet_count": packets, "anomaly_count": anomalies}.get(self.metric, share))

    def holds(self, sums: tuple) -> bool:
        return OPERATORS[self.operator](self.value(sums), self.threshold)


def partial_sums(flows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Sums by rule and window of the rows that a task has at hand. Flows without time are left out."""

    def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return pc.fill_null(batch.column(name).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("ts_ms")))
            if not len(batch):
                continue
            ts = numbers(batch, "ts_ms")
            values = [np.ones(len(ts), np.int64), numbers(batch, "byte_count"), numbers(batch, "packet_count"), numbers(batch, "is_anomaly")]
            out: dict[str, list] = {c: [] for c in ("rule", "window_start", *_SUMS, "latest")}
            for r in rules:
                kind = {"protocol_ratio": "protocol", "cluster_density": "cluster_id"}.get(r.metric)
                matched = pc.fill_null(pc.equal(batch.column(kind), r.of), False).to_numpy(zero_copy_only=False) if kind else np.zeros(len(ts), bool)
                starts, at = np.unique(ts - ts % r.window_ms, return_inverse=True)
                latest = np.full(len(starts), np.iinfo(np.int64).min)
                np.maximum.at(latest, at, ts)
                out["rule"] += [r.id] * len(starts)
                out["window_start"] += starts.tolist()
                out["latest"] += latest.tolist()
                for name, v in zip(_SUMS, [*values, matched.astype(np.int64)], strict=True):
                    total = np.zeros(len(starts), np.int64)
                    np.add.at(total, at, v)
                    out[name] += total.tolist()
            latest = pa.array(out.pop("latest"), pa.timestamp("ms")).cast(pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.string() if k == "rule" else pa.int64()) for k, v in out.items()], latest], names=[*out, "latest"])

    columns = ["ts_ms", "byte_count", "packet_count", "is_anomaly", "protocol"]
    cluster = F.col("cluster_id").cast("int") if "cluster_id" in flows.columns else F.lit(None).cast("int")
    return flows.select(*columns, cluster.alias("cluster_id")).mapInArrow(summed, PARTIAL)


class Watch(StatefulProcessor):
    """Keyed by rule."""

    def __init__(self, rules: list[Rule]):
        self.rules = {r.id: r for r in rules}

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start long", ", ".join(f"{c} long" for c in _SUMS))
        self.progress = handle.getValueState("progress", "next long, judged long, fired long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rule = self.rules[key[0]]
        begin, judged, fired = self.progress.get() if self.progress.exists() else (None, None, None)
        added: dict[int, np.ndarray] = {}
        for r in rows:
            if judged is None or r.window_start >= judged:  # else it comes too late
                added[r.window_start] = added.get(r.window_start, 0) + np.array([r[c] for c in _SUMS], np.int64)
        for start, sums in added.items():
            known = self.windows.getValue((start,)) if self.windows.containsKey((start,)) else (0,) * len(_SUMS)
            self.windows.updateValue((start,), tuple((sums + known).tolist()))
        if added:
            begin = min([*added, *([] if begin is None else [begin])])
            self.progress.update((begin, judged, fired))
            self.handle.registerTimer(begin + rule.window_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rule = self.rules[key[0]]
        at, judged, fired = self.progress.get()
        end = timerValues.getCurrentWatermarkInMs() // rule.window_ms * rule.window_ms  # windows before it are complete
        closed = {k[0]: tuple(v) for k, v in self.windows.iterator() if k[0] < end}
        known = sorted(closed, reverse=True)
        empty = (0,) * len(_SUMS)
        empty_fires, out = rule.holds(empty), []
        while at < end:
            while known and known[-1] < at:
                known.pop()
            sums = closed.get(at, empty)
            if rule.holds(sums) and (fired is None or at + rule.window_ms - fired >= rule.cooldown_ms):
                fired = at + rule.window_ms
                out.append(Row(rule=rule.id, name=rule.name or rule.id, severity=rule.severity, metric=rule.metric, window_start=at, window_end=fired, value=rule.value(sums), threshold=float(rule.threshold)))
            following = at + rule.window_ms
            if following not in closed:  # the next window with flows, or the next empty one that may fire
                then = next((k for k in reversed(known) if k > at), end)
                quiet = following if fired is None else max(following, -(-(fired + rule.cooldown_ms) // rule.window_ms) * rule.window_ms - rule.window_ms)
                following = min(then, quiet) if empty_fires else then
            at = following
        for start in closed:
            self.windows.removeKey((start,))
        at = max(at, end)
        self.progress.update((at, max(at, judged or at), fired))
        self.handle.registerTimer(at + rule.window_ms)
        return iter(out)

    def close(self) -> None:
        pass


def alerts(flows: DataFrame, rules: list[Rule], late: str = "5 minutes") -> DataFrame:
    """The alerts of a stream of flows (schema ALERT). Flows that come more than `late` after later ones may be left out."""
    live = [r for r in rules if r.enabled]
    if len({r.id for r in live}) < len(live):
        raise ValueError("rules need different ids")
    return partial_sums(flows, live).withWatermark("latest", late).groupBy("rule").transformWithState(Watch(live), ALERT, "Append", "EventTime")


def start_alerts(flows: DataFrame, rules: list[Rule], folder: str, checkpoint: str, late: str = "5 minutes", seconds: int = 5) -> StreamingQuery:
    """Appends alerts to a folder of Parquet files, each once."""
    conf = flows.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what transformWithState needs
    try:
        return alerts(flows, rules, late).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=f"{seconds} seconds").start()
    finally:
        conf.set(STATE_STORE, before)
