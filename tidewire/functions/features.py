"""Feature columns of flows and their scaling, as plain expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE_HOT = ("TCP", "UDP", "HTTP", "HTTPS", "DNS")
N_FEATURES = 20
NAMES = [f"f{i:02d}" for i in range(N_FEATURES)]


def feature_columns() -> list[Column]:
    """20 doubles: seven numbers, five protocols, UTC hour and day of week (Sunday 0), six flags."""
    ts = F.timestamp_millis("ts_ms")
    numbers = [F.col(c) for c in ("byte_count", "packet_count", "duration", "source_port", "destination_port", "ttl", "window_size")]
    flags = [F.col(f"flags.{n}") for n in ("syn", "ack", "fin", "rst", "psh", "urg")]
    columns = [*numbers, *[F.col("protocol") == p for p in ONE_HOT], F.hour(ts), F.dayofweek(ts) - 1, *flags]
    return [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for c, n in zip(columns, NAMES, strict=True)]


def visual_columns() -> list[Column]:
    """The nine features that plots use: the seven numbers, syn and ack."""
    every = feature_columns()
    return [every[i].alias(f"v{k}") for k, i in enumerate((0, 1, 2, 3, 4, 5, 6, 14, 15))]


def features(flows: DataFrame, *keep: str) -> DataFrame:
    return flows.select(*keep, *feature_columns())


class Scaler:
    """Per column offset and scale, fitted once and used for any rows; a constant column becomes 0."""

    def __init__(self, columns: list[str], offsets: list[float], scales: list[float]):
        self.columns, self.offsets, self.scales = columns, offsets, scales

    @classmethod
    def min_max(cls, df: DataFrame, columns: list[str] = NAMES) -> Scaler:
        row = df.agg(*[F.min(c) for c in columns], *[F.max(c) for c in columns]).first()
        low, high = [x or 0.0 for x in row[: len(columns)]], [x or 0.0 for x in row[len(columns) :]]
        return cls(list(columns), low, [h - l for l, h in zip(low, high, strict=True)])

    @classmethod
    def z_score(cls, df: DataFrame, columns: list[str] = NAMES) -> Scaler:
        row = df.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
        return cls(list(columns), [x or 0.0 for x in row[: len(columns)]], [x or 0.0 for x in row[len(columns) :]])

    def column(self, name: str) -> Column:
        i = self.columns.index(name)
        return ((F.col(name) - self.offsets[i]) / self.scales[i] if self.scales[i] > 0 else F.lit(0.0)).alias(name)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.column(c) if c in self.columns else F.col(c) for c in df.columns])
