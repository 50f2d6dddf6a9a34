"""Joins whose key may have a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(rows: DataFrame, key: str, most: int = 1000) -> dict:
    """Key values with more than 1/most of the rows, fewer than `most` of them, and how many such shares each has."""
    total = rows.count()
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return {r[key]: -(-r.n * most // total) for r in counts.filter(F.col("n") * most > total).collect()}


def spread_join(rows: DataFrame, table: DataFrame, key: str, heavy: dict, *by: str) -> DataFrame:
    """Left join of rows with a table of one row for each key. The rows of heavy keys are dealt by a hash of the columns
    `by` to as many parts as they have shares, and the table's rows of these keys are repeated for each part: fewer than
    twice `most` rows, whatever the table. Rows without a key are dealt too, since they would all meet in one task."""
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in heavy.items() for x in kv])[F.col(key)], F.lit(1)) if heavy else F.lit(1)
    dealt: Column = F.pmod(F.xxhash64(*by), F.when(F.col(key).isNull(), 1000).otherwise(parts)).cast("int")
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("_salt", dealt).join(repeated, [key, "_salt"], "left").drop("_salt")
