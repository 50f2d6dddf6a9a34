"""Spark-first analytics for network-flow data."""
