"""Exports of a key-value table, one JSON item ``{id, value}`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, value string").json(path)


def kv_scan(df: DataFrame, field: str, expr: str, mode: str = "eq") -> DataFrame:
    """Items whose ``field`` equals or contains a text."""
    col = F.col(field)
    if mode == "eq":
        return df.filter(col == expr)
    if mode == "contains":
        return df.filter(col.contains(expr))
    raise ValueError(f"unknown mode {mode!r}")
