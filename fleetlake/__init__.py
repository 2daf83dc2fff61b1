"""Spark-native analytics over snapshots, change logs and metrics of a database fleet."""

from .session import cut_lineage, get_session

__all__ = ["cut_lineage", "get_session"]
