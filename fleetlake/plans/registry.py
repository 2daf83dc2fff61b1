"""The list of named queries and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir
from .shapes import Tables, with_shapes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name`` with the SQL that gives the same rows."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_shapes(sql)
        return fn

    return register


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder, for queries that write and read back."""
    return f"{checkpoint_dir(spark).rstrip('/')}/fleetlake-{label}-{uuid.uuid4().hex[:12]}"
