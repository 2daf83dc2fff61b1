"""Operation documents of a document store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OPS_SCHEMA = (
    "opid bigint, `desc` string, ns string, op string, active boolean, secs_running bigint, waitingForLock boolean, "
    "WaitState string, blockedOn string, client string, command struct<findandmodify: string>"
)


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    """One operation per line; a field that is missing is null."""
    return spark.read.schema(OPS_SCHEMA).json(path)
