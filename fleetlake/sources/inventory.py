"""The ``:``-separated instance inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import INVENTORY_FIELDS


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Nine fields per line, in lower case."""
    schema = ", ".join(f"{f} string" for f in INVENTORY_FIELDS)
    lines = spark.read.schema(schema).option("sep", ":").option("quote", "").csv(path)
    return lines.select(*[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in INVENTORY_FIELDS])


def write_inventory(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    fields = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in INVENTORY_FIELDS]
    df.select(F.concat_ws(":", *fields).alias("value")).write.mode(mode).text(path)
