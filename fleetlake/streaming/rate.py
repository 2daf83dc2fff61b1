"""Change statistics and duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_rate(
    df: DataFrame, every: str = "2 minutes", ts: str = "slice_ts", by: Sequence[str] = ("database", "table", "kind"),
    delay: str = "10 minutes",
) -> DataFrame:
    """Changes per database, table and kind in tumbling intervals; for streams and for tables."""
    rows = df.withColumn("_ts", F.col(ts))
    if df.isStreaming:
        rows = rows.withColumn("_ts", F.col("_ts").cast("timestamp")).withWatermark("_ts", delay)
    return (
        rows.groupBy(F.window("_ts", every), *by).agg(F.count(F.lit(1)).alias("changes"))
        .select(F.col("window.start").alias("start"), *by, "changes")
    )


def deduplicated(stream: DataFrame, keys: Sequence[str] = ("database", "partition", "offset"), ts: str = "slice_ts", delay: str = "10 minutes") -> DataFrame:
    """The log without the repeats a resumed reader brings, for repeats that follow within ``delay``.

    The keys are the position a broker gives, or what else names a transaction.
    """
    if not stream.isStreaming:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
