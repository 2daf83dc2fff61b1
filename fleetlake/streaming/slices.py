"""Rolling slices of the change log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import SLICE_PATTERN
from ..sources.change_log import structured_line


def read_broker(spark: SparkSession, options: Mapping[str, str], source: str = "kafka") -> DataFrame:
    """Records of a broker from the earliest position: the text ``value`` with ``partition``, ``offset`` and ``timestamp``.

    ``source="text"`` reads files instead, oldest first, which give no position
    of their own; the checkpoint keeps the place.
    """
    reader = spark.readStream.format(source)
    if source == "kafka":
        reader = reader.option("startingOffsets", "earliest")
    rows = reader.options(**options).load()
    place = [c for c in ("partition", "offset", "timestamp") if c in rows.columns]
    return rows.select(F.col("value").cast("string").alias("value"), *place)


def write_slices(
    stream: DataFrame, path: str, checkpoint: str, every: str = "120 seconds", database: str | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Append envelope lines to one folder per slice, named by its UTC start time.

    Lines of a broker take their partition and offset along as their position.

    A slice is one micro-batch of ``every``; its rows stay spread over the
    tasks that read them. Positions are committed after the slice is written.
    ``once`` takes what is there and stops. ``database`` tags each line.
    """
    line = F.col("value")
    if "offset" in stream.columns:
        line = structured_line(line, F.col("offset"), F.col("partition"), database)
    elif database is not None:
        line = structured_line(line, database=database)
    start = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), SLICE_PATTERN)
    writer = (
        stream.select(line.alias("value"), start.alias("slice"))
        .writeStream.format("text").partitionBy("slice").option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start(path)
