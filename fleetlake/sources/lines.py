"""Line files read from an offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id"))


def read_lines_from(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """Lines from ``offset`` on with a 0-based number over all files in the order of their names.

    The greatest ``line_no`` plus one is where to resume. A first pass counts
    the lines of each file split and writes only that; splits wholly below the
    offset are then left out by name. Line ids run on within a split, so its
    first id and the lines before it turn them into places. If the files are
    cut differently when they are read again, the read fails and is to be
    repeated.
    """
    split = ["_file", "_at"]
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file split.
    starts = cut_lineage(
        _lines(spark, path).groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))))
    lines = _lines(spark, path)
    last = starts.filter(F.col("_start") + F.col("_rows") <= offset).agg(F.max("_file")).first()[0]
    if last is not None:
        lines = lines.filter(F.col("_file") >= last)
    # Ids of a task start at a multiple of 2 to the 33 and count on over its splits.
    task = F.shiftright("_id", 33)
    own = starts.withColumnsRenamed({"_file": "_f", "_at": "_a"})
    numbered = lines.join(own, (F.col("_file") == F.col("_f")) & (F.col("_at") == F.col("_a")), "left")
    first = F.min("_id").over(Window.partitionBy(task, *split))
    place = F.when(F.col("_start").isNull(), F.raise_error(F.lit("the files were cut differently on the second read; read again"))).otherwise(
        F.col("_id") - first + F.col("_start"))
    return numbered.select(place.alias("line_no"), F.col("value").alias("line")).filter(F.col("line_no") >= offset)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines with their numbers."""
    return read_lines_from(spark, path)
