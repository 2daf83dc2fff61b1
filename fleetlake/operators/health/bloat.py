"""Estimated bloat of tables and indexes from column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.numbers import size_pretty


def padded(width: Column, align: int) -> Column:
    """``width`` rounded up to the next multiple of ``align`` (a multiple stays as it is)."""
    rest = width % align
    return width + F.lit(align) - F.when(rest == 0, F.lit(align)).otherwise(rest)


def row_widths(stats: DataFrame, on: Sequence[str], null_frac: str, avg_width: str, hdr: int, align: int) -> DataFrame:
    """Per table: data width with header, and the share of the null bitmap."""
    nullable = F.count(F.when(F.col(null_frac) != 0, F.lit(1)))
    sums = stats.groupBy(*on).agg(
        F.sum((F.lit(1.0) - F.col(null_frac)) * F.col(avg_width)).alias("_width"),
        F.max(null_frac).alias("_maxfrac"),
        (F.lit(hdr) + 1 + F.floor(nullable / F.lit(8))).alias("_nullhdr"),
    )
    header = hdr + align - (align if hdr % align == 0 else hdr % align)
    return sums.select(
        *on, (F.col("_width") + F.lit(float(header))).alias("datahdr"),
        (F.col("_maxfrac") * padded(F.col("_nullhdr"), align)).alias("nullhdr2"),
    )


def bloat(
    stats: DataFrame, relations: DataFrame, indexes: DataFrame, on: Sequence[str] = ("schemaname", "tablename"),
    null_frac: str = "null_frac", avg_width: str = "avg_width", rows: str = "reltuples", pages: str = "relpages",
    index: str = "iname", index_rows: str = "ituples", index_pages: str = "ipages",
    block: int = 8192, hdr: int = 23, align: int = 4,
) -> DataFrame:
    """Expected against actual pages of tables and indexes: ratio and wasted bytes."""
    on = list(on)
    widths = row_widths(stats, on, null_frac, avg_width, hdr, align)
    room = F.lit(float(block - 20))
    table = relations.select(*on, rows, pages).join(widths, on).withColumn(
        "_want", F.ceil(F.col(rows).cast("double") * (padded(F.col("datahdr"), align) + F.col("nullhdr2") + 4) / room))
    entry = indexes.select(*on, index, index_rows, index_pages).join(widths, on).withColumn(
        "_want", F.coalesce(F.ceil(F.col(index_rows).cast("double") * (F.col("datahdr") - 12) / room), F.lit(0)))

    def report(df: DataFrame, kind: str, name: Column, have: Column) -> DataFrame:
        want = F.col("_want").cast("double")
        empty = (want == 0) | (have == 0) if kind == "index" else want == 0
        ratio = F.when(empty, F.lit(0.0)).otherwise(F.round(F.try_divide(have, want), 1))
        waste = F.when(have < want, F.lit(0.0)).otherwise(F.lit(float(block)) * (have - want)).cast("bigint")
        return df.select(F.lit(kind).alias("type"), *on[:-1], name.alias("object_name"), ratio.alias("bloat"),
                         waste.alias("raw_waste"))

    found = report(table, "table", F.col(on[-1]), F.col(pages).cast("double")).unionByName(report(
        entry, "index", F.concat(F.col(on[-1]), F.lit("::"), F.coalesce(F.col(index), F.lit("?"))),
        F.coalesce(F.col(index_pages), F.lit(0)).cast("double")))
    return found.distinct().withColumn("waste", size_pretty("raw_waste"))
