"""Elapsed time, freshness, chunk bounds and slice names.

``as_of`` is always an argument: the same inputs give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, as_col, as_time, int_div

SLICE_PATTERN = "yyyyMMdd-HHmmss"
SLICE_REGEX = r"(\d{8}-\d{6})"


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds between two timestamps without zone.

    The function compares local times, so the session's zone plays no part.
    """
    return F.timestamp_diff("MICROSECOND", start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))


def epoch_micros(ts: ColumnLike) -> Column:
    """Microseconds since 1970 of a timestamp (a zoneless one is read as UTC)."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), as_col(ts))


def epoch_seconds(ts: ColumnLike) -> Column:
    """Whole seconds since 1970, rounded down."""
    return floor_div(epoch_micros(ts), 1000000)


def floor_div(a: Column, b: int) -> Column:
    """Quotient rounded down; exact for the microseconds of any date, which stay below 2^53."""
    return F.floor(a / F.lit(b)).cast("bigint")


def seconds_between(start, end) -> Column:
    """Whole seconds from ``start`` to ``end``, rounded down."""
    first = as_col(start) if isinstance(start, (str, Column)) else as_time(start)
    return floor_div(micros_between(first, as_time(end)), 1000000)


def delay_text(start: ColumnLike, as_of, compat: bool = False) -> Column:
    """``H hours M minutes S.SS seconds`` from ``start`` to ``as_of``.

    With ``compat`` whole days are left out of the hours.
    """
    gap = micros_between(as_col(start), as_time(as_of))
    hours = int_div(gap, 3600 * 1000000)
    if compat:
        hours = hours % 24
    minutes = int_div(gap, 60 * 1000000) % 60
    seconds = ((gap % (60 * 1000000)).cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(20,6)")
    return F.concat(
        hours.cast("bigint").cast("string"), F.lit(" hours "),
        minutes.cast("bigint").cast("string"), F.lit(" minutes "),
        F.round(seconds, 2).cast("decimal(20,2)").cast("string"), F.lit(" seconds"),
    )


def fmt_ts(ts: ColumnLike) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd HH:mm")


def fresh(ts: ColumnLike, as_of, max_age: str = "7 days") -> Column:
    """True for a time later than ``as_of`` minus ``max_age``; comparable with a pushed filter."""
    return as_col(ts) > as_time(as_of) - F.expr(f"interval {max_age}")


def stale(created: ColumnLike, as_of, days: int = 1) -> Column:
    """True for a time at least ``days`` whole days before ``as_of``."""
    return as_col(created) <= as_time(as_of) - F.expr(f"interval {int(days)} days")


def chunk_bound(ts: ColumnLike, end: bool = False) -> Column:
    """A time cut to whole seconds; as an end bound, widened to the last microsecond."""
    whole = F.date_trunc("second", as_col(ts)).cast("timestamp_ntz")
    return whole + F.expr("interval 999999 microseconds") if end else whole


def slice_time(name: ColumnLike) -> Column:
    """Start time of a slice from its file or folder name; null for other names."""
    stamp = F.nullif(F.regexp_extract(as_col(name), SLICE_REGEX, 1), F.lit(""))
    return F.try_to_timestamp(stamp, F.lit(SLICE_PATTERN)).cast("timestamp_ntz")


def slice_name(ts: ColumnLike, every_seconds: int = 120) -> Column:
    """Name of the slice of ``every_seconds`` that holds ``ts``."""
    start = floor_div(epoch_micros(ts), every_seconds * 1000000) * every_seconds
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(origin + F.make_dt_interval(secs=start.cast("decimal(18,6)")), SLICE_PATTERN)
