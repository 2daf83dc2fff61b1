"""Small helpers shared by the column functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_time(value) -> Column:
    """A timestamp without zone from a column, ``datetime`` or ISO text."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def int_div(a: Column, b: int | Column) -> Column:
    """Integer quotient, cut towards zero; exact for every bigint."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))
