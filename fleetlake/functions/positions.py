"""Write-log positions of the form ``16/B374D848``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, as_col

POSITION_TYPE = "decimal(20,0)"


def lsn_number(position: ColumnLike) -> Column:
    """The position as an unsigned 64-bit number; it can exceed a bigint."""
    parts = F.split(as_col(position), "/")
    high = F.conv(parts[0], 16, 10).cast(POSITION_TYPE)
    low = F.conv(parts[1], 16, 10).cast(POSITION_TYPE)
    return (high * F.lit(4294967296).cast("decimal(10,0)") + low).cast(POSITION_TYPE)


def lsn_diff(a: ColumnLike, b: ColumnLike) -> Column:
    """Bytes from position ``b`` to position ``a``."""
    return (lsn_number(a) - lsn_number(b)).cast(POSITION_TYPE)
