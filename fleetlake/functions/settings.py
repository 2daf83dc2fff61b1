"""Per-table option strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ColumnLike, as_col


def option_or_default(options: ColumnLike, key: str, default, type_: str = "double") -> Column:
    """The number set for ``key`` in an option text, else ``default`` (a value or a column)."""
    found = F.regexp_extract(as_col(options), re.escape(key) + r"=([0-9.]+)", 1)
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(found, F.lit("")).cast(type_), fallback.cast(type_))


def explode_options(df: DataFrame, options: str, keep: list[str] | None = None) -> DataFrame:
    """One row per ``key=value`` entry of an option array."""
    kept = [F.col(c) for c in (keep if keep is not None else [c for c in df.columns if c != options])]
    entry = F.col("_entry")
    cut = F.instr(entry, "=")
    return (
        df.select(*kept, F.explode(F.col(options)).alias("_entry"))
        .withColumns({
            "option": F.when(cut > 0, F.substr(entry, F.lit(1), cut - 1)).otherwise(entry),
            "value": F.when(cut > 0, F.substr(entry, cut + 1)),
        })
        .drop("_entry")
    )
