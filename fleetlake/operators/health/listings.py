"""Sizes and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...constants import INACTIVE_DATABASE_PATTERN, SYSTEM_DATABASES, SYSTEM_SCHEMAS
from ...functions.numbers import bytes_text, size_pretty
from ...functions.text import not_similar


def database_sizes(
    df: DataFrame, order: str = "size", active_only: bool = False, name: str = "datname", size: str = "size_bytes",
    allowed: str = "datallowconn", exclude: str = INACTIVE_DATABASE_PATTERN, top: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Databases with their size as text; sorted only when ``top`` asks for the first few."""
    rows = df.filter(F.col(allowed) & not_similar(name, exclude)) if active_only else df
    out = rows.select(*keys, name, size, size_pretty(size).alias("db_size"))
    if top is None:
        return out
    first = [F.col(size).desc()] if order == "size" else []
    return out.orderBy(*first, name, *keys).limit(top)


def non_admin_databases(df: DataFrame, name: str = "datname", doomed: bool = False) -> DataFrame:
    """Databases of applications, or with ``doomed`` those marked for deletion."""
    marked = F.col(name).ilike("%delete_me%")
    return df.filter(marked) if doomed else df.filter(~F.col(name).isin(SYSTEM_DATABASES) & ~marked)


def table_sizes(
    df: DataFrame, part: str = "table", schema: str = "nspname", name: str = "relname", total: str = "total_bytes",
    index: str = "index_bytes", toast: str = "toast_bytes", top: int | None = None, keys: Sequence[str] = (),
) -> DataFrame:
    """Total, index, overflow and derived table size; the largest ``top`` by ``part``."""
    own = F.col(total) - F.col(index) - F.coalesce(F.col(toast), F.lit(0))
    rows = df.filter(~F.col(schema).isin(SYSTEM_SCHEMAS) & ~F.col(schema).rlike("^pg_toast")).select(
        *keys, schema, name, F.col(total).alias("total_bytes"), F.col(index).alias("index_bytes"),
        F.col(toast).alias("toast_bytes"), own.alias("table_bytes"),
    )
    out = rows.withColumns({f"{p}_size": size_pretty(f"{p}_bytes") for p in ("total", "index", "toast", "table")})
    if top is None:
        return out
    return out.orderBy(F.col(f"{part}_bytes").desc_nulls_last(), schema, name, *keys).limit(top)


def connections(df: DataFrame, current: str = "connections.current", available: str = "connections.available",
                cursors: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Server connection gauges out of a status document."""
    shown = [F.col(current).alias("current"), F.col(available).alias("available")]
    return df.select(*keys, *shown, *([F.col(cursors).alias("open_cursors")] if cursors else []))


def instances(
    df: DataFrame, identifier: str | Column = "DBInstanceIdentifier", instance_class: str | Column = "DBInstanceClass",
    storage: str | Column = "AllocatedStorage", engine: str | Column = "Engine", only: str | None = None,
) -> DataFrame:
    """Instance name, class, storage and engine."""
    def named(c: str | Column, alias: str) -> Column:
        return (F.col(c) if isinstance(c, str) else c).alias(alias)

    rows = df.select(named(identifier, "identifier"), named(instance_class, "instance_class"),
                     named(storage, "storage"), named(engine, "engine"))
    return rows if only is None else rows.filter(F.col("engine") == only)


def maintenance_windows(
    df: DataFrame, engine: str, identifier: str = "DBInstanceIdentifier", engine_col: str = "Engine",
    window: str = "PreferredMaintenanceWindow",
) -> DataFrame:
    """Maintenance window of every instance of an engine."""
    return df.filter(F.col(engine_col) == engine).select(
        F.col(identifier).alias("identifier"), F.col(window).alias("maintenance_window"))


def collection_stats(
    df: DataFrame, name: str = "name", counts: Sequence[str] = ("collections", "views", "indexes"),
    sizes: Sequence[str] = ("indexSize", "dataSize", "storageSize"), average: str | None = "avgObjSize", unit: str = "g",
) -> DataFrame:
    """Database or collection statistics with sizes as text."""
    shown = [F.col(c) for c in counts] + [bytes_text(s, unit).alias(s) for s in sizes]
    if average:
        shown.append(F.concat(F.round(F.col(average), 0).cast("bigint").cast("string"), F.lit("B")).alias(average))
    return df.select(name, *shown)
