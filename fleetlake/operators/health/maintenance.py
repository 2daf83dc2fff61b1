"""Dead rows, vacuum and analyze."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.settings import option_or_default
from ...functions.text import remediation


def whole_percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` cut to an integer, as integer division of the server does."""
    return F.floor(F.try_divide((part * 100).cast("double"), whole.cast("double"))).cast("bigint")


def dead_rows(
    stats: DataFrame, live: str = "n_live_tup", dead: str = "n_dead_tup", schema: str = "schemaname",
    name: str = "relname", top: int | None = None, guard: bool = False, keys: Sequence[str] = (),
) -> DataFrame:
    """Dead-row percentage and the clean-up statement of the tables with most dead rows.

    ``guard`` counts an empty table as one row instead of leaving it out.
    """
    rows = stats if guard else stats.filter(F.col(live) > 0)
    whole = F.when(F.col(live) == 0, F.lit(1)).otherwise(F.col(live)) if guard else F.col(live)
    out = remediation(
        rows.select(*keys, schema, name, live, dead, whole_percent(F.col(dead), whole).alias("pct")),
        "VACUUM (VERBOSE,ANALYZE) %s.%s;", [schema, name], "vacuum", quote=False,
    )
    return out if top is None else out.orderBy(F.col(dead).desc(), schema, name, *keys).limit(top)


def maintenance_due(
    stats: DataFrame, kind: str = "vacuum", threshold: int = 50, scale: float = 0.2, options: str = "reloptions",
    live: str = "n_live_tup", dead: str = "n_dead_tup", keep: Sequence[str] = ("schemaname", "relname"),
    settings: DataFrame | None = None, on: Sequence[str] = (), pages: str = "relpages",
) -> DataFrame:
    """Tables whose dead rows exceed ``threshold + scale * rows``; a table's own options come first.

    ``settings`` holds the servers' ``autovacuum_<kind>_threshold`` and
    ``_scale_factor``, one row per ``on`` (one row in all without ``on``); they
    take the place of the two arguments, which hold where a setting is null or
    missing; two rows for one server fail the report. The times of the last upkeep are shown
    where the table has them. The limit is compared as it is and rounded for
    display only.
    """
    prefix = f"autovacuum_{kind}"
    names = [f"{prefix}_threshold", f"{prefix}_scale_factor"]
    rows, defaults = stats, [F.lit(threshold), F.lit(scale)]
    if settings is not None:
        several = F.raise_error(F.lit(f"settings: more than one row{' for one ' + ', '.join(on) if on else ''}"))
        sums = [F.count(F.lit(1)).alias("_rows"), *[F.max(n).alias(f"_{n}") for n in names]]
        # Without keys these are scalar subqueries, so an empty frame keeps every table.
        if on:
            rows = stats.join(settings.groupBy(*on).agg(*sums), list(on), "left")
            servers, own = F.col("_rows"), [F.col(f"_{n}") for n in names]
        else:
            servers, *own = [settings.agg(c).scalar() for c in sums]
        own = [F.when(servers > 1, several.cast(settings.schema[n].dataType)).otherwise(c) for n, c in zip(names, own)]
        defaults = [F.coalesce(c, d) for c, d in zip(own, defaults)]
    limit = option_or_default(options, names[0], defaults[0]) + option_or_default(options, names[1], defaults[1]) * F.col(live)
    last = [c for c in (f"last_{kind}", f"last_auto{kind}") if c in stats.columns]
    return rows.select(
        *keep, *last, live, dead, F.round(limit, 4).alias("threshold"), F.when(limit < F.col(dead), F.lit("yes")).alias("due"),
        F.round(F.try_divide(F.col(live).cast("double"), F.nullif(F.col(pages), F.lit(0)).cast("double")), 2).alias("rows_per_page"))


def vacuum_progress(
    progress: DataFrame, activity: DataFrame | None = None, on: Sequence[str] = ("pid",),
    total: str = "heap_blks_total", scanned: str = "heap_blks_scanned", keep: Sequence[str] = (),
) -> DataFrame:
    """Percent of the heap scanned, and how long to wait: factor 4, 3, 2 for the first three quarters, then 1.05."""
    pct = F.try_divide(F.col(scanned).cast("double") * 100, F.col(total).cast("double"))
    rows = progress if activity is None else progress.join(activity, list(on))
    wait = F.when(pct < 25, F.lit(4.0)).when(pct < 50, F.lit(3.0)).when(pct < 75, F.lit(2.0)).when(pct >= 75, F.lit(1.05))
    return rows.select(*on, *keep, total, scanned, F.round(pct, 2).alias("pct"), wait.alias("wait_factor"))
