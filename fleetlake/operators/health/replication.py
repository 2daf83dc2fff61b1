"""Replication lag and catch-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.numbers import size_pretty
from ...functions.positions import lsn_diff
from ..windows import eta

IN_SYNC_BYTES = 100


def slot_lag(
    slots: DataFrame, plugins: Sequence[str] | None = None, current: str = "current_lsn", restart: str = "restart_lsn",
    plugin: str = "plugin", keep: Sequence[str] = ("slot_name", "active"), top: int | None = None,
) -> DataFrame:
    """Bytes of log each slot holds back, largest first with ``top``."""
    rows = slots.filter(F.col(plugin).isin(list(plugins))) if plugins else slots
    lag = lsn_diff(current, restart)
    out = rows.select(*keep, lag.alias("lag_bytes"), size_pretty(lag).alias("lag"))
    return out if top is None else out.orderBy(F.col("lag_bytes").desc(), *keep).limit(top)


def standby_lag(
    standbys: DataFrame, sent: str = "sent_lsn", write: str = "write_lsn", flush: str = "flush_lsn",
    replay: str = "replay_lsn", keep: Sequence[str] = ("pid", "application_name", "state"),
) -> DataFrame:
    """Write, flush and replay lag per standby in bytes; the total is the replay lag."""
    return standbys.select(
        *keep, lsn_diff(sent, write).alias("write_lag"), lsn_diff(sent, flush).alias("flush_lag"),
        lsn_diff(sent, replay).alias("replay_lag"), lsn_diff(sent, replay).alias("total_lag"))


def catch_up(
    readings: DataFrame, by: Sequence[str] = ("slot_name",), ts: str = "snapshot_ts", current: str = "current_lsn",
    flushed: str = "confirmed_flush_lsn", limit: int = IN_SYNC_BYTES, unit: str = "day",
) -> DataFrame:
    """Distance of each reading: in sync up to ``limit`` bytes, otherwise the time to zero at the last pace."""
    rows = readings.select(*by, ts, lsn_diff(current, flushed).cast("double").alias("distance"))
    paced = eta(rows, by, ts, "distance", unit)
    synced = F.col("distance") <= limit
    return paced.select(
        *by, ts, F.col("distance").cast("bigint").alias("distance"),
        F.when(synced, F.lit("in sync")).otherwise(F.lit("catching up")).alias("status"),
        F.when(~synced, F.col("eta")).alias("eta"),
    )


def subscription_status(
    subscriptions: DataFrame, stats: DataFrame, on: Sequence[str] = ("subid",),
    name: str = "subname", enabled: str = "subenabled", slot: str = "subslotname", received: str = "received_lsn",
    keep: Sequence[str] = (), tables: DataFrame | None = None, table: str = "relname",
) -> DataFrame:
    """State, slot and received position per subscription; ``tables`` adds a row per table name with its ``place``."""
    out = subscriptions.join(stats, list(on)).select(
        *on, name, F.when(F.col(enabled), F.lit("replicating")).otherwise(F.lit("disabled")).alias("state"),
        slot, received, *keep)
    if tables is None:
        return out
    from ..aggregates import ranked_names

    return out.join(ranked_names(tables, on, table), list(on), "left")
