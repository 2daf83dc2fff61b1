"""Gates and trends over instance metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COPY_LIMITS, METRICS, MISSING_METRIC
from ..functions.columns import as_time
from .windows import trend

GIGABYTE = float(1024 ** 3)
# Digits a reading is rounded to.
DIGITS = {"CPUUtilization": 2, "DiskQueueDepth": 2, "BurstBalance": 2}


def latest_metric(
    df: DataFrame, as_of, window: str = "60 seconds", by: Sequence[str] = ("instance",), metric: str | None = None,
    ts: str = "ts", value: str = "value", name: str = "metric",
) -> DataFrame:
    """The newest reading within ``window`` before ``as_of``, per instance (and metric)."""
    at = as_time(as_of)
    rows = df.filter((F.col(ts) <= at) & (F.col(ts) >= at - F.expr(f"interval {window}")))
    keys = [*by, name]
    if metric is not None:
        rows = rows.filter(F.col(name) == metric)
    return rows.groupBy(*keys).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def wide(
    df: DataFrame, by: Sequence[str] = ("instance",), ts: str = "ts", value: str = "value", name: str = "metric",
    missing: dict[str, float] | None = None,
) -> DataFrame:
    """The newest reading of every metric in one row per key; a missing one takes its fixed stand-in."""
    missing = {**MISSING_METRIC, **(missing or {})}
    aggs = [
        F.coalesce(
            F.round(F.max_by(F.when(F.col(name) == m, F.col(value)), F.when(F.col(name) == m, F.col(ts))), DIGITS.get(m, 5)),
            F.lit(missing[m]),
        ).alias(m)
        for m in METRICS
    ]
    return df.groupBy(*by).agg(*aggs)


def metric_gate(
    readings: DataFrame, limits: dict[str, float] | None = None, load: str | None = None, name: str = "gate_open",
) -> DataFrame:
    """Whether work may go on: every reading within its limit. Limits that are not given are not checked.

    ``load`` names a column of running processes, compared with ``max_load``.
    """
    limits = COPY_LIMITS if limits is None else limits
    lag_gb = F.col("OldestReplicationSlotLag") / F.lit(GIGABYTE)
    tests = {
        "max_cpu": lambda v: F.col("CPUUtilization") < v,
        "max_disk_queue": lambda v: F.col("DiskQueueDepth") < v,
        "min_burst_balance": lambda v: F.col("BurstBalance") >= v,
        "max_read_latency": lambda v: F.col("ReadLatency") <= v,
        "max_write_latency": lambda v: F.col("WriteLatency") <= v,
        "max_slot_lag_gb": lambda v: lag_gb <= v,
        "max_load": lambda v: F.col(load) < v,
    }
    verdict = F.lit(True)
    for key, test in tests.items():
        if key in limits and (key != "max_load" or load):
            verdict = verdict & test(F.lit(float(limits[key])))
    return readings.withColumn(name, verdict)


def trends_wide(
    df: DataFrame, by: Sequence[str] = ("instance",), ts: str = "ts", value: str = "value", name: str = "metric",
    n: int = 5, unit: str = "day",
) -> DataFrame:
    """Slope and reading of the metrics a verdict needs, one row per key and time; lag in gigabytes."""
    wanted = {"CPUUtilization": "cpu", "DiskQueueDepth": "queue", "OldestReplicationSlotLag": "lag"}
    scaled = F.when(F.col(name) == "OldestReplicationSlotLag", F.col(value) / F.lit(GIGABYTE)).otherwise(F.col(value))
    rows = df.filter(F.col(name).isin(list(wanted))).withColumn(value, scaled)
    sloped = trend(rows, [*by, name], ts, value, n, unit)
    aggs = []
    for metric, short in wanted.items():
        own = F.col(name) == metric
        aggs += [F.max(F.when(own, F.col("slope"))).alias(f"{short}_slope"), F.max(F.when(own, F.col(value))).alias(short)]
    return sloped.groupBy(*by, ts).agg(*aggs)


def trend_verdict(df: DataFrame, limits: dict[str, float] | None = None, name: str = "verdict") -> DataFrame:
    """``rising``, ``falling``, ``idle`` or ``steady`` from slopes and headroom.

    Fixed factors: rising above slopes 0.2, 0.1, 0.1 within 1.2 of a limit;
    falling below -0.04, -0.03, -0.03 outside it; idle outside 1.4, 1.5, 1.6.
    """
    limits = COPY_LIMITS if limits is None else limits
    tops = {"cpu": limits["max_cpu"], "queue": limits["max_disk_queue"], "lag": limits["max_slot_lag_gb"]}

    def slope(m: str) -> Column:
        return F.coalesce(F.col(f"{m}_slope"), F.lit(0.0))

    def near(m: str, factor: float) -> Column:
        return F.coalesce(F.col(m), F.lit(0.0)) * F.lit(factor) > F.lit(float(tops[m]))

    def below(m: str, factor: float) -> Column:
        return F.coalesce(F.col(m), F.lit(0.0)) * F.lit(factor) < F.lit(float(tops[m]))

    rising = F.lit(False)
    for m, s in (("cpu", 0.2), ("queue", 0.1), ("lag", 0.1)):
        rising = rising | ((slope(m) > s) & near(m, 1.2))
    falling = F.lit(True)
    for m, s in (("cpu", -0.04), ("queue", -0.03), ("lag", -0.03)):
        falling = falling & (slope(m) < s) & below(m, 1.2)
    idle = F.lit(True)
    for m, f in (("cpu", 1.4), ("queue", 1.5), ("lag", 1.6)):
        idle = idle & below(m, f)
    return df.withColumn(name, F.when(rising, F.lit("rising")).when(falling, F.lit("falling"))
                         .when(idle, F.lit("idle")).otherwise(F.lit("steady")))
