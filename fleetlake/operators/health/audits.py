"""Exhaustion, retention and configuration audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...constants import INTEGER_LIMITS, MIN_RETENTION_DAYS

DEFAULT_FREEZE_LIMIT = 200000000
WIDE = "decimal(20,0)"


def ids_left(last: Column, step: Column, limit: Column) -> Column:
    """Values a sequence has left, by the sign of its last value and of its step.

    Decimal arithmetic, since the limit of a bigint plus a value leaves 64 bits.
    """
    v, top = last.cast(WIDE), limit.cast(WIDE)
    left = (
        F.when((v < 0) & (step < 0), top + v)
        .when((v < 0) & (step > 0), -v)
        .when((v > 0) & (step < 0), v)
        .when((v > 0) & (step > 0), top - v)
    )
    return left.cast(WIDE)


def int_exhaustion(
    seqs: DataFrame, threshold: int | None = 300000000, last: str = "last_value", step: str = "increment_by",
    data_type: str = "data_type", keep: Sequence[str] = ("seqname",),
) -> DataFrame:
    """Sequences with fewer than ``threshold`` values left; one with none left is ``exhausted``."""
    limit = F.lit(None)
    for name, top in INTEGER_LIMITS.items():
        limit = F.when(F.col(data_type) == name, F.lit(top)).otherwise(limit)
    out = seqs.select(*keep, data_type, last, step, ids_left(F.col(last), F.col(step), limit).alias("ids_left"))
    out = out.filter(F.col("ids_left").isNotNull())
    if threshold is not None:
        out = out.filter(F.col("ids_left") < threshold)
    return out.withColumn("status", F.when(F.col("ids_left") <= 0, F.lit("exhausted")).otherwise(F.lit("reaching limit")))


def retention_audit(
    inst: DataFrame, minimums: dict[str, int] | None = None, engine: str = "Engine",
    days: str = "BackupRetentionPeriod", keep: Sequence[str] = ("DBInstanceIdentifier",), primary: Column | None = None,
) -> DataFrame:
    """Instances (primaries, if a condition is given) that keep backups for fewer days than their engine asks for."""
    minimums = minimums or MIN_RETENTION_DAYS
    least = F.lit(minimums["default"])
    for name, value in minimums.items():
        if name != "default":
            least = F.when(F.col(engine) == name, F.lit(value)).otherwise(least)
    rows = inst.filter(primary) if primary is not None else inst
    return (
        rows.select(*keep, engine, days, least.cast("bigint").alias("required_days"))
        .filter(F.col(days) < F.col("required_days"))
    )


def class_drift(
    desired: DataFrame, actual: DataFrame, on: Sequence[str] = ("identifier",), wanted: str = "desired_class",
    have: str = "instance_class", status: str = "status",
) -> DataFrame:
    """Desired against actual instance class: done, modifying or drifted."""
    same = F.col(wanted) == F.col(have)
    verdict = (
        F.when(same & (F.col(status) == "available"), F.lit("done"))
        .when(~same & (F.col(status) == "modifying"), F.lit("modifying"))
        .otherwise(F.lit("drifted"))
    )
    return desired.select(*on, wanted).join(actual.select(*on, have, status), list(on)).withColumn("result", verdict)


def txid_age(df: DataFrame, age: str = "frozen_age", keep: Sequence[str] = ("datname",), top: int | None = None) -> DataFrame:
    """Databases or tables with the age of their transactions; with ``top`` the oldest ones, in order."""
    out = df.select(*keep, age)
    return out if top is None else out.orderBy(F.col(age).desc(), *keep).limit(top)


def txid_limit(
    used: DataFrame, settings: DataFrame, on: Sequence[str] = ("instance",), value: str = "value",
    limit: str = "freeze_max_age", default: int = DEFAULT_FREEZE_LIMIT, factor: float = 1.05,
) -> DataFrame:
    """Instances whose limit is at or below the transactions in use times ``factor``."""
    joined = used.select(*on, F.round(F.col(value), 0).cast("bigint").alias("used")).join(
        settings.select(*on, F.col(limit).alias("_limit")), list(on), "left")
    return (
        joined.select(*on, "used", F.coalesce(F.col("_limit"), F.lit(default)).cast("bigint").alias("limit"))
        .filter(F.col("limit") <= F.col("used") * F.lit(factor))
    )
