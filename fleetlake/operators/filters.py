"""Row filters over activity, operation documents and catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EXPECTED_ROLE_PATTERN
from ..functions.text import not_similar


def slow_or_waiting(
    df: DataFrame, seconds: str = "secs_running", limit: int = 10, wait: str = "WaitState",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Operations that ran longer than ``limit`` seconds or wait for something."""
    found = df.filter((F.col(seconds) > limit) | F.col(wait).isNotNull())
    return found.select(*keep) if keep else found


def lock_waiters(
    df: DataFrame, waiting: str | Column = "waitingForLock", op: str = "op",
    find_and_modify: str | Column = "command.findandmodify",
) -> DataFrame:
    """Writing operations that wait for a lock."""
    waits = F.col(waiting) if isinstance(waiting, str) else waiting
    modify = F.col(find_and_modify) if isinstance(find_and_modify, str) else find_and_modify
    return df.filter(waits & (F.col(op).isin("insert", "update", "remove") | modify.isNotNull()))


def active_in_namespace(
    df: DataFrame, namespace: str, limit: int = 3, ns: str = "ns", seconds: str = "secs_running",
    active: str | None = "active", exact: bool = False,
) -> DataFrame:
    """Active operations longer than ``limit`` seconds whose namespace matches a regular expression or a name."""
    hit = F.col(ns) == namespace if exact else F.col(ns).rlike(namespace)
    cond = hit & (F.col(seconds) > limit)
    return df.filter(cond & F.col(active) if active else cond)


def unknown_types(columns: DataFrame, data_type: str = "data_type", wanted: str = "unknown") -> DataFrame:
    """The distinct unsupported types in use."""
    return columns.filter(F.col(data_type).ilike(wanted)).select(data_type).distinct()


def unexpected_sessions(df: DataFrame, role: str = "usename", pattern: str = EXPECTED_ROLE_PATTERN) -> DataFrame:
    """Sessions of roles outside the expected set."""
    return df.filter(not_similar(role, pattern))


def running(
    df: DataFrame, start: str, as_of, text: str | None = None, n: int | None = None, keep: Sequence[str] = (),
    condition: Column | None = None, name: str = "running_seconds",
) -> DataFrame:
    """Elapsed whole seconds per row with the statement, whole or cut to ``n`` characters.

    The rows are not sorted here; ``ordering.order`` or ``ordering.top`` does that.
    """
    from ..functions.times import seconds_between

    found = df.filter(condition) if condition is not None else df
    shown = [F.left(F.col(text), F.lit(n)).alias(text) if n else F.col(text)] if text else []
    return found.select(seconds_between(start, as_of).alias(name), *keep, *shown)


def omit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The rows without sensitive columns."""
    return df.drop(*cols)
