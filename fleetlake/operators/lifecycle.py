"""Bulk table jobs: purge, range copy, widening, verification, partitioned rewrite."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_time, int_div
from .blocks import int_block, row_numbers, running_sum, with_blocks

HUGE_TABLE_ROWS = 10_000_000


class Purge(NamedTuple):
    kept: DataFrame
    purged: DataFrame
    plan: DataFrame


def purge(
    df: DataFrame, where: Column, key: str | Sequence[str] | None, limit: int = 1000, force: bool = False,
    span: int = 1 << 20,
) -> Purge:
    """Split rows by a predicate and deal the purged ones into batches of ``limit`` in key order.

    A row whose predicate is null is kept. Without a single-column key the call
    is refused, unless ``force`` allows batches of whole row tuples. The key is
    of any type that has an order; keys are numbered in blocks of about ``span`` rows.
    """
    # The bare predicate can reach the scan; a null one is not true and so stays with the kept rows.
    kept, purged = df.filter(~where | where.isNull()), df.filter(where)
    cols = [key] if isinstance(key, str) else list(key or [])
    if len(cols) == 1:
        keys = with_blocks(purged.select(*cols), cols[0], span)
        numbered = row_numbers(keys, cols[0], block=F.col("_blk"))
        batch = int_div(F.col("row_no") - 1, limit) + 1
        plan = numbered.select(*cols, batch.alias("batch"), F.lit(1).cast("bigint").alias("rows"))
        return Purge(kept, purged, plan)
    if not force:
        raise ValueError("the table has no single-column key; pass force=True to purge by whole rows")
    # Equal rows go together, as a row-tuple IN removes them, and are counted before the shuffle.
    tuples = purged.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("rows")).withColumn("_hash", F.xxhash64(*df.columns))
    # Hashes are spread evenly, so equal ranges of them hold about equal numbers of tuples.
    blocks = max(1, purged.count() // span)
    numbered = row_numbers(tuples, "_hash", block=F.floor((F.col("_hash") / F.lit(2.0**64) + 0.5) * blocks))
    return Purge(kept, purged, numbered.withColumn("batch", int_div(F.col("row_no") - 1, limit) + 1).drop("_hash", "row_no"))


def purge_progress(plan: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Rows per batch and the total after it."""
    sizes = plan.groupBy("batch").agg(F.sum("rows").alias("rows"))
    # Batches are numbered without gaps, so equal spans hold equal numbers of rows.
    return running_sum(sizes, "batch", "rows", block=int_block(F.col("batch"), span))


def copy_range(
    src: DataFrame, dst: DataFrame, key: str, lo, hi, unique: Sequence[str],
) -> DataFrame:
    """Rows of ``src`` in ``[lo, hi]`` that ``dst`` does not hold yet, one per unique key.

    As in a database, keys with a null are never equal: such rows are all copied.
    When ``key`` is part of the unique key the target is read in the same range only.
    """
    span = F.col(key).between(F.lit(lo), F.lit(hi))
    present = dst.filter(span) if key in unique else dst
    rows, whole = src.filter(span), F.lit(True)
    for c in unique:
        whole = whole & F.col(c).isNotNull()
    once = rows.filter(whole).dropDuplicates(list(unique)).join(present.select(*unique), list(unique), "left_anti").select(*src.columns)
    return once.unionByName(rows.filter(~whole))


def resume_point(progress: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Where a stopped copy goes on: the least of the workers' last keys."""
    return (progress.groupBy(*by) if by else progress).agg(F.min(value).alias("resume_from"))


def huge_tables(counts: DataFrame, rows: str = "row_count", threshold: int = HUGE_TABLE_ROWS) -> DataFrame:
    """The tables of a count report with more than ``threshold`` rows: those whose integers should be widened."""
    return counts.filter(F.col(rows) > threshold)


def widen_schema(df: DataFrame) -> DataFrame:
    """The table with its integers as bigints; ``huge_tables`` says which tables need it."""
    return df.select(*[
        F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f.name)
        for f in df.schema.fields
    ])


def backfill(df: DataFrame, src: str, dst: str, type_: str = "bigint", lo=None, hi=None) -> DataFrame:
    """Fill ``dst`` from ``src`` for keys in ``[lo, hi)``; outside, ``dst`` keeps what it had."""
    value = F.col(src).cast(type_)
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (F.col(src) >= F.lit(lo))
    if hi is not None:
        inside = inside & (F.col(src) < F.lit(hi))
    before = F.col(dst).cast(type_) if dst in df.columns else F.lit(None).cast(type_)
    return df.withColumn(dst, F.when(inside, value).otherwise(before))


def compare_counts(a: DataFrame, b: DataFrame, content: bool = False) -> DataFrame:
    """Row counts of both sides in one row; ``content`` also compares an order-free hash of all rows."""
    def summary(df: DataFrame, side: str) -> DataFrame:
        aggs = [F.count(F.lit(1)).alias("n")]
        if content:
            # A null adds nothing to a hash of its own, so its place is hashed beside the values.
            nulls = [F.col(c).isNull() for c in df.columns]
            aggs.append(F.sum(F.xxhash64(*nulls, *df.columns).cast("decimal(38,0)")).alias("h"))
        return df.agg(*aggs).withColumn("side", F.lit(side))

    both = summary(a, "source").unionByName(summary(b, "target"))

    def pick(col: str, side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(col)))

    out = both.agg(pick("n", "source").alias("source_rows"), pick("n", "target").alias("target_rows"),
                   *([pick("h", "source").alias("_a"), pick("h", "target").alias("_b")] if content else []))
    same = F.col("source_rows") == F.col("target_rows")
    if content:
        out = out.withColumn("same_content", same & F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b")
    return out.withColumn("same_count", same)


def sequence_targets(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The value to set each table's sequence to: its greatest key, or 1."""
    parts = [
        df.agg(F.coalesce(F.max(col).cast("bigint"), F.lit(1).cast("bigint")).alias("set_to"))
        .select(F.lit(name).alias("table_name"), F.lit(col).alias("column_name"), "set_to")
        for name, (df, col) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def orphan_sequence_targets(
    seqs: DataFrame, attached: DataFrame, on: Sequence[str] = ("schemaname", "seqname"), last: str = "last_value",
) -> DataFrame:
    """Sequences no table owns, with the next value to set."""
    return (
        seqs.join(attached.select(*on).distinct(), list(on), "left_anti")
        .select(*on, (F.col(last) + 1).alias("set_to"))
    )


def repartition_table(
    df: DataFrame, ts: str, interval: str = "month", start=None, retention: str | None = None, as_of=None,
    name: str = "part",
) -> DataFrame:
    """Rows with the partition of ``interval`` they belong to, without partitions past ``retention``.

    Rows before ``start`` go to the partition ``default``. A partition is past
    retention when it ends at or before ``as_of`` minus ``retention``.
    """
    begin = F.date_trunc(interval, F.col(ts)).cast("timestamp_ntz")
    label = F.date_format(begin, "yyyy-MM-dd HH:mm:ss" if interval in ("hour", "minute") else "yyyy-MM-dd")
    if start is not None:
        label = F.when(F.col(ts) < as_time(start), F.lit("default")).otherwise(label)
    rows = df
    if retention is not None:
        cutoff = as_time(as_of) - F.expr(f"interval {retention}")
        first_kept = F.date_trunc(interval, cutoff).cast("timestamp_ntz")
        # A bare comparison on the time column, so it can reach the scan.
        rows = df.filter(F.col(ts) >= first_kept)
    return rows.withColumn(name, label)


def write_partitioned(df: DataFrame, path: str, part: str = "part", mode: str = "overwrite") -> None:
    """Write one folder per partition in files of even size: small partitions share a task, a hot one is split."""
    df.hint("rebalance", part).write.mode(mode).partitionBy(part).parquet(path)


def readiness(
    tables: DataFrame, index_cols: DataFrame, constraints: DataFrame, references: DataFrame,
    on: Sequence[str] = ("schemaname", "relname"), key: str = "key_column", attname: str = "attname",
) -> DataFrame:
    """What stands in the way of a bulk job: one row per table and obstacle.

    ``tables`` names each table's chosen key, ``index_cols`` comes from
    ``joins.index_columns``, ``constraints`` has one row per primary-key column,
    ``references`` one row per foreign key that points at the table.
    """
    on = list(on)
    leads = index_cols.filter(F.col("position") == 1).select(*on, F.col(attname).alias(key)).distinct()
    no_index = tables.join(leads, [*on, key], "left_anti").select(*on, F.lit("key leads no index").alias("obstacle"))
    width = constraints.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    no_key = (
        tables.join(width, on, "left")
        .select(*on, F.when(F.col("_n").isNull(), F.lit("no primary key"))
                .when(F.col("_n") > 1, F.lit("composite primary key")).alias("obstacle"))
        .filter(F.col("obstacle").isNotNull())
    )
    referred = tables.join(references.select(*on).distinct(), on, "left_semi").select(
        *on, F.lit("referenced by other tables").alias("obstacle"))
    return no_index.unionByName(no_key).unionByName(referred)


def copy_tables(
    names: Sequence[str], read: Callable[[str], DataFrame], write: Callable[[DataFrame, str], None],
) -> list[str]:
    """Copy the named tables one after another; every copy is a distributed job."""
    for name in names:
        write(read(name), name)
    return list(names)
