"""Ordered computations that hold when one series has a large share of all rows.

A window over a whole table, or over one hot series, ends in a single task.
Here the order column is cut into blocks: of about equal numbers of rows by
sampled borders (``with_blocks``), or of a calendar unit of a time. Rows are
shuffled by (series, block), each block is worked on by itself, and what
crosses a border is carried by a summary that has a few rows per block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SPAN = 1 << 20


#: Sampled keys per block, and the most borders the driver holds (beyond that blocks grow; a task sorts its block on disk if it must).
SAMPLES = 16
BORDERS = 1 << 16


def borders(df: DataFrame, key: str, rows: int = DEFAULT_SPAN) -> list[tuple[str, int]]:
    """Values of ``key``, as text in their order, that cut ``df`` into ranges of about ``rows`` rows, and how often each is a cut.

    Every so many-th row of a task is sampled, so one job over the key column
    does it for any type that has an order. A value that fills several ranges
    is named as often. Only the borders reach the driver.
    """
    kind = df.schema[key].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType, T.NullType)):
        raise TypeError(f"{key}: a key to cut by must be a number, a text, a date or a time, not {kind.simpleString()}")
    step = max(1, rows // SAMPLES)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    start = F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(step))
    # The first rows of small tasks are as likely to be sampled as others.
    sample = df.select(F.col(key).alias("k"), F.pmod(place + start, F.lit(step)).alias("p")).where("p = 0 AND k IS NOT NULL").select("k")
    # One task, as it only gets the sample; a row is a cut where the number of whole blocks up to it grows.
    n, row = F.count(F.lit(1)).over(Window.partitionBy()), F.row_number().over(Window.orderBy("k"))
    ranked = sample.select("k", row.alias("r"), n.alias("n")).withColumn("b", F.least(F.floor(F.col("n") * step / rows), F.lit(BORDERS)))
    whole, before = (F.floor(r * F.col("b") / (F.col("n") + 1)) for r in (F.col("r"), F.col("r") - 1))
    cuts = ranked.where(whole > before).select(F.col("k").cast("string"), "r").collect()
    # Equal values have equal texts.
    return list(Counter(k for k, _ in sorted(cuts, key=lambda c: c[1])).items())


def range_of(key: Column, kind: T.DataType, values: Sequence[str]) -> Column:
    """How many of the ascending ``values`` are not greater than ``key``, by halving; 0 for a null."""
    if not values:
        return F.lit(0)
    table = F.array(*[F.lit(v) for v in values]).cast(T.ArrayType(kind))
    n = len(values)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= n) & (F.element_at(table, F.least(at + step, F.lit(n))) <= key), at + step).otherwise(at))


def with_blocks(df: DataFrame, key: str, rows: int = DEFAULT_SPAN, name: str = "_blk") -> DataFrame:
    """``df`` with the block each row belongs to: about ``rows`` rows, in the order of ``key``, whatever its type.

    The borders are sampled, so sparse or clustered keys and names with a
    common beginning fill blocks like any others. A value with more than
    ``rows`` rows gets several blocks, dealt by a hash of the row. ``df`` is
    read once more for the sample.
    """
    cuts = borders(df, key, rows)
    kind, part = df.schema[key].dataType, F.lit(0)
    if hot := [(v, n) for v, n in cuts if n > 1]:
        place = range_of(F.col(key), kind, [v for v, _ in hot])
        is_hot = F.element_at(F.array(*[F.lit(v) for v, _ in hot]).cast(T.ArrayType(kind)), F.greatest(place, F.lit(1))) == F.col(key)
        parts = F.element_at(F.array(*[F.lit(n) for _, n in hot]), F.greatest(place, F.lit(1)))
        # Rows equal to a hot border come before the others of its range.
        part = F.when(is_hot, F.pmod(F.xxhash64(*df.columns), parts).cast("int")).otherwise(F.lit(BORDERS))
    # The range in the upper half, the part in the lower one.
    return df.withColumn(name, F.shiftleft(range_of(F.col(key), kind, [v for v, _ in cuts]).cast("bigint"), 32) + part)


def int_block(key: Column, span: int = DEFAULT_SPAN) -> Column:
    """First key of the block of ``span`` consecutive integers that holds ``key``."""
    wide = key.cast("bigint")
    return wide - F.pmod(wide, F.lit(span).cast("bigint"))


def time_block(ts: Column, unit: str = "day") -> Column:
    return F.date_trunc(unit, ts)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null, keeping the left copy of ``on``.

    A column that is never null on one side is compared by plain equality, which
    lets the join use a partitioning by that column.
    """
    if not on:
        raise ValueError("no columns to join on")
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    cond = None
    for c in on:
        both_null = left.schema[c].nullable and right.schema[c].nullable
        same = F.col(c).eqNullSafe(F.col(f"_right_{c}")) if both_null else F.col(c) == F.col(f"_right_{c}")
        cond = same if cond is None else cond & same
    return left.join(renamed, cond, how).drop(*[f"_right_{c}" for c in on])


def with_halo(df: DataFrame, by: Sequence[str], order: str, block: Column, n: int = 1) -> DataFrame:
    """``df`` plus, for each block, copies of the ``n`` rows that precede it in its series.

    Adds ``_block`` and ``_halo`` (true for the copies). A window over
    ``by + _block`` that looks back at most ``n`` rows is then exact on the rows
    that are not copies. ``order`` must be unique within a series.
    """
    by = list(by)
    cols = df.columns
    marked = df.withColumn("_block", block)
    if n == 1 and set(cols) <= {*by, order, "_blk"}:
        # Nothing but the order column to carry: a plain maximum per block.
        ends = marked.groupBy(*by, "_block").agg(F.max(order).alias("_end"))
        before = F.lag("_end").over(Window.partitionBy(*by).orderBy("_block"))
        copies = ends.select(*by, "_block", before.alias(order), F.lit(True).alias("_halo")).filter(F.col(order).isNotNull())
        return marked.drop("_blk").withColumn("_halo", F.lit(False)).unionByName(copies)
    row = F.struct(F.col(order).alias("_o"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)])
    if n == 1:
        tails = marked.groupBy(*by, "_block").agg(F.array(F.max(row)).alias("_tail"))
    else:
        last = Window.partitionBy(*by, "_block").orderBy(F.col(order).desc())
        tails = (
            marked.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n)
            .groupBy(*by, "_block").agg(F.sort_array(F.collect_list(row)).alias("_tail"))
        )
    # Every block in the summary holds at least one row, so the n blocks before
    # a block hold its n preceding rows.
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(-n, -1)
    rows = F.flatten(F.collect_list("_tail").over(earlier))
    copies = (
        tails.select("_block", rows.alias("_rows"))
        .select("_block", F.explode(F.slice("_rows", F.greatest(F.size("_rows") - n + 1, F.lit(1)), F.lit(n))).alias("_row"))
        .select(*[F.col(f"_row._{i}").alias(c) for i, c in enumerate(cols)], "_block", F.lit(True).alias("_halo"))
    )
    return marked.withColumn("_halo", F.lit(False)).unionByName(copies)


def running(
    df: DataFrame, order: str, value: Column, by: Sequence[str] = (), block: Column | None = None,
    agg=F.sum, name: str = "running", current: bool = True,
) -> DataFrame:
    """``agg`` of ``value`` over the rows of a series up to each row (``current=False``: before it).

    Each block gets one row in front of its own that carries the result of all
    earlier blocks, so the rows are shuffled once and never joined. ``agg`` must
    combine partial results, as sum and max do.
    """
    by = list(by)
    marked = df.withColumns({
        "_block": int_block(F.col(order)) if block is None else block, "_v": value, "_rank": F.lit(1)})
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block: a summary that a single task can order.
    carried = (
        marked.groupBy(*by, "_block").agg(agg("_v").alias("_v"))
        .select(*by, "_block", agg("_v").over(earlier).alias("_v"), F.lit(0).alias("_rank"))
    )
    upto = Window.partitionBy(*by, "_block").orderBy("_rank", order).rowsBetween(
        Window.unboundedPreceding, 0 if current else -1)
    return (
        marked.unionByName(carried, allowMissingColumns=True)
        .withColumn(name, agg("_v").over(upto)).filter(F.col("_rank") == 1).drop("_block", "_v", "_rank")
    )


def row_numbers(
    df: DataFrame, key: str, by: Sequence[str] = (), block: Column | None = None, name: str = "row_no"
) -> DataFrame:
    """Number the rows of each series from 1 in the order of a unique ``key``."""
    return running(df, key, F.lit(1).cast("bigint"), by, block, F.sum, name)


def running_sum(
    df: DataFrame, key: str, value: str, by: Sequence[str] = (), block: Column | None = None, name: str = "cumulative"
) -> DataFrame:
    """Sum of ``value`` up to and including each row, in the order of a unique ``key``."""
    return running(df, key, F.col(value), by, block, F.sum, name)


def greatest_before(
    df: DataFrame, by: Sequence[str], order: str, value: str, block: Column, name: str
) -> DataFrame:
    """The greatest non-null ``value`` of the rows before each row of its series."""
    return running(df, order, F.col(value), by, block, F.max, name, current=False)
