"""Gaps, shares, trends and latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import epoch_micros
from .blocks import DEFAULT_SPAN, join_null_safe, time_block, with_blocks, with_halo


def gaps(df: DataFrame, key: str, by: Sequence[str] = (), top: int | None = None, span: int = DEFAULT_SPAN) -> DataFrame:
    """Runs of missing values in a unique integer key; with ``top`` the widest (per series), in order.

    The head row reports what lies below the smallest key and, as the fleet's
    scripts print it, ends at that key. ``diff`` is the distance between the
    neighbours, ``missing`` the count of absent keys, ``last_missing`` the last
    of them. The keys are cut into blocks of about ``span`` rows.
    """
    by = list(by)
    ids = df.select(*by, F.col(key).cast("bigint").alias("_id")).filter(F.col("_id").isNotNull())
    looked = with_halo(with_blocks(ids, "_id", span), by, "_id", F.col("_blk"))
    w = Window.partitionBy(*by, "_block").orderBy("_id")
    # Only the first key of a series has nothing before it; its gap is the head row.
    head = F.col("_prev").isNull()
    found = (
        looked.withColumn("_prev", F.lag("_id").over(w))
        .filter(~F.col("_halo") & (head | (F.col("_prev") + 1 != F.col("_id"))))
        .select(
            *by, F.when(head, F.lit(0)).otherwise(F.col("_prev") + 1).alias("gap_start"),
            F.when(head, F.col("_id")).otherwise(F.col("_id") - 1).alias("gap_end"),
            (F.col("_id") - F.coalesce("_prev", F.lit(0))).alias("diff"),
            F.when(head, F.col("_id")).otherwise(F.col("_id") - F.col("_prev") - 1).alias("missing"),
        )
        .withColumn("last_missing", F.col("gap_start") + F.col("missing") - 1)
    )
    order = [F.col("diff").desc(), F.col("gap_start").asc()]
    if top is None:
        return found
    if not by:
        return found.orderBy(*order).limit(top)
    best = Window.partitionBy(*by).orderBy(*order)
    return found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top).drop("_r")


def share_of_total(
    df: DataFrame, metric: str | Column, by: Sequence[str] = (), digits: int = 2, name: str = "share_pct"
) -> DataFrame:
    """Each row's percentage of the total of ``metric``, over all rows or per ``by``.

    The total is a one-row subquery (or one row per ``by``), so no window
    gathers the rows themselves.
    """
    value = F.col(metric) if isinstance(metric, str) else metric
    if by:
        totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
        joined = join_null_safe(df, totals, list(by))
    else:
        joined = df.withColumn("_total", df.agg(F.sum(value)).scalar())
    # Sums stay in the type of the metric; only the quotient is a double.
    pct = F.try_divide(value.cast("double") * F.lit(100), F.col("_total").cast("double"))
    return joined.withColumn(name, F.round(pct, digits)).drop("_total")


def ordinal(df: DataFrame, array: str, keep: Sequence[str], name: str = "item", position: str = "position") -> DataFrame:
    """One row per array element with its 1-based place."""
    return df.select(*keep, F.posexplode(array).alias("_pos", name)).select(
        *keep, (F.col("_pos") + 1).cast("bigint").alias(position), name
    )


def trend(
    df: DataFrame, by: Sequence[str], ts: str, value: str, n: int = 5, unit: str = "day"
) -> DataFrame:
    """Least-squares slope per second over each reading and the ``n - 1`` before it.

    Null when fewer than two readings are at hand.
    """
    by = list(by)
    looked = with_halo(df.select(*by, ts, value), by, ts, time_block(F.col(ts), unit), n - 1)
    frame = Window.partitionBy(*by, "_block").orderBy(ts).rowsBetween(-(n - 1), 0)
    # A slope does not depend on the origin; seconds from the block's start keep the sums small.
    x = (epoch_micros(F.col(ts)) - epoch_micros(F.col("_block"))).cast("double") / F.lit(1e6)
    return (
        looked.withColumn("_x", x)
        .withColumns({
            "samples": F.count(value).over(frame),
            "_slope": F.regr_slope(F.col(value), F.col("_x")).over(frame),
        })
        .filter(~F.col("_halo"))
        .select(*by, ts, value, "samples", F.when(F.col("samples") >= 2, F.col("_slope")).alias("slope"))
    )


def eta(df: DataFrame, by: Sequence[str], ts: str, value: str, unit: str = "day") -> DataFrame:
    """Change since the previous reading and the readings left until zero, ``before / (before - now)``.

    9999 stands for unknown (first reading, or no change); a negative figure
    reads "Close to end".
    """
    by = list(by)
    looked = with_halo(df.select(*by, ts, value), by, ts, time_block(F.col(ts), unit), 1)
    w = Window.partitionBy(*by, "_block").orderBy(ts)
    before = F.col("before")
    left = F.bround(F.try_divide(before, before - F.col(value)), 0).cast("bigint")
    return (
        looked.withColumn("before", F.lag(value).over(w)).filter(~F.col("_halo"))
        .withColumn("delta", F.col(value) - before)
        .withColumn("eta", F.coalesce(left, F.lit(9999).cast("bigint")))
        .withColumn("eta_text", F.when(F.col("eta") < 0, F.lit("Close to end"))
                    .otherwise(F.concat(F.col("eta").cast("string"), F.lit(" seconds"))))
        .drop("_block", "_halo")
    )


def latest(df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest ``ts`` (then ``tie``) per key.

    Rows are reduced to one per key in each task before the shuffle. Spark sorts
    for this reduction where a column has no fixed width. Measured over 4.8
    million rows (local[8], seconds): with 1000 keys 1.45, against 1.82 for a
    hashed maximum joined back and 2.19 for a row number; with 1.2 million keys
    2.39, against 3.88 and 2.11.
    """
    by = list(by)
    order = [ts, *tie]
    rest = [c for c in df.columns if c not in by and c not in order]
    best = F.max_by(F.struct(*order, *rest), F.struct(*order))
    return df.groupBy(*by).agg(best.alias("_row")).select(*by, "_row.*").select(*df.columns)
