"""Statement cost rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..windows import share_of_total


def cut(text: str, n: int | None) -> Column:
    """The first ``n`` characters of a column, all of it without ``n``."""
    return F.col(text) if n is None else F.left(F.col(text), F.lit(n))


def statement_costs(
    st: DataFrame, top: int | None = None, query: str = "query", total: str = "total_time", calls: str = "calls",
    rows: str = "rows", hit: str | None = None, read: str | None = None, n: int | None = None, keys: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Total and mean time, rows, cache-hit percentage and share of all time.

    ``n`` cuts the shown text; ``top`` gives the costliest in order, ties by the whole text.
    """
    shared = share_of_total(st, total, by, 2, "percentage_cpu")
    cols = [
        *keys, F.col(query).alias("_text"), cut(query, n).alias("query"), F.col(total).alias("_total"), F.round(F.col(total), 2).alias("total_time"),
        F.col(calls).alias("calls"), F.col(rows).alias("rows"),
        F.round(F.try_divide(F.col(total), F.col(calls)), 2).alias("avg_time"), "percentage_cpu",
    ]
    if hit and read:
        cols.append(F.round(F.try_divide(F.lit(100.0) * F.col(hit), (F.col(hit) + F.col(read)).cast("double")), 2).alias("hit_percent"))
    out = shared.select(*cols)
    if top is not None:
        out = out.orderBy(F.col("_total").desc(), "_text", *keys).limit(top)
    return out.drop("_text", "_total")


def costs_by_call(
    st: DataFrame, top: int | None = None, query: str = "query", total: str = "total_time", calls: str = "calls",
    rows: str = "rows", temp_read: str = "temp_blks_read", temp_written: str = "temp_blks_written", n: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Time, rows and temporary blocks per call; the block counts are cut to integers."""
    def whole(c: str):
        return F.floor(F.col(c).cast("double") / F.col(calls)).cast("bigint")

    out = st.filter(F.col(calls) != 0).select(
        *keys, F.col(query).alias("_text"), cut(query, n).alias("query"), F.col(calls).alias("calls"), F.col(total).alias("_total"),
        F.round(F.col(total) / F.col(calls), 2).alias("avg_time_ms"),
        whole(rows).alias("avg_rows"), whole(temp_read).alias("avg_tmp_read"), whole(temp_written).alias("avg_temp_written"),
    )
    if top is not None:
        out = out.orderBy(F.col("_total").desc(), "_text", *keys).limit(top)
    return out.drop("_text", "_total")
