"""Top-k, null placement and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_key(spec: str | Column) -> Column:
    """``"-x"`` sorts descending with nulls first, ``"x"`` ascending with nulls last.

    This is the order the fleet's servers use; ``"-x nulls last"`` and
    ``"x nulls first"`` override it.
    """
    if isinstance(spec, Column):
        return spec
    name, _, nulls = spec.partition(" nulls ")
    down = name.startswith("-")
    col = F.col(name.lstrip("-"))
    first = nulls == "first" if nulls else down
    if down:
        return col.desc_nulls_first() if first else col.desc_nulls_last()
    return col.asc_nulls_first() if first else col.asc_nulls_last()


def order(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*[sort_key(k) for k in keys])


def top(df: DataFrame, keys: Sequence[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows; each task keeps only ``k`` rows. End ``keys`` with a unique column."""
    return order(df, keys).limit(k)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for df in others:
        first = first.unionByName(df)
    return first


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    return union_all(first, *others).distinct()


def distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()
