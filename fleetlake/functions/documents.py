"""Values out of JSON and XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ColumnLike, as_col


def get_paths(json: ColumnLike, paths: str) -> list[Column]:
    """One text column per ``;``-separated path, named after the path."""
    text = as_col(json)
    return [F.get_json_object(text, "$." + p).alias(p) for p in paths.split(";") if p]


def extract_paths(df: DataFrame, json: str, paths: str, keep: list[str] | None = None) -> DataFrame:
    """Rows with the ``keep`` columns and one column per path; ``all`` keeps the whole document."""
    kept = [F.col(c) for c in (keep or [])]
    return df.select(*kept, F.col(json)) if paths == "all" else df.select(*kept, *get_paths(json, paths))


def xml_int(col: ColumnLike, path: str) -> Column:
    return F.xpath_int(as_col(col), F.lit(path))
