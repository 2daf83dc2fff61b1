"""Instance identity: tags, roles, sizes, composite identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLUSTER_ENGINES, SINGLE_ENGINES
from .columns import ColumnLike, as_col


def match_tags(tags: ColumnLike, spec: str | dict[str, list[str]], as_map: bool = True) -> Column:
    """``K=v1,v2;K2=v3``: every key present with one of its values, ignoring case.

    ``tags`` is a map, or with ``as_map=False`` an array of ``struct<Key,Value>``.
    The entries are searched in place, so keys that differ only in case do not
    collide; the last of them counts.
    """
    if isinstance(spec, str):
        spec = {k: v.split(",") for k, v in (part.split("=", 1) for part in spec.split(";"))}
    entries = F.map_entries(as_col(tags)) if as_map else as_col(tags)
    key, value = ("key", "value") if as_map else ("Key", "Value")

    def has(name: str, values: list[str]) -> Column:
        own = F.filter(entries, lambda e: F.upper(e[key]) == name.upper())
        last = F.try_element_at(own, F.lit(-1))[value]
        return F.coalesce(F.upper(last).isin([v.upper() for v in values]), F.lit(False))

    return reduce(lambda a, b: a & b, [has(n, v) for n, v in spec.items()])


def is_primary(
    engine: ColumnLike = "Engine",
    writer: ColumnLike = "IsClusterWriter",
    source: ColumnLike = "ReadReplicaSourceDBInstanceIdentifier",
) -> Column:
    """Cluster engines go by the writer flag, single ones by having no replica source; others are none."""
    kind = as_col(engine)
    return F.coalesce(
        F.when(kind.isin(CLUSTER_ENGINES), as_col(writer))
        .when(kind.isin(SINGLE_ENGINES), as_col(source).isNull()),
        F.lit(False),
    )


def enum_rank(col: ColumnLike, ordered: list[str], part: int | None = 2) -> Column:
    """1-based rank in an ordered list of the text, or of its ``.``-separated part; null if unknown."""
    text = as_col(col)
    if part is not None:
        text = F.get(F.split(text, r"\."), F.lit(part))
    rank = F.array_position(F.array(*[F.lit(v) for v in ordered]), text)
    return F.nullif(rank.cast("bigint"), F.lit(0).cast("bigint"))


def split_identifier(col: ColumnLike) -> Column:
    """``name-re-gi-on-account`` as a struct: the last part is the account, the three before it the region."""
    parts = F.split(as_col(col), "-")
    n = F.size(parts)
    return F.struct(
        F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 4, F.lit(0))), "-").alias("name"),
        F.array_join(F.slice(parts, F.greatest(n - 3, F.lit(1)), F.lit(3)), "-").alias("region"),
        F.element_at(parts, -1).alias("account"),
    )
