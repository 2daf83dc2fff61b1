"""Joins. Sides are broadcast by the optimizer from their measured size, never by a hint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import INSTANCE_SIZES
from ..functions.identity import enum_rank
from .windows import latest


def enrich(facts: DataFrame, dims: DataFrame, on: Sequence[str] | Column, how: str = "inner") -> DataFrame:
    """Facts with the columns of their dimension; ``how="left"`` keeps facts without one."""
    return facts.join(dims, on if isinstance(on, Column) else list(on), how)


def missing_children(
    parent: DataFrame, child: DataFrame, on: Sequence[str], condition: Column | None = None,
    exclude: Column | None = None,
) -> DataFrame:
    """Parents without a child that meets ``condition``, such as tables without a primary key.

    Child keys are made distinct before the shuffle, so a parent with very many
    children costs one row per task.
    """
    kids = (child.filter(condition) if condition is not None else child).select(*on).distinct()
    parents = parent.filter(~F.coalesce(exclude, F.lit(False))) if exclude is not None else parent
    return parents.join(kids, list(on), "left_anti")


def orphans(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key does not occur in ``b``."""
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def lock_holders(
    relations: DataFrame, locks: DataFrame, on: Sequence[str] = ("relation",),
    namespace: str = "relnamespace", min_namespace: int = 2200,
) -> DataFrame:
    """Locks on application relations, those of a namespace at or above ``min_namespace``."""
    return relations.filter(F.col(namespace) >= min_namespace).join(locks, list(on))


def semi(df: DataFrame, keys: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose key tuple occurs in ``keys``; as with ``IN``, a null matches nothing."""
    return df.join(keys.select(*cols).distinct(), list(cols), "left_semi")


def with_scalar(df: DataFrame, scalars: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add columns looked up by key from a frame that has one row per key."""
    return df.join(scalars, list(on), "left")


def with_constants(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


RANGE_STEP = 4096


def expand_range(df: DataFrame, lo: str | Column, hi: str | Column, name: str = "i") -> DataFrame:
    """One row per integer from ``lo`` to ``hi``; none when ``hi`` is below ``lo``.

    A range is cut into up to RANGE_STEP equal parts, each of those again, and
    so on until a part fits one array: no cell holds more than RANGE_STEP
    numbers. The parts of a long range are dealt to all tasks.
    """
    first = (F.col(lo) if isinstance(lo, str) else lo).cast("bigint")
    last = (F.col(hi) if isinstance(hi, str) else hi).cast("bigint")
    out = df.withColumns({"_lo": first, "_hi": last}).filter("_lo <= _hi")
    for width in (RANGE_STEP ** 4, RANGE_STEP ** 3, RANGE_STEP ** 2, RANGE_STEP):
        # Most ranges are shorter than a part and stay one row.
        parts = F.expr(f"sequence(_lo, _hi, CAST(least(greatest(_hi - _lo, 1), {width}) AS BIGINT))")
        begins = F.when(F.col("_hi") - F.col("_lo") < width, F.array("_lo")).otherwise(parts)
        out = out.withColumn("_from", F.explode(begins)).withColumn(
            "_to", F.when(F.col("_hi") - F.col("_lo") < width, F.col("_hi")).otherwise(F.least(F.col("_from") + (width - 1), F.col("_hi"))))
        out = out.drop("_lo", "_hi").withColumnsRenamed({"_from": "_lo", "_to": "_hi"})
    return out.withColumn(name, F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def fk_map(constraints: DataFrame, key_usage: DataFrame, column_usage: DataFrame) -> DataFrame:
    """Foreign keys with their own and their referenced columns, each a sorted distinct list."""
    on = ["table_schema", "constraint_name"]
    foreign = constraints.filter(F.col("constraint_type") == "FOREIGN KEY").select(*on, "table_name")

    def listed(usage: DataFrame, by: list[str], name: str) -> DataFrame:
        # Distinct first, in a hash aggregate: only the distinct names are gathered.
        names = usage.select(*by, "column_name").distinct()
        return names.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("column_name")), ",").alias(name))

    own = listed(key_usage, on, "original_tab_columns")
    theirs = listed(column_usage, [*on, "foreign_table_schema", "foreign_table_name"], "foreign_column_names")
    return foreign.join(own, on).join(theirs, on)


def referencing(references: DataFrame, constraints: DataFrame) -> DataFrame:
    """For each referenced table, the tables and foreign keys that point at it."""
    names = constraints.select("table_schema", "table_name", "constraint_name")
    children = names.toDF("fk_schema_name", "fk_table_name", "fk_name")
    parents = names.toDF("unique_constraint_schema", "table_name", "unique_constraint_name")
    return (
        references.join(
            children,
            (F.col("constraint_name") == F.col("fk_name")) & (F.col("constraint_schema") == F.col("fk_schema_name")),
        )
        .join(parents, ["unique_constraint_schema", "unique_constraint_name"])
        .select(F.col("unique_constraint_schema").alias("table_schema"), "table_name",
                "fk_schema_name", "fk_table_name", "fk_name")
        .distinct()
    )


def index_columns(
    indexes: DataFrame, attributes: DataFrame, table: Sequence[str], index: str = "indexrelname",
    key: str = "indkey", attnum: str = "attnum", attname: str = "attname",
) -> DataFrame:
    """One row per index column, with its 1-based place in the index."""
    places = indexes.select(*table, index, F.posexplode(key).alias("_pos", attnum))
    named = attributes.select(*table, F.col(attnum).cast("int").alias(attnum), attname)
    return (
        places.withColumn(attnum, F.col(attnum).cast("int")).join(named, [*table, attnum])
        .select(*table, index, (F.col("_pos") + 1).cast("bigint").alias("position"), attname)
    )


def has_leading_index(index_cols: DataFrame, table: Sequence[str], column: str, attname: str = "attname") -> DataFrame:
    """Per table, whether some index starts with ``column``."""
    leads = (F.col("position") == 1) & (F.col(attname) == column)
    return index_cols.groupBy(*table).agg(F.max(leads).alias("has_leading_index"))


def latest_inventory(
    endpoints: DataFrame, inventory: DataFrame, on: Sequence[str], updated: str, as_of, max_age: str = "7 days",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Each endpoint with its newest inventory row, if that is younger than ``max_age``."""
    from ..functions.times import fresh

    newest = latest(inventory.filter(fresh(updated, as_of, max_age)), on, updated, tie)
    return endpoints.join(newest, list(on))


def schema_diff(
    a: DataFrame, b: DataFrame, on: Sequence[str] = ("table_schema", "table_name", "column_name"),
    data_type: str = "data_type",
) -> DataFrame:
    """Columns that were added, removed, or whose type changed between two schemas."""
    left = a.select(*on, F.col(data_type).alias("source_type"), F.lit(True).alias("_a"))
    right = b.select(*on, F.col(data_type).alias("target_type"), F.lit(True).alias("_b"))
    change = (
        F.when(F.col("_b").isNull(), F.lit("removed"))
        .when(F.col("_a").isNull(), F.lit("added"))
        .when(~F.col("source_type").eqNullSafe(F.col("target_type")), F.lit("changed"))
    )
    return (
        left.join(right, list(on), "full_outer").withColumn("change", change)
        .filter(F.col("change").isNotNull()).drop("_a", "_b")
    )


def replica_bigger(
    members: DataFrame, cluster: Sequence[str] = ("cluster",), instance: str = "identifier",
    instance_class: str = "instance_class", writer: str = "is_writer", sizes: Sequence[str] = tuple(INSTANCE_SIZES),
) -> DataFrame:
    """Every replica of a larger size than its cluster's primary.

    The primaries are first reduced to one per cluster (the smallest, should a
    cluster list more), so a large cluster yields its replicas and not pairs.
    """
    ranked = members.select(*cluster, instance, instance_class, writer,
                            enum_rank(instance_class, list(sizes)).alias("_rank")).filter(F.col("_rank").isNotNull())
    primary = (
        ranked.filter(F.col(writer)).groupBy(*cluster)
        .agg(F.min(F.struct("_rank", F.col(instance).alias("primary"), F.col(instance_class).alias("primary_class"))).alias("_p"))
        .select(*cluster, F.col("_p._rank").alias("_primary_rank"), "_p.primary", "_p.primary_class")
    )
    replicas = ranked.filter(~F.col(writer)).select(
        *cluster, F.col(instance).alias("replica"), F.col(instance_class).alias("replica_class"), "_rank")
    return (
        replicas.join(primary, list(cluster)).filter(F.col("_rank") > F.col("_primary_rank"))
        .drop("_rank", "_primary_rank")
    )


def attribute_services(
    variables: DataFrame, requirements: DataFrame, variable: str = "variable", service: str = "service",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Which services use which variable, once each."""
    return (
        variables.select(variable, *keep).join(requirements.select(variable, service), variable)
        .select(*keep, service, variable).dropDuplicates()
    )
