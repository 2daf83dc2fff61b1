"""Findings, text rendering and the inventory tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import as_time
from ..operators.aggregates import inventory_tree
from ..session import cut_lineage
from . import store


def findings(
    df: DataFrame, check_id: str, obj: str, as_of, keys: Sequence[str] = ("instance", "database"),
    severity: str | Column = "warning", message: Column | None = None, details: Sequence[str] = (),
) -> DataFrame:
    """Result rows in the common finding shape, one per alias (check, keys and object).

    The alias joins its parts by hyphens; a hyphen or backslash of a part is
    escaped and a null part is written ``\\N``, so different parts never share one.
    """
    level = F.lit(severity) if isinstance(severity, str) else severity
    own = [F.col(k) for k in keys]
    pairs = [x for d in details for x in (F.lit(d), F.col(d).cast("string"))]
    extra = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    out = df.select(
        F.lit(check_id).alias("check_id"), *own, F.col(obj).cast("string").alias("object"), level.alias("severity"),
        (message if message is not None else F.lit(check_id)).alias("message"), extra.alias("details"),
        as_time(as_of).alias("as_of"),
        F.concat_ws("-", *[alias_part(c) for c in (F.lit(check_id), *own, F.col(obj))]).alias("alias"),
    )
    return out.dropDuplicates(["alias"])


def alias_part(c: Column) -> Column:
    text = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
    return F.coalesce(F.replace(text, F.lit("-"), F.lit("\\-")), F.lit("\\N"))


FINDINGS = "findings"


def write_findings(df: DataFrame, path: str) -> None:
    """Store findings, one part per check; an alias stored before is replaced.

    Only the checks in ``df`` are written anew, to a folder of their own. What
    was stored stays current until the manifest names that folder, so a job
    that stops loses nothing (see ``store``).
    """
    spark, new = df.sparkSession, cut_lineage(df)
    before = store.load(spark, path)
    checks = [r[0] for r in new.select("check_id").distinct().collect()]
    stored = [e for e in before.of(FINDINGS) if e.part in checks]
    old = store.read_parts(spark, path, stored, df.schema, "check_id")
    kept = old.join(new.select("alias"), "alias", "left_anti").select(*new.columns)
    folder = store.folder_of(before, FINDINGS)
    parts = store.write_parts(new.unionByName(kept), path, folder, "check_id")
    stay, marks = store.replaced(before, FINDINGS, checks)
    others = [e for e in before.entries if e.table != FINDINGS or e.kind != store.PART]
    store.commit(spark, path, before, [*others, *stay, *marks, *[store.Entry(FINDINGS, p, store.PART, folder) for p in parts]])


def read_findings(spark: SparkSession, path: str, keys: Sequence[str] = ("instance", "database")) -> DataFrame:
    """All stored findings; ``keys`` are the columns they were found by."""
    own = "".join(f"`{k}` string, " for k in keys)
    fields = f"check_id string, {own}object string, severity string, message string, details map<string,string>, as_of timestamp_ntz, alias string"
    return store.read_parts(spark, path, store.load(spark, path).of(FINDINGS), fields, "check_id")


def render_rows(df: DataFrame, sep: str = ",") -> DataFrame:
    """Rows as joined text in ``line``, after one header row (``is_header``)."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    body = df.select(F.lit(False).alias("is_header"), F.concat_ws(sep, *cells).alias("line"))
    head = df.sparkSession.range(1).select(F.lit(True).alias("is_header"), F.lit(sep.join(df.columns)).alias("line"))
    return head.unionByName(body)


def write_tree(df: DataFrame, path: str, mode: str = "overwrite", **levels) -> None:
    """Write the inventory tree as indented text, sorted over as many files as tasks."""
    inventory_tree(df, **levels).orderBy("path").select("line").write.mode(mode).text(path)
