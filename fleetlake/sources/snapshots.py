"""Landing snapshots of server views, and fleet-wide fan-out over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import SERVICE_OWNER_PATTERN, SYSTEM_DATABASES
from ..functions.columns import as_time
from ..functions.text import not_similar
from . import store

# Connection address by engine.
JDBC_URL = {
    "postgres": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
}


def jdbc_reader(spark: SparkSession, target: Mapping, view_sql: str, schema: str | None = None) -> DataFrame:
    """The rows of one query on one database; the query runs on the server, ``schema`` fixes the types of its columns."""
    url = JDBC_URL[target.get("engine", "postgres")].format(**target)
    options = {"url": url, "query": view_sql, **({"customSchema": schema} if schema else {}), **target.get("options", {})}
    return spark.read.format("jdbc").options(**options).load()


FAILED = "instance string, database string, error string"


def land_snapshot(
    spark: SparkSession, targets: Sequence[Mapping], view_sql: str, snapshot_ts, path: str | None = None,
    reader: Callable[..., DataFrame] = jdbc_reader, batch: int = 200, run: str | None = None, schema: str | None = None,
) -> DataFrame:
    """One query on many databases, tagged by ``instance``, ``database`` and ``snapshot_ts``.

    ``targets`` is the fleet's connection list; a ``schema`` is handed to the
    reader. Without ``path`` the rows are returned as one frame. With it they
    are written in batches of targets, each one job that reads its databases
    side by side, and become current as one when all is done
    (``read_snapshots``): a ``run`` (default: the snapshot time) that is
    repeated replaces itself, however its batches were cut. The targets that
    could not be read are returned, one row each with the error; a batch that
    fails is taken again target by target, and the others stay. Where a
    driver can be called from a task, ``targets.land_targets`` opens the
    servers there.
    """
    extra = () if schema is None else (schema,)

    def tagged(target: Mapping) -> DataFrame:
        return reader(spark, target, view_sql, *extra).select(
            F.lit(target["instance"]).alias("instance"), F.lit(target["database"]).alias("database"),
            as_time(snapshot_ts).alias("snapshot_ts"), "*")

    if path is None:
        return reduce(DataFrame.unionByName, [tagged(t) for t in targets])
    name = run or re.sub("[^0-9A-Za-z]+", "-", str(snapshot_ts))
    before = store.load(spark, path)
    folder = store.folder_of(before, name)
    landed: list[str] = []
    failed: list[tuple[str, str, str]] = []

    def land(part: Sequence[Mapping], number: str) -> None:
        try:
            rows = reduce(DataFrame.unionByName, [tagged(t) for t in part]).withColumn("snapshot_date", F.to_date("snapshot_ts"))
            rows.write.mode("overwrite").partitionBy("snapshot_date").parquet(f"{path}/{folder}/batch-{number}")
            landed.append(f"{folder}/batch-{number}")
        except Exception as e:  # any error of a driver or server leaves out its target alone
            if len(part) == 1:
                failed.append((part[0]["instance"], part[0]["database"], str(e).split("\n")[0]))
                return
            for k, target in enumerate(part):
                land([target], f"{number}.{k}")

    for i in range(0, len(targets), batch):
        land(targets[i : i + batch], str(i // batch))
    _, old = store.replaced(before, name, [""])
    others = [e for e in before.entries if e.table != name or e.kind != store.PART]
    store.commit(spark, path, before, [*others, *old, *[store.Entry(name, "", store.PART, f) for f in landed]])
    return spark.createDataFrame(failed, FAILED)


def read_snapshots(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The landed rows of all runs, or of one; a column some batch lacks is null there."""
    entries = [e for e in store.load(spark, path).entries if e.kind == store.PART and run in (None, e.table)]
    if not entries:
        raise ValueError(f"no snapshot below {path}")
    parts = [spark.read.parquet(f"{path}/{e.folder}") for e in entries]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def candidate_databases(
    databases: DataFrame, by: Sequence[str] = ("instance",), name: str = "datname", owner: str | None = "owner",
    size: str = "size_bytes", allowed: str | None = "datallowconn", template: str | None = "datistemplate",
    min_bytes: int | None = None, cap: int | None = None,
) -> DataFrame:
    """Application databases, if asked those above ``min_bytes`` and per instance the ``cap`` largest."""
    cond = ~F.col(name).isin(SYSTEM_DATABASES)
    if allowed:
        cond = cond & F.col(allowed)
    if template:
        cond = cond & ~F.col(template)
    if owner:
        cond = cond & not_similar(owner, SERVICE_OWNER_PATTERN)
    if min_bytes is not None:
        cond = cond & (F.col(size) > min_bytes)
    found = databases.filter(cond)
    if cap is None:
        return found
    largest = Window.partitionBy(*by).orderBy(F.col(size).desc(), F.col(name))
    return found.withColumn("_r", F.row_number().over(largest)).filter(F.col("_r") <= cap).drop("_r")


def fan_out(
    operator: Callable[[DataFrame], DataFrame], snapshots: DataFrame, databases: DataFrame,
    instances: DataFrame | None = None, primary: Column | None = None, keys: Sequence[str] = ("instance", "database"),
    endpoint: str | None = None,
) -> DataFrame:
    """Run an operator over the snapshots of the wanted databases of the primaries.

    ``databases`` holds the wanted ``keys``; ``instances`` with ``primary`` keeps
    the primaries of them. The operator carries ``keys`` as its leading group
    columns, so one plan serves the fleet. ``endpoint`` adds the address.
    """
    wanted = databases.select(*keys).distinct()
    if instances is not None:
        masters = instances.filter(primary) if primary is not None else instances
        wanted = wanted.join(masters.select(keys[0]), keys[0], "left_semi")
    out = operator(snapshots.join(wanted, list(keys), "left_semi"))
    if endpoint and instances is not None:
        out = out.join(instances.select(keys[0], endpoint), keys[0], "left")
    return out
