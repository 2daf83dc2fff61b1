"""Stored tables that change as one: versioned folders and a manifest that names the current ones.

Every commit writes its rows to a new folder ``data/<name>/version=N`` and then,
last, one small manifest file that lists, for each part of each table, the
folder that holds it now. A job that stops before the manifest changes nothing,
and a reader sees all of a commit or none of it. Manifests take turns in a
fixed number of places, so finding the newest costs the same for ever. One
writer at a time is assumed; any file system Spark can reach will do.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places manifests take turns in; a reader that has begun on one may take so many commits less one to finish.
PLACES = 8
MANIFEST = "version bigint, `table` string, part string, kind string, folder string"
#: Kinds of entries: a part of a table, changes not yet folded in, a note (say, how far a stream has come), a folder replaced by ``version``.
PART, LOG, NOTE, OLD = "part", "log", "note", "old"


@dataclass(frozen=True)
class Entry:
    table: str
    part: str
    kind: str
    folder: str


@dataclass(frozen=True)
class Manifest:
    """The newest commit of a store; version 0 is the empty store."""

    version: int
    entries: tuple[Entry, ...]

    def of(self, table: str, kind: str = PART) -> list[Entry]:
        return [e for e in self.entries if e.table == table and e.kind == kind]

    def note(self, name: str) -> str | None:
        return next((e.folder for e in self.of(name, NOTE)), None)


def load(spark: SparkSession, root: str) -> Manifest:
    """The newest complete manifest below ``root``."""
    try:
        # A place that is being written anew holds the oldest manifest, which nobody needs.
        found = spark.read.schema(MANIFEST).option("ignoreMissingFiles", "true").parquet(f"{root}/manifest")
        newest = found.where(F.col("version") == found.agg(F.max("version")).scalar())
        rows = newest.select("version", "table", "part", "kind", "folder").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    entries = tuple(sorted((Entry(r.table, r.part, r.kind, r.folder) for r in rows if r.kind), key=lambda e: (e.table, e.kind, e.folder, e.part)))
    return Manifest(rows[0].version if rows else 0, entries)


def commit(spark: SparkSession, root: str, before: Manifest, entries: Iterable[Entry]) -> Manifest:
    """Make ``entries`` the whole of the store, as the version after ``before``."""
    after = Manifest(before.version + 1, tuple(entries))
    # A row without a kind keeps a version without entries.
    rows = [(after.version, None, None, None, None), *[(after.version, e.table, e.part, e.kind, e.folder) for e in after.entries]]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/place={after.version % PLACES}")
    return after


def folder_of(manifest: Manifest, table: str, kind: str = PART) -> str:
    """Where the commit after ``manifest`` puts rows of a table, relative to the store; what a failed commit left there is replaced."""
    return f"{kind}/{table}/version={manifest.version + 1}"


def write_parts(df: DataFrame, root: str, folder: str, part: str) -> list[str]:
    """Write rows into one folder per value of the column ``part`` and return these values as text."""
    df.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(f"{root}/{folder}")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{folder}")
    # Values of the partition column come from the folders' names alone.
    return sorted(r[0] for r in written.select(F.col(part).cast("string")).distinct().collect() if r[0] is not None)


def read_parts(spark: SparkSession, root: str, entries: Iterable[Entry], schema, part: str) -> DataFrame:
    """The rows of the given entries; of each folder only the parts that are current are opened."""
    by_folder: dict[str, list[str]] = defaultdict(list)
    for e in entries:
        by_folder[e.folder].append(e.part)
    found = spark.createDataFrame([], schema)
    for folder, parts in sorted(by_folder.items()):
        rows = spark.read.schema(found.schema).parquet(f"{root}/{folder}").where(F.col(part).cast("string").isin(parts))
        found = found.unionByName(rows)
    return found


def replaced(before: Manifest, table: str, parts: Iterable[str]) -> tuple[list[Entry], list[Entry]]:
    """A table's entries that stay when ``parts`` are written anew, and a mark on each folder that none of them uses any longer."""
    gone = set(parts)
    stay = [e for e in before.of(table) if e.part not in gone]
    unused = {e.folder for e in before.of(table)} - {e.folder for e in stay}
    return stay, [Entry(table, str(before.version + 1), OLD, f) for f in sorted(unused)]


def reclaim(spark: SparkSession, root: str, keep: int = PLACES) -> int:
    """Empty the folders that were replaced ``keep`` or more versions ago; returns how many.

    Public interfaces do not delete, so a folder is written over without rows.
    """
    before = load(spark, root)
    due = [e for e in before.entries if e.kind == OLD and int(e.part) + keep <= before.version]
    for e in due:
        spark.createDataFrame([], "gone boolean").write.mode("overwrite").parquet(f"{root}/{e.folder}")
    if due:
        commit(spark, root, before, [e for e in before.entries if e not in due])
    return len(due)
