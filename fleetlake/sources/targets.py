"""Snapshots of many servers, each read by a task of its own."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import as_time
from . import store
from .store import PART, Entry

#: Rows of a target handed to Spark at a time.
BATCH_ROWS = 10_000
TARGET, FAILURE = "_target", "_error"


def cursor_rows(connect: Callable[[Mapping], object], sql: str) -> Callable[[Mapping], Iterator[tuple]]:
    """A ``fetch`` that runs one statement over a connection of Python's database interface and streams its rows."""
    def fetch(target: Mapping) -> Iterator[tuple]:
        connection = connect(target)
        try:
            cursor = connection.cursor()
            cursor.execute(sql)
            while rows := cursor.fetchmany(BATCH_ROWS):
                yield from rows
        finally:
            connection.close()

    return fetch


def read_targets(spark: SparkSession, targets: Sequence[Mapping], fetch: Callable[[Mapping], Iterable[tuple]], schema: T.StructType | str) -> DataFrame:
    """The rows ``fetch`` yields for every target, with ``_target`` and, in a row of its own, the error of one that failed.

    Every target is a partition: it is opened, read and given up in its task,
    and neither the driver nor another target waits for it or fails with it.
    Rows that came before an error are there; ``land_targets`` leaves them out.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*fields, T.StructField(TARGET, T.StringType()), T.StructField(FAILURE, T.StringType())])
    arrow, names = to_arrow_schema(full), [target_name(t) for t in targets]
    if len(set(names)) < len(names):
        raise ValueError("a target is listed twice")

    class Reader(DataSourceReader):
        def partitions(self) -> Sequence[InputPartition]:
            return [InputPartition(i) for i in range(len(targets))]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            k, rows = partition.value, []

            def batch(error: str | None = None) -> pa.RecordBatch:
                columns = list(zip(*rows)) or [[]] * len(fields)
                if error is not None:
                    columns, n = [[None] for _ in fields], 1
                else:
                    n = len(rows)
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, [names[k]] * n, [error] * n], arrow)], schema=arrow)

            try:
                for row in fetch(targets[k]):
                    rows.append(tuple(row))
                    if len(rows) >= BATCH_ROWS:
                        yield batch()
                        rows = []
                if rows:
                    yield batch()
            except Exception as e:  # any error of a driver or server is that of its target alone
                yield batch(f"{type(e).__name__}: {e}".split("\n")[0])

    class Targets(DataSource):
        @classmethod
        def name(cls) -> str:
            return "fleet_targets"

        def schema(self) -> T.StructType:
            return full

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Targets)
    return spark.read.format("fleet_targets").load()


def target_name(target: Mapping) -> str:
    return f"{target['instance']}/{target['database']}"


def land_targets(
    spark: SparkSession, targets: Sequence[Mapping], fetch: Callable[[Mapping], Iterable[tuple]], schema: T.StructType | str, snapshot_ts, path: str,
    run: str | None = None,
) -> DataFrame:
    """Land one snapshot of every target in one job and return the targets that failed, with their errors.

    The rows go to a folder of this landing, and the manifest then names, for
    the ``run`` (default: the snapshot time), the targets that were read whole.
    A run that is repeated replaces itself, whatever failed the first time; a
    landing that stops leaves the earlier one as it was.
    """
    name = run or re.sub("[^0-9A-Za-z]+", "-", str(snapshot_ts))
    before = store.load(spark, path)
    folder = store.folder_of(before, name)
    rows = read_targets(spark, targets, fetch, schema).withColumn("snapshot_ts", as_time(snapshot_ts))
    rows.write.mode("overwrite").partitionBy(TARGET).parquet(f"{path}/{folder}")
    back = spark.read.schema(rows.schema).parquet(f"{path}/{folder}")
    failed = {r[TARGET]: r[FAILURE] for r in back.where(F.col(FAILURE).isNotNull()).select(TARGET, FAILURE).collect()}
    _, old = store.replaced(before, name, [e.part for e in before.of(name)])
    others = [e for e in before.entries if e.table != name or e.kind != PART]
    good = [Entry(name, target_name(t), PART, folder) for t in targets if target_name(t) not in failed]
    store.commit(spark, path, before, [*others, *old, *good])
    found = [(t["instance"], t["database"], failed[target_name(t)]) for t in targets if target_name(t) in failed]
    return spark.createDataFrame(found, "instance string, database string, error string")


def read_landed(spark: SparkSession, path: str, schema: T.StructType | str, run: str | None = None) -> DataFrame:
    """The snapshots of all runs, or of one, tagged by ``instance``, ``database`` and ``snapshot_ts``."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    now = store.load(spark, path)
    entries = [e for e in now.entries if e.kind == PART and run in (None, e.table)]
    full = T.StructType([*fields, T.StructField("snapshot_ts", T.TimestampNTZType()), T.StructField(TARGET, T.StringType())])
    rows = store.read_parts(spark, path, entries, full, TARGET)
    cut = F.split(F.col(TARGET), "/", 2)
    return rows.select(cut[0].alias("instance"), cut[1].alias("database"), "snapshot_ts", *[f.name for f in fields])
