"""One change stream applied to many stored tables, each batch as a whole.

A micro-batch is parsed once and written by one job for all tables; the
manifest of the store (``sources.store``) is written last, so a batch that
fails in any table changes none, and a repeated batch counts once. A stored
table is a base in buckets of its keys and the changes since; ``compact_table``
folds the changes in and writes anew only the buckets they touch.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import flatten_changes, replay_flat
from ..session import cut_lineage
from ..sources import store
from ..sources.store import LOG, NOTE, PART, Entry

BUCKET = "_bucket"


@dataclass(frozen=True)
class StoredTable:
    """A table of the source (``schema.table``) with the types of its keys and other columns, kept in ``buckets`` buckets.

    Values are typed when they are written; with ``strict`` one that does not
    fit its type fails the batch.
    """

    table: str
    keys: Mapping[str, str]
    columns: Mapping[str, str]
    schema: str = "public"
    buckets: int = 64
    strict: bool = True

    @property
    def name(self) -> str:
        return f"{self.schema}.{self.table}"

    def fields(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in {**self.keys, **self.columns, BUCKET: "int"}.items()))

    def bucket(self, prefix: str = "") -> Column:
        """A row's bucket, by the hash of its typed keys."""
        return F.pmod(F.xxhash64(*[F.col(f"{prefix}{k}").cast(t) for k, t in self.keys.items()]), F.lit(self.buckets)).cast("int")


def create_table(df: DataFrame, root: str, table: StoredTable) -> None:
    """Store ``df`` as the table's base, in place of any earlier one and of the changes since."""
    spark, before = df.sparkSession, store.load(df.sparkSession, root)
    folder = store.folder_of(before, table.name)
    rows = df.select(*[F.col(c).cast(t).alias(c) for c, t in {**table.keys, **table.columns}.items()])
    parts = store.write_parts(rows.withColumn(BUCKET, table.bucket()), root, folder, BUCKET)
    _, old = store.replaced(before, table.name, [e.part for e in before.of(table.name)])
    others = [e for e in before.entries if e.table != table.name or e.kind not in (PART, LOG)]
    store.commit(spark, root, before, [*others, *old, *[Entry(table.name, p, PART, folder) for p in parts]])


def _misfits(tables: Sequence[StoredTable]) -> list[Column]:
    """For each column and type and either map: what is wrong with a value that does not fit, or null."""
    having: dict[tuple[str, str], list[str]] = defaultdict(list)
    for t in tables:
        for typed in {**t.keys, **t.columns}.items():
            having[typed].append(t.name)
    found = []
    for (c, kind), names in having.items():
        for m in ("cols", "oldkeys"):
            value = F.try_element_at(F.col(m), F.lit(c))
            wrong = F.col("_table").isin(names) & value.isNotNull() & value.try_cast(kind).isNull()
            found.append(F.when(wrong, F.concat("_table", F.lit(f".{c} is no {kind}: "), value)))
    return found


def _typed(batch: DataFrame, tables: Sequence[StoredTable], seq: Column) -> DataFrame:
    """Decoded changes of the wanted tables, values as text, with the buckets of the old and the new key."""
    def text(m: str) -> Column:
        if isinstance(batch.schema[m].dataType.valueType, T.VariantType):
            return F.transform_values(F.col(m), lambda _, v: F.try_variant_get(v, "$", "string"))
        return F.col(m)

    def key(m: str, k: str, other: str) -> Column:
        return F.coalesce(F.try_element_at(F.col(m), F.lit(k)), F.try_element_at(F.col(other), F.lit(k)))

    rows = batch.select(
        F.concat_ws(".", "schema", "table").alias("_table"), F.col("kind"), seq.alias("seq"), text("cols").alias("cols"), text("oldkeys").alias("oldkeys"))
    rows = rows.where(F.col("_table").isin([t.name for t in tables]))
    before = after = F.lit(None).cast("int")
    # Tables of the same keys, or with the same column, share an expression: one function of too many is never compiled by the JVM.
    alike: dict[tuple, list[str]] = defaultdict(list)
    for t in tables:
        alike[tuple(t.keys.items()), t.buckets].append(t.name)
    for (keys, buckets), names in alike.items():
        own = F.col("_table").isin(names)

        def place(m: str, other: str) -> Column:
            return F.pmod(F.xxhash64(*[key(m, k, other).try_cast(kind) for k, kind in keys]), F.lit(buckets)).cast("int")

        before = F.when(own, place("oldkeys", "cols")).otherwise(before)
        after = F.when(own, place("cols", "oldkeys")).otherwise(after)
    checked = F.coalesce(F.lit(None).cast("string"), *_misfits([t for t in tables if t.strict]))
    kind = F.when(checked.isNull(), F.col("kind")).otherwise(F.raise_error(checked))
    return rows.select("_table", kind.alias("kind"), "seq", "cols", "oldkeys", before.alias("_from"), after.alias("_to"))


def apply_tables(
    changes: DataFrame, root: str, checkpoint: str, tables: Sequence[StoredTable], seq: str | Column = "seq", stream: str = "stream",
    every: str = "30 seconds", once: bool = False,
) -> StreamingQuery:
    """Append decoded changes (``changes.decode_changes``) of a stream to the store, batch by batch.

    ``seq`` orders the changes. ``stream`` names the stream in the manifest,
    which notes its last batch: a batch that was committed before is left out.
    Changes of other tables are left out.
    """
    order = F.col(seq) if isinstance(seq, str) else seq

    def save(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, root, tables, order, stream, batch_id)

    writer = changes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def apply_batch(batch: DataFrame, root: str, tables: Sequence[StoredTable], seq: str | Column = "seq", stream: str = "stream", batch_id: int = 0) -> bool:
    """One batch of decoded changes to all tables or, if any of it fails, to none; false if it was committed before."""
    spark = batch.sparkSession
    before = store.load(spark, root)
    last = before.note(stream)
    if last is not None and int(last) >= batch_id:
        return False
    folder = f"{LOG}/{stream}/batch={batch_id}"
    typed = _typed(batch, tables, F.col(seq) if isinstance(seq, str) else seq)
    # One job for all tables; a folder a failed try left is replaced.
    typed.write.mode("overwrite").partitionBy("_table").parquet(f"{root}/{folder}")
    kept = [e for e in before.entries if not (e.kind == NOTE and e.table == stream)]
    # The order's type is that of the log; the manifest keeps it for readers.
    order = T.StructType([T.StructField("seq", typed.schema["seq"].dataType)]).json()
    logs = [Entry(t.name, order, LOG, folder) for t in tables]
    store.commit(spark, root, before, [*kept, *logs, Entry(stream, "", NOTE, str(batch_id))])
    return True


def _log(spark: SparkSession, root: str, table: StoredTable, entries: Sequence[Entry]) -> DataFrame:
    """The unfolded changes of a table, as they were written."""
    fields = T.StructType.fromDDL("kind string, cols map<string,string>, oldkeys map<string,string>, _from int, _to int, _table string")
    fields = T.StructType([*fields, *T.StructType.fromJson(json.loads(entries[0].part))])
    return spark.read.schema(fields).option("basePath", f"{root}/{LOG}").parquet(*[f"{root}/{e.folder}" for e in entries]).where(F.col("_table") == table.name)


def _replayed(base: DataFrame, log: DataFrame, table: StoredTable) -> DataFrame:
    flat = flatten_changes(log, dict(table.keys), dict(table.columns), F.col("seq"))
    return replay_flat(base, flat, list(table.keys), list(table.columns))


def read_table(spark: SparkSession, root: str, table: StoredTable) -> DataFrame:
    """The table as of the newest commit: its base with the changes since replayed."""
    now = store.load(spark, root)
    base = store.read_parts(spark, root, now.of(table.name), table.fields(), BUCKET).drop(BUCKET)
    entries = now.of(table.name, LOG)
    return _replayed(base, _log(spark, root, table, entries), table) if entries else base


def compact_table(spark: SparkSession, root: str, table: StoredTable) -> list[int]:
    """Fold the changes into the base; only the buckets that hold an old or new key of a change are read and written.

    Returns these buckets. The changes stay on disk until ``store.reclaim``, as other tables may still need them.
    """
    before = store.load(spark, root)
    entries = before.of(table.name, LOG)
    if not entries:
        return []
    log = _log(spark, root, table, entries)
    touched = sorted(r[0] for r in log.select(F.explode(F.array("_from", "_to")).alias("b")).distinct().collect())
    old = [e for e in before.of(table.name) if int(e.part) in set(touched)]
    state = _replayed(store.read_parts(spark, root, old, table.fields(), BUCKET).drop(BUCKET), log, table)
    folder = store.folder_of(before, table.name)
    parts = store.write_parts(cut_lineage(state).withColumn(BUCKET, table.bucket()), root, folder, BUCKET) if touched else []
    stay, marks = store.replaced(before, table.name, map(str, touched))
    others = [e for e in before.entries if e.table != table.name or e.kind not in (PART, LOG)]
    needed = {e.folder for e in others if e.kind == LOG}
    marks += [Entry(table.name, str(before.version + 1), store.OLD, e.folder) for e in entries if e.folder not in needed]
    store.commit(spark, root, before, [*others, *stay, *marks, *[Entry(table.name, p, PART, folder) for p in parts]])
    return touched
