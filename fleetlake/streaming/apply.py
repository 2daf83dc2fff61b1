"""A change stream applied to one table with exactly-once effect.

``log/batch=N`` holds the changes of micro-batch N, ``base/version=N`` the table
after all batches before N. What counts is what the manifest of the store names
(``sources.store``): a batch that stops changes nothing, a repeated one counts
once. The current table is the newest base with the later log replayed;
compaction writes a new base now and then, so a micro-batch costs as much as
its changes and not as much as the table. For many tables, and bases rewritten
by bucket, see ``tables``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import replay_flat
from ..sources import store
from ..sources.store import LOG, OLD, PART, Entry

TABLE = "state"


def numbers(now: store.Manifest, kind: str) -> list[int]:
    """Numbers of the bases (PART) or batches (LOG) that count."""
    return sorted(int(e.part) for e in now.of(TABLE, kind))


def write_base(base: DataFrame, path: str, version: int = 0) -> None:
    """The table before the stream (version 0), or after ``version - 1`` and all batches before it."""
    folder = f"base/version={version}"
    base.write.mode("overwrite").parquet(f"{path}/{folder}")
    before, entry = store.load(base.sparkSession, path), Entry(TABLE, str(version), PART, folder)
    store.commit(base.sparkSession, path, before, [*[e for e in before.entries if e != entry], entry])


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Flattened changes of one batch; a batch that was committed before is left as it is."""
    before, folder = store.load(batch.sparkSession, path), f"log/batch={batch_id}"
    last = max([-1, *numbers(before, LOG), *[v - 1 for v in numbers(before, PART)]])
    if batch_id <= last:
        return
    batch.write.mode("overwrite").parquet(f"{path}/{folder}")
    store.commit(batch.sparkSession, path, before, [*before.entries, Entry(TABLE, str(batch_id), LOG, folder)])


def apply_stream(flat: DataFrame, path: str, checkpoint: str, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Append flattened changes (``changes.flatten_changes``) batch by batch."""
    writer = flat.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, path, batch_id)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def current_state(spark: SparkSession, path: str, keys: Sequence[str], columns: Sequence[str], upto: int | None = None) -> DataFrame:
    """The table after all committed batches (or those up to ``upto``)."""
    now = store.load(spark, path)
    versions = [v for v in numbers(now, PART) if upto is None or v <= upto + 1]
    if not versions:
        raise ValueError(f"no base below {path}")
    base = spark.read.parquet(f"{path}/base/version={versions[-1]}")
    later = [b for b in numbers(now, LOG) if b >= versions[-1] and (upto is None or b <= upto)]
    if not later:
        return base
    log = spark.read.parquet(*[f"{path}/log/batch={b}" for b in later])
    return replay_flat(base, log, keys, columns)


def compact(spark: SparkSession, path: str, keys: Sequence[str], columns: Sequence[str]) -> int:
    """Fold all committed batches into a new base and give up what it replaces; returns its version.

    The base before the new one stays, for readers that have begun on it;
    ``store.reclaim`` frees what is given up.
    """
    before = store.load(spark, path)
    batches, versions = numbers(before, LOG), numbers(before, PART)
    if not batches or batches[-1] + 1 <= versions[-1]:
        return versions[-1]
    version = batches[-1] + 1
    folder = f"base/version={version}"
    current_state(spark, path, keys, columns, batches[-1]).write.mode("overwrite").parquet(f"{path}/{folder}")
    gone = [e for e in before.of(TABLE) if int(e.part) < versions[-1]] + [e for e in before.of(TABLE, LOG) if int(e.part) < versions[-1]]
    kept = [e for e in before.entries if e not in gone]
    marks = [Entry(TABLE, str(before.version + 1), OLD, e.folder) for e in gone]
    store.commit(spark, path, before, [*kept, *marks, Entry(TABLE, str(version), PART, folder)])
    return version
