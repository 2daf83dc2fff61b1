"""Every record of a broker exactly once, however late it comes and however often it is repeated.

A record's place is its partition and offset. All places seen so far are
intervals, cut at blocks of BLOCK offsets: one per block where offsets are
dense, never more than there are records. Each batch meets them block by block,
what is new is stored, and the intervals grow by it; both become current with
one manifest (``sources.store``). No watermark is involved: a partition
that lags by hours loses nothing, and a repeat after days is still one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources import store
from ..sources.store import LOG, NOTE, PART, Entry

KEYS = ("database", "partition")
#: Offsets whose runs one task sorts.
BLOCK = 1 << 16
SEEN = "seen"


def is_covered(value: Column, lows: Column, highs: Column) -> Column:
    """Whether an interval ``[low, high]`` of two ascending arrays holds ``value``; found by halving, false without arrays."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(31))])
    n = F.coalesce(F.size(lows), F.lit(0))
    # Steps grow past the arrays' end without effect; places count from 1.
    at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (step <= n - at) & (F.try_element_at(lows, F.least(at, n - step) + step) <= value), at + step).otherwise(at))
    return F.coalesce(F.try_element_at(highs, F.nullif(at, F.lit(0))) >= value, F.lit(False))


def intervals(places: DataFrame, keys: Sequence[str], offset: str) -> DataFrame:
    """``(keys, low, high)``: the runs of consecutive distinct offsets, cut at blocks of BLOCK offsets."""
    block = F.floor(F.col(offset) / BLOCK)
    within = Window.partitionBy(*keys, "_block").orderBy(offset)
    rows = places.withColumn("_block", block).withColumn("_run", F.col(offset) - F.row_number().over(within))
    return rows.groupBy(*keys, "_block", "_run").agg(F.min(offset).alias("low"), F.max(offset).alias("high")).select(*keys, "low", "high")


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with its intervals as two ascending arrays; intervals that touch or overlap become one."""
    order = Window.partitionBy(*keys).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.withColumn("_new", F.when(reach.isNull() | (F.col("low") > reach + 1), 1).otherwise(0))
    runs = starts.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy(*keys, "_run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    listed = whole.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("_all"))
    return listed.select(*keys, F.col("_all.low").alias("lows"), F.col("_all.high").alias("highs"))


def _start(offset: Column) -> Column:
    """First offset of the block that holds an offset."""
    wide = offset.cast("bigint")
    return wide - F.pmod(wide, F.lit(BLOCK).cast("bigint"))


def _cut(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals ``(keys, _block, low, high)`` cut at the borders of blocks."""
    starts = F.explode(F.sequence(_start(F.col("low")), _start(F.col("high")), F.lit(BLOCK).cast("bigint")))
    rows = parts.select(*keys, "low", "high", starts.alias("_block"))
    return rows.select(*keys, "_block", F.greatest("low", "_block").alias("low"), F.least("high", F.col("_block") + (BLOCK - 1)).alias("high"))


def _seen(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The intervals stored so far, cut at blocks."""
    listed = spark.read.parquet(path).select(*keys, F.explode(F.arrays_zip("lows", "highs")).alias("i"))
    return _cut(listed.select(*keys, F.col("i.lows").cast("bigint").alias("low"), F.col("i.highs").cast("bigint").alias("high")), keys)


def not_covered(records: DataFrame, seen: DataFrame, keys: Sequence[str], offset: str) -> DataFrame:
    """The records no interval of ``seen`` (``keys, _block, low, high``) holds.

    A block's records and intervals are sorted together, and the greatest end
    so far tells; no list of intervals travels with a record.
    """
    marked = records.withColumns({"_block": _start(F.col(offset)), "_low": F.col(offset).cast("bigint"), "_own": F.lit(1)})
    known = seen.select(*keys, "_block", F.col("low").alias("_low"), F.col("high").alias("_high"), F.lit(0).alias("_own"))
    upto = Window.partitionBy(*keys, "_block").orderBy("_low", "_own").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.unionByName(known, allowMissingColumns=True).withColumn("_end", F.max("_high").over(upto))
    fresh = (F.col("_own") == 1) & (F.col("_end").isNull() | (F.col("_end") < F.col("_low")))
    return rows.filter(fresh).select(*records.columns)


def store_once(
    batch: DataFrame, root: str, keys: Sequence[str] = KEYS, offset: str = "offset", stream: str = "records", batch_id: int = 0,
) -> bool:
    """Store the records of a batch that were not stored before; false if the batch was.

    Of records with the same place one stays. Records without an offset have
    no place and are all kept.
    """
    spark, keys = batch.sparkSession, list(keys)
    before = store.load(spark, root)
    last = before.note(stream)
    if last is not None and int(last) >= batch_id:
        return False
    held = next((e.folder for e in before.of(stream) if e.part == SEEN), None)
    placed = batch.filter(F.col(offset).isNotNull()).dropDuplicates([*keys, offset])
    fresh = placed
    if held:
        seen = _seen(spark, f"{root}/{held}", keys)
        fresh = not_covered(placed, seen, keys, offset).select(*batch.columns)
    data = f"{LOG}/{stream}/batch={batch_id}"
    fresh.unionByName(batch.filter(F.col(offset).isNull())).write.mode("overwrite").parquet(f"{root}/{data}")
    stored = spark.read.schema(batch.schema).parquet(f"{root}/{data}").filter(F.col(offset).isNotNull()).select(*keys, offset)
    new = _cut(intervals(stored, keys, offset).withColumns({c: F.col(c).cast("bigint") for c in ("low", "high")}), keys)
    folder = store.folder_of(before, f"{stream}-{SEEN}")
    # One row per block of a partition of the broker.
    grown = merged(new.unionByName(seen) if held else new, [*keys, "_block"]).drop("_block")
    grown.write.mode("overwrite").parquet(f"{root}/{folder}")
    kept = [e for e in before.entries if not (e.table == stream and (e.kind == NOTE or e.part == SEEN))]
    old = [Entry(stream, str(before.version + 1), store.OLD, held)] if held else []
    entries = [Entry(stream, "", LOG, data), Entry(stream, SEEN, PART, folder), Entry(stream, "", NOTE, str(batch_id))]
    store.commit(spark, root, before, [*kept, *old, *entries])
    return True


def stream_once(
    records: DataFrame, root: str, checkpoint: str, keys: Sequence[str] = KEYS, offset: str = "offset", stream: str = "records",
    every: str = "30 seconds", once: bool = False,
) -> StreamingQuery:
    """``store_once`` for every micro-batch of a stream."""
    def save(batch: DataFrame, batch_id: int) -> None:
        store_once(batch, root, keys, offset, stream, batch_id)

    writer = records.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def read_once(spark: SparkSession, root: str, schema: T.StructType | str, stream: str = "records") -> DataFrame:
    """All records stored so far."""
    now = store.load(spark, root)
    folders = [f"{root}/{e.folder}" for e in now.of(stream, LOG)]
    found = spark.createDataFrame([], schema)
    for folder in folders:
        found = found.unionByName(spark.read.schema(found.schema).parquet(folder).select(*found.columns))
    return found


def gather(spark: SparkSession, root: str, schema: T.StructType | str, stream: str = "records") -> None:
    """Write the batches stored so far as one, so that the manifest stays short."""
    before = store.load(spark, root)
    logs = before.of(stream, LOG)
    if len(logs) < 2:
        return
    folder = f"{LOG}/{stream}/upto={before.version + 1}"
    read_once(spark, root, schema, stream).hint("rebalance").write.mode("overwrite").parquet(f"{root}/{folder}")
    old = [Entry(stream, str(before.version + 1), store.OLD, e.folder) for e in logs]
    store.commit(spark, root, before, [*[e for e in before.entries if e not in logs], *old, Entry(stream, "", LOG, folder)])
