"""Helpers the operators share: reading tables, cutting lineage, batches of text."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage

__all__ = ["checkpoint_dir", "cut_lineage", "held_out", "pieces_of", "raw", "release", "shared_path", "small_batches", "table", "values"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held_out(doc_id: str, folds: int) -> Column:
    """Whether crc32 of the identifier as text has remainder 1 (a null identifier: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 1, F.lit(False))


#: Bytes of rows handed to Python at a time.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session told to hand rows to Python in batches of BATCH_BYTES.

    Spark's own bound is 64 MB, which a task holds several times over with long texts.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def release() -> None:
    """Give back to the system what a task has freed: Python workers outlive tasks and share the executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def values(array: pa.Array, step: int = 64) -> Iterator:
    """The values of an array as Python objects, a few at a time: a batch of texts is not held twice."""
    for i in range(0, len(array), step):
        yield from array.slice(i, step).to_pylist()


def raw(texts: pa.Array) -> Iterator[bytes | None]:
    """The bytes of a text array, a few at a time."""
    return values(texts.cast(pa.large_binary()))


def pieces_of(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of ``column`` each, a single longer row on its own."""
    start, size = 0, 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)
