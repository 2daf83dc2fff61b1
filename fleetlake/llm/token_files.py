"""Token ids in files: a wavelet matrix per shard, documents in ascending order of their identifier.

A shard is one row of one compressed Parquet file: identifiers and lengths of
its documents, and the planes of the matrix with their rank directories. Spark
writes and commits the files, so a lost task leaves no half-written shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .encoding import Encoder, encoder
from .frames import pieces_of, small_batches
from .wavelet import Plane, WaveletMatrix

#: Ids of a shard; a shard ends with a document, so a longer document makes a longer one.
SHARD_TOKENS = 1 << 21
BATCH_BYTES = 4_000_000


def _shard_type(kind: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("zeros", T.ArrayType(T.LongType())), T.StructField("planes", T.ArrayType(T.BinaryType())),
        T.StructField("ranks", T.ArrayType(T.BinaryType()))])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0,
                 shard_tokens: int = SHARD_TOKENS, memory: int = 1_000_000) -> None:
    """Encode every text, append ``end`` and write the shards below ``path``.

    Documents are dealt by ranges of the identifier and, where it repeats or is
    null, of the text's hash, so only the texts are shuffled, once. A worker
    remembers up to ``memory`` distinct words from task to task. Null and empty
    texts are the end id alone; null identifiers come first, equal identifiers
    in order of their texts' hash, then text.
    """
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_schema(_shard_type(kind))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary, memory, keep=True) as known:
            yield from encoded(known, batches)

    def encoded(known: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, names, ids, sizes, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            matrix, lengths = WaveletMatrix.of(np.concatenate(ids)), np.concatenate(sizes)
            row = [
                [part], [number], [matrix.size], [[x for n in names for x in n]], [lengths.tolist()], [[p.zeros for p in matrix.planes]],
                [[p.bits.tobytes() for p in matrix.planes]], [[p.before.tobytes() for p in matrix.planes]]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)

        for whole in batches:
            for batch in pieces_of(whole, "text", BATCH_BYTES):
                found, lengths = known.encode(batch.column("text").to_pylist(), end)
                # Documents join the open shard until it is full.
                stops = np.cumsum(lengths)
                first, done = 0, 0
                while first < len(lengths):
                    last = int(np.searchsorted(stops, done + shard_tokens - held, side="right"))
                    last = max(last, first + (not held))
                    if last > first:
                        names.append(batch.column("id").slice(first, last - first).to_pylist())
                        ids.append(found[done:stops[last - 1]])
                        sizes.append(lengths[first:last])
                        held += int(stops[last - 1]) - done
                        first, done = last, int(stops[last - 1])
                    if first < len(lengths):
                        yield shard()
                        number, names, ids, sizes, held = number + 1, [], [], [], 0
        if names:
            yield shard()

    (small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
     .repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text").mapInArrow(shards, _shard_type(kind))
     .write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path))


def _matrix(row: dict) -> WaveletMatrix:
    planes = [
        Plane(np.frombuffer(bits, np.uint8), np.frombuffer(ranks, "<u4"), zeros)
        for bits, ranks, zeros in zip(row["planes"], row["ranks"], row["zeros"])]
    return WaveletMatrix(row["n_tokens"], planes)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(part, shard, first)``: ids of all shards before each; reads the shards' sizes alone."""
    sizes = spark.read.parquet(path).select("part", "shard", "n_tokens")
    # Within a part by its shards; over all parts by one row each.
    own = sizes.withColumn("inside", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("ahead"))
    return own.join(parts, "part").select("part", "shard", (F.col("ahead") + F.col("inside")).alias("first"))


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per document ``(id, start, n_tokens, ids_crc32, ids)`` from the files; ``ids`` are little-endian 32-bit, or left out."""
    kind = spark.read.parquet(path).schema["ids"].dataType.elementType
    out = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("id", kind),
        T.StructField("local", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    arrow = to_arrow_schema(out)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = _matrix(row).decode().astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                local = np.cumsum(lengths) - lengths
                ids = [data[a:a + n] for a, n in zip(local.tolist(), lengths.tolist())]
                columns = [[row["part"]] * len(ids), [row["shard"]] * len(ids), row["ids"], local, lengths, [zlib.crc32(x) for x in ids]]
                columns += [[x.tobytes() for x in ids]] if with_ids else []
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    read = spark.read.parquet(path).mapInArrow(documents, out).join(shard_starts(spark, path), ["part", "shard"])
    return read.select(F.col("id").alias(id_col), (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``place`` of every occurrence of a token, by select on the planes; no shard is decoded."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at = _matrix(row).locate(token)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(at), pa.int32()), pa.array([row["shard"]] * len(at), pa.int32()), pa.array(at)], names=["part", "shard", "at"])

    found = spark.read.parquet(path).drop("ids", "lengths").mapInArrow(places, "part int, shard int, at bigint")
    return found.join(shard_starts(spark, path), ["part", "shard"]).select((F.col("first") + F.col("at")).alias("place"))


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """``(token, n)``: occurrences of each token in all shards, by rank on the planes."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                matrix = _matrix(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return spark.read.parquet(path).drop("ids", "lengths").mapInArrow(counts, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
