"""Line files read from any line on without counting the lines before it again.

A sparse index keeps, per file, the place of every so many-th line, and of the
end of the last whole line. It is extended by what was appended since; a read
opens the files at the indexed line before the wanted one. Byte ranges are read
in tasks through Arrow's file systems, so the paths must be ones they know.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import store
from .store import PART, Entry

EVERY = 10_000
#: Bytes a task reads, and bytes it holds at a time.
SPLIT_BYTES = 128 << 20
CHUNK_BYTES = 4 << 20
TABLE = "lines"
INDEX = "file string, line bigint, byte bigint, size bigint"


class Range(NamedTuple):
    """Bytes of a file, and the number of the line that begins there."""

    file: str
    start: int
    end: int
    line: int


def _chunks(part: Range) -> Iterator[bytes]:
    where, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", part.file))
    with where.open_input_file(path) as f:
        f.seek(part.start)
        at = part.start
        while at < part.end and (data := f.read(min(CHUNK_BYTES, part.end - at))):
            yield data
            at += len(data)


def _line_ends(part: Range, every: int) -> Iterator[tuple]:
    """One row ``(file, start, lines, numbers, bytes, last)``: line ends of a range, the place behind every so many-th and behind the last."""
    lines, at, last, numbers, places = 0, part.start, None, [], []
    for data in _chunks(part):
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        if len(ends):
            own = np.arange(lines + 1, lines + len(ends) + 1)
            pick = own % every == 0
            numbers += own[pick].tolist()
            places += (ends[pick] + at + 1).tolist()
            last = at + int(ends[-1]) + 1
            lines += len(ends)
        at += len(data)
    yield part.file, part.start, lines, numbers, places, last


def _lines(part: Range) -> Iterator[tuple]:
    """Rows ``(file, number in the file, text)`` of a range that begins with a line; a last line without an end counts."""
    number, rest = part.line, b""
    for data in _chunks(part):
        *whole, rest = (rest + data).split(b"\n")
        for text in whole:
            yield part.file, number, text.decode(errors="replace")
            number += 1
    if rest:
        yield part.file, number, rest.decode(errors="replace")


def _in_tasks(spark: SparkSession, name: str, ranges: Sequence[Range], kind: str, read) -> DataFrame:
    """What ``read`` yields for every range, each in a task of its own."""
    class Reader(DataSourceReader):
        def partitions(self) -> Sequence[InputPartition]:
            return [InputPartition(tuple(r)) for r in ranges]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from read(Range(*partition.value))

    class Ranges(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return kind

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    if not ranges:
        return spark.createDataFrame([], kind)
    spark.dataSource.register(Ranges)
    return spark.read.format(name).load()


def index_lines(spark: SparkSession, path: str, index: str, every: int = EVERY) -> DataFrame:
    """Bring the index of the files below ``path`` up to date and return it; only bytes behind the last indexed line are read.

    Per file it has ``(line, byte)`` of the first line, of every so many-th one
    and of the end of the last whole line, each with the file's ``size`` then. A
    file that became shorter is indexed anew.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")
    before = store.load(spark, index)
    held = next((e.folder for e in before.of(TABLE)), None)
    old = spark.read.schema(INDEX).parquet(f"{index}/{held}") if held else spark.createDataFrame([], INDEX)
    last = old.groupBy("file").agg(F.max(F.struct("line", "byte", "size")).alias("last"))
    state = files.join(last, "file", "left").select("file", "length", "last.line", "last.byte", "last.size").collect()
    anew = [r.file for r in state if r.size is None or r.length < r.size]
    grown = [r for r in state if r.file in set(anew) or r.length > r.size]
    if held and not grown and len(state) == last.count():
        return old
    starts = {r.file: (0, 0) if r.file in set(anew) else (r.line, r.byte) for r in grown}
    ranges = [Range(r.file, a, min(a + SPLIT_BYTES, r.length), 0) for r in grown for a in range(starts[r.file][1], max(r.length, 1), SPLIT_BYTES)]
    ends = _in_tasks(
        spark, "fleet_line_ends", ranges, "file string, start bigint, lines bigint, numbers array<bigint>, places array<bigint>, last bigint", lambda p: _line_ends(p, every))
    first = spark.createDataFrame([(r.file, *starts[r.file], r.length) for r in grown], INDEX)
    # One row per range, so the lines before each are a small sum.
    order = Window.partitionBy("file").orderBy("start")
    numbered = ends.join(first.withColumnRenamed("size", "length"), "file").withColumn("ahead", F.col("line") + F.sum("lines").over(order) - F.col("lines"))
    points = numbered.select("file", "ahead", "length", F.explode(F.arrays_zip("numbers", "places")).alias("p")).select(
        "file", (F.col("ahead") + F.col("p.numbers")).alias("line"), F.col("p.places").alias("byte"), F.col("length").alias("size"))
    tail = numbered.groupBy("file").agg(
        F.max(F.col("ahead") + F.col("lines")).alias("line"), F.max(F.coalesce("last", "byte")).alias("byte"), F.max("length").alias("size"))
    kept = old.join(files, "file", "left_semi").filter(~F.col("file").isin(anew)) if anew else old.join(files, "file", "left_semi")
    new = kept.unionByName(first).unionByName(points).unionByName(tail).groupBy("file", "line").agg(F.max("byte").alias("byte"), F.max("size").alias("size"))
    folder = store.folder_of(before, TABLE)
    new.write.mode("overwrite").parquet(f"{index}/{folder}")
    _, marks = store.replaced(before, TABLE, [e.part for e in before.of(TABLE)])
    store.commit(spark, index, before, [*[e for e in before.entries if e.kind != PART], *marks, Entry(TABLE, "", PART, folder)])
    return spark.read.schema(INDEX).parquet(f"{index}/{folder}")


def read_lines_indexed(spark: SparkSession, path: str, index: str, offset: int = 0, every: int = EVERY) -> DataFrame:
    """``(line_no, line)`` from ``offset`` on, numbered from 0 over all files in the order of their names.

    Lines end at a line feed; a carriage return before it stays. The greatest
    ``line_no`` plus one is where to resume. Of each file only the bytes from
    the last indexed line up to the wanted one are read, and the greatest
    offset costs what was appended.
    """
    points = index_lines(spark, path, index, every)
    # Per file: whole lines, and one more where its last line has no end yet.
    sizes = points.groupBy("file").agg(F.max("line").alias("whole"), F.max("byte").alias("byte"), F.max("size").alias("size"))
    total = F.col("whole") + F.when(F.col("size") > F.col("byte"), 1).otherwise(0)
    ahead = sizes.select("file", "size", total.alias("lines")).withColumn(
        "before", F.sum("lines").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("lines"))
    wanted = ahead.filter(F.col("before") + F.col("lines") > offset)
    # The last indexed line up to the offset, and those behind it, are where ranges may be cut.
    near = points.drop("size").join(wanted, "file").groupBy("file", "before", "size").agg(
        F.max(F.when(F.col("before") + F.col("line") <= offset, F.struct("byte", "line"))).alias("at"),
        F.sort_array(F.collect_list(F.when(F.col("before") + F.col("line") > offset, F.struct("byte", "line")))).alias("later"))
    ranges: list[Range] = []
    for r in near.collect():
        start, line = tuple(r["at"]) if r["at"] else (0, 0)
        for byte, number in [tuple(p) for p in r["later"]]:
            if byte - start >= SPLIT_BYTES:
                ranges.append(Range(r.file, start, byte, line))
                start, line = byte, number
        ranges.append(Range(r.file, start, r["size"], line))
    rows = _in_tasks(spark, "fleet_lines", ranges, "file string, number bigint, line string", _lines)
    return rows.join(F.broadcast(wanted.select("file", "before")) if len(ranges) < 10_000 else wanted.select("file", "before"), "file").select(
        (F.col("before") + F.col("number")).alias("line_no"), "line").filter(F.col("line_no") >= offset)
