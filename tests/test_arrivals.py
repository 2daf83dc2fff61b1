"""Records, readings and snapshots as they arrive: late, repeated, in part."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import aggregates as A
from fleetlake.operators.windows import trend
from fleetlake.sources import land_targets, read_landed, read_targets
from fleetlake.sources.targets import cursor_rows
from fleetlake.streaming import once
from fleetlake.streaming.readings import live_trend, slope

RECORD = "database string, `partition` int, `offset` bigint, v string"


def test_covered_places_and_merged_intervals(spark, monkeypatch):
    monkeypatch.setattr(once, "BLOCK", 7)
    rng = random.Random(5)
    places = {(k, rng.randrange(60)) for k in ("a", None) for _ in range(45)}
    df = spark.createDataFrame(sorted(places, key=str), "k string, o bigint")
    arrays = once.merged(once.intervals(df, ["k"], "o"), ["k"]).cache()
    for r in arrays.collect():
        inside = {x for lo, hi in zip(r.lows, r.highs) for x in range(lo, hi + 1)}
        assert inside == {o for k, o in places if k == r.k}
        assert all(hi + 1 < lo for hi, lo in zip(r.highs, r.lows[1:]))
    every = spark.range(-2, 63).crossJoin(arrays).select("k", "id", once.is_covered(F.col("id"), F.col("lows"), F.col("highs")).alias("c"))
    assert all(r.c == ((r.k, r.id) in places) for r in every.collect())
    assert spark.range(1).select(once.is_covered(F.col("id"), F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<bigint>"))).first()[0] is False


def test_late_and_repeated_records_are_stored_once(spark, tmp_path):
    path, rng, seen = str(tmp_path / "s"), random.Random(2), set()
    for n in range(6):
        # One partition has most records, the other lags behind; null partitions and offsets occur.
        batch = [("d", 0, rng.randrange(n * 40, n * 40 + 90)) for _ in range(80)] + [("d", 1, 5 - n), (None, None, n // 2)]
        rows = [(d, p, o, f"{d}-{p}-{o}") for d, p, o in batch] + [("d", 0, None, f"unplaced {n}")]
        df = spark.createDataFrame(rows, RECORD)
        assert once.store_once(df, path, batch_id=n)
        assert not once.store_once(df, path, batch_id=n)
        seen |= {r[:3] for r in rows if r[2] is not None}
        if n == 3:
            once.gather(spark, path, RECORD)
    got = [tuple(r) for r in once.read_once(spark, path, RECORD).collect()]
    assert sorted((r[:3] for r in got if r[2] is not None), key=str) == sorted(seen, key=str)
    assert sum(r[2] is None for r in got) == 6
    assert once.read_once(spark, str(tmp_path / "none"), RECORD).count() == 0


def test_places_far_apart_are_kept_in_blocks(spark, tmp_path, monkeypatch):
    """Every third offset only, as when a filter reads a part of a broker's records: no list of places outgrows a block."""
    monkeypatch.setattr(once, "BLOCK", 50)
    path, batches = str(tmp_path / "s"), [range(0, 900, 3), range(300, 1500, 3), range(-90, 2, 3), range(1, 400)]
    for n, offsets in enumerate(batches):
        rows = [(d, 0, o, str(n)) for d in ("d", None) for o in offsets]
        assert once.store_once(spark.createDataFrame(rows, RECORD), path, batch_id=n)
    got = sorted((r.database or "", r.offset) for r in once.read_once(spark, path, RECORD).collect())
    assert got == sorted((d, o) for d in ("d", "") for o in set().union(*batches))
    now = once.store.load(spark, path)
    folder = next(e.folder for e in now.of("records") if e.part == once.SEEN)
    seen = spark.read.parquet(f"{path}/{folder}").collect()
    assert max(len(r.lows) for r in seen) <= 17 and all(hi // 50 == lo // 50 for r in seen for lo, hi in zip(r.lows, r.highs))
    held = {(r.database or "", x) for r in seen for lo, hi in zip(r.lows, r.highs) for x in range(lo, hi + 1)}
    assert sorted(held) == got


def test_intervals_stored_across_blocks_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(once, "BLOCK", 10)
    spark.createDataFrame([("d", 0, [3, 40], [25, 41])], "database string, `partition` int, lows array<bigint>, highs array<bigint>").write.parquet(f"{tmp_path}/seen")
    seen = once._seen(spark, f"{tmp_path}/seen", once.KEYS)
    assert sorted(tuple(r)[3:] for r in seen.collect()) == [(3, 9), (10, 19), (20, 25), (40, 41)]
    records = spark.createDataFrame([("d", 0, o, "v") for o in range(45)], RECORD)
    assert sorted(r.offset for r in once.not_covered(records, seen, once.KEYS, "offset").collect()) == [0, 1, 2, *range(26, 40), 42, 43, 44]


def test_live_trend_equals_the_trend_of_all_readings(spark, tmp_path):
    rng, rows = random.Random(7), []
    for i, instance in enumerate(("a", "b", "c")):
        for m in range(40):
            rows.append((instance, "cpu", f"2024-01-01 00:{m:02d}:00", None if m % 7 == i else rng.random() * 100))
    rng.shuffle(rows)
    rows.append(("lone", "cpu", "2024-01-01 00:10:00", 1.0))
    kind = "instance string, metric string, s string, value double"
    df = spark.createDataFrame(rows, kind).withColumn("ts", F.to_timestamp("s")).drop("s")
    for k in range(3):
        df.filter(F.pmod(F.minute("ts"), F.lit(3)) == k).coalesce(1).write.parquet(f"{tmp_path}/in/file={k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/file=*")
    live_trend(stream, delay="2 hours").writeStream.outputMode("update").foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).option(
        "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect():
        last[r.instance] = r
    batch = {}
    for r in trend(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["instance", "metric"], "ts", "value").orderBy("ts").collect():
        batch[r.instance] = r
    assert set(last) == set(batch) == {"a", "b", "c", "lone"}
    for k, r in last.items():
        want = batch[k]
        assert (str(r.ts), r.value, r.samples) == (str(want.ts), want.value, want.samples)
        assert r.slope == pytest.approx(want.slope)


def test_slope_of_few_readings():
    assert slope([1], [2.0]) is None and slope([], []) is None and slope([1, 1], [2.0, 3.0]) is None
    assert slope([0, 1_000_000, 2_000_000], [1.0, None, 5.0]) == pytest.approx(2.0)


class Connection:
    """What a driver offers, over a list."""

    def __init__(self, rows):
        self.rows = rows

    def cursor(self):
        return self

    def execute(self, sql):
        self.rows = [(*r, sql) for r in self.rows]

    def fetchmany(self, n):
        out, self.rows = self.rows[:n], self.rows[n:]
        if any(r[0] == 13 for r in out):
            raise TimeoutError("gone after a while")
        return out

    def close(self):
        pass


def test_targets_fail_alone_and_in_part(spark, tmp_path, monkeypatch):
    def connect(target):
        if target["instance"] == "down":
            raise ConnectionError("no route\nsecond line")
        from test_arrivals import Connection
        # A target that breaks after its first rows.
        return Connection([(i, None if i % 2 else "x") for i in range(target["first"], target["first"] + target["n"])])

    import sys
    from pathlib import Path

    spark.sparkContext.addPyFile(str(Path(__file__)))
    sys.path.insert(0, str(Path(__file__).parent))
    targets = [{"instance": "a", "database": "d/1", "first": 100, "n": 25_000}, {"instance": "down", "database": "d", "first": 0, "n": 1},
               {"instance": "half", "database": "d", "first": -9990, "n": 25_000}, {"instance": "none", "database": "d", "first": 0, "n": 0}]
    fetch, kind, path = cursor_rows(connect, "select 1"), "id bigint, v string, sql string", str(tmp_path / "s")
    failed = land_targets(spark, targets, fetch, kind, "2024-01-01 00:00:00", path)
    assert sorted(map(tuple, failed.collect())) == [("down", "d", "ConnectionError: no route"), ("half", "d", "TimeoutError: gone after a while")]
    got = read_landed(spark, path, kind)
    assert got.columns == ["instance", "database", "snapshot_ts", "id", "v", "sql"]
    assert {(r.instance, r.database): r.n for r in got.groupBy("instance", "database").agg(F.count("*").alias("n")).collect()} == {("a", "d/1"): 25_000}
    # Mended, the run replaces itself; another run stays beside it.
    targets[2]["first"], targets[2]["n"] = 100, 7
    assert land_targets(spark, targets, fetch, kind, "2024-01-01 00:00:00", path).count() == 1
    assert land_targets(spark, targets[:1], fetch, kind, "2024-01-02 00:00:00", path).count() == 0
    assert read_landed(spark, path, kind).count() == 2 * 25_000 + 7
    assert read_landed(spark, path, kind, "2024-01-01-00-00-00").count() == 25_007
    with pytest.raises(ValueError):
        read_targets(spark, [targets[0]] * 2, fetch, kind)


def test_bounds_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10, 5000).withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))).repartition(3).write.parquet(path)
    bounds = A.footer_bounds(spark, path, "id")
    plan = bounds._jdf.queryExecution().toString()
    assert "PushedAggregation: [MIN(id), MAX(id)]" in plan
    assert tuple(bounds.first()) == (10, 4999) and str(A.footer_bounds(spark, path, "d").first()[0]) == "2024-01-11"
    beyond = A.footer_bounds(spark, path, "id", 10_000)
    assert "PushedAggregation: [MIN(id), MAX(id)]" in beyond._jdf.queryExecution().toString() and tuple(beyond.first()) == (10, 4999)
    assert tuple(A.footer_bounds(spark, path, "id", 70).first()) == (10, 70)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_united_sketches_count_like_one(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("day"), (F.col("id") % 5000).alias("v"))
    days = A.distinct_sketches(df, ["k", "day"], "v")
    assert days.count() == 21
    for r in A.united_distinct(days, ["k"]).collect():
        assert abs(r.distinct_estimate - 5000) < 150
    assert abs(A.united_distinct(days, []).first()[0] - 5000) < 150


def test_lines_are_read_from_the_index_on(spark, tmp_path, monkeypatch):
    from fleetlake.sources import line_index as LI

    monkeypatch.setattr(LI, "SPLIT_BYTES", 500)
    src, index, rng = tmp_path / "in", str(tmp_path / "index"), random.Random(3)
    src.mkdir()
    texts = {f"f{k}": "".join("x" * rng.randrange(30) + rng.choice(["", "é", "\r"]) + "\n" for _ in range(200)) for k in range(3)}
    texts["f1"] += "a last line without an end"
    texts["f3"] = ""

    def lines():
        out = []
        for _, t in sorted(texts.items()):
            parts = t.split("\n")
            out += parts if parts[-1] else parts[:-1]
        return out

    def check(offset):
        got = sorted((r.line_no, r.line) for r in LI.read_lines_indexed(spark, str(src), index, offset, 7).collect())
        assert got == list(enumerate(lines()))[offset:]

    for name, t in texts.items():
        (src / name).write_bytes(t.encode())
    for offset in (0, 1, 199, 200, 350, 601, 700):
        check(offset)
    # What is appended is found, and nothing before the last indexed line is read again.
    texts["f1"] += " goes on\nand ends"
    texts["f3"] += "new\n" * 50
    for name, t in texts.items():
        (src / name).write_bytes(t.encode())
    opened = []
    tasks = LI._in_tasks
    monkeypatch.setattr(LI, "_in_tasks", lambda s, n, ranges, *a: opened.extend(ranges) or tasks(s, n, ranges, *a))
    check(601)
    size = {name: len(t.encode()) for name, t in texts.items()}
    assert {r.file.rsplit("/")[-1] for r in opened} == {"f2", "f3"} | {"f1"}
    assert all(r.start >= size["f1"] - 60 for r in opened if r.file.endswith("f1"))
    opened.clear()
    check(601)
    assert not any(r.file.endswith("f1") for r in opened)
    check(0)
