"""Inputs that once lost, doubled or reordered rows."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetlake.operators import aggregates as A
from fleetlake.operators import blocks as B
from fleetlake.operators import changes as C
from fleetlake.operators import lifecycle as L
from fleetlake.operators import windows as W
from fleetlake.operators.health import maintenance_due
from fleetlake.operators.joins import expand_range
from fleetlake.sources import land_snapshot, read_change_log, read_lines_from, read_snapshots, write_change_log
from fleetlake.sources import store
from fleetlake.sources.change_log import bad_lines, log_lines, parse_envelopes
from fleetlake.sources.findings import findings, read_findings, write_findings
from fleetlake.streaming import apply_stream, compact, current_state, deduplicated
from fleetlake.streaming.apply import numbers, write_base, write_batch

KEYS, COLUMNS = {"id": "bigint"}, {"v": "string"}
LINE = '{{"database": "d", "change": [{{"kind": "update", "schema": "s", "table": "t", "columnnames": ["id", "v"], "columnvalues": [{0}, "v{1}"], "oldkeys": {{"keynames": ["id"], "keyvalues": [{0}]}}}}]}}'


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_log_written_in_any_order_is_replayed_in_its_own(spark, tmp_path):
    lines = [(LINE.format(n % 20, n), n, "20240101-000000") for n in range(4000)]
    random.Random(1).shuffle(lines)
    df = spark.createDataFrame(lines, "value string, seq bigint, slice string").repartition(7, F.hash("seq"))
    for part in (0, 1):
        write_change_log(df.filter(F.col("seq") % 2 == part), str(tmp_path / "log"))
    base = spark.range(20).select("id", F.lit("old").alias("v"))
    changes = C.decode_changes(read_change_log(spark, str(tmp_path / "log")), ["database", "seq"])
    assert rows(C.replay(base, changes, KEYS, COLUMNS)) == sorted(((k, f"v{3980 + k}") for k in range(20)), key=str)


def test_a_stream_with_repeats_and_a_restart_equals_the_batch(spark, tmp_path):
    records = [(LINE.format(n % 7, n), n % 7 % 2, n) for n in range(60)]
    schema = "value string, partition int, offset bigint"
    path, out = str(tmp_path / "in"), str(tmp_path / "table")
    base = spark.range(7).select("id", F.lit("old").alias("v"))
    write_base(base, out)
    # The second reading repeats the end of the first.
    for k, part in enumerate((records[:25], records[20:45], records[40:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path).withColumn("slice_ts", F.lit("2024-01-01").cast("timestamp"))
        once = deduplicated(stream, ["partition", "offset"])
        apply_stream(C.broker_changes(once.drop("slice_ts"), KEYS, COLUMNS), out, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    flat = C.broker_changes(spark.createDataFrame(records, schema), KEYS, COLUMNS)
    block = F.lit(0)
    want = rows(C.replay_flat(base, flat, ["id"], ["v"], block=block))
    assert rows(current_state(spark, out, ["id"], ["v"])) == want == sorted(((n % 7, f"v{n}") for n in range(53, 60)), key=str)


def test_compaction_drops_what_it_folded(spark, tmp_path):
    out = str(tmp_path)
    write_base(spark.range(3).select("id", F.lit("old").alias("v")), out)
    for b in range(3):
        flat = spark.createDataFrame([(b, "update", b, b, True, f"n{b}")], "_seq bigint, _kind string, _old_id bigint, _id bigint, _has_v boolean, v string")
        write_batch(flat, out, b)
        assert compact(spark, out, ["id"], ["v"]) == b + 1
    now = store.load(spark, out)
    assert numbers(now, store.PART) == [2, 3] and numbers(now, store.LOG) == [2]
    assert rows(current_state(spark, out, ["id"], ["v"])) == [(0, "n0"), (1, "n1"), (2, "n2")]


def test_bad_lines_stop_the_log_or_are_put_aside(spark, tmp_path):
    lines = [(LINE.format(1, 1),), (LINE.format(2, 2)[:60],), ("",), ('{"database": "d", "change": []}',)]
    df = spark.createDataFrame(lines, "value string")
    with pytest.raises(PySparkException, match="bad line"):
        C.decode_changes(parse_envelopes(df), ["database"]).collect()
    assert C.decode_changes(parse_envelopes(df, strict=False), ["database"]).count() == 1
    assert [r.value for r in bad_lines(df).collect()] == [lines[1][0]]
    df.coalesce(1).write.text(str(tmp_path / "slice=20240101-000000"))
    assert bad_lines(log_lines(spark, str(tmp_path))).count() == 1


def test_keys_that_differ_by_microseconds_both_move(spark):
    at = [dt.datetime(2024, 1, 1, 0, 0, 0, us) for us in (100, 200, 300, 400)]
    base = spark.createDataFrame([(at[0], "a"), (at[1], "b")], "k timestamp, v string")
    flat = spark.createDataFrame([(1, "update", at[0], at[2], True, "x"), (2, "update", at[1], at[3], False, None)],
                                 "_seq bigint, _kind string, _old_k timestamp, _k timestamp, _has_v boolean, v string")
    assert rows(C.replay_flat(base, flat, ["k"], ["v"])) == sorted([(at[2], "x"), (at[3], "b")], key=str)


def test_replay_needs_no_broadcast(spark):
    base = spark.range(100).select("id", F.lit("old").alias("v"))
    flat = spark.createDataFrame([(n, "insert" if n > 90 else "update", n + 10, n + 10, True, f"n{n}") for n in range(80, 100)],
                                 "_seq bigint, _kind string, _old_id bigint, _id bigint, _has_v boolean, v string")
    want = {k: "old" for k in range(100)} | {n + 10: f"n{n}" for n in range(80, 90)} | {n + 10: f"n{n}" for n in range(91, 100)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            assert {r.id: r.v for r in C.replay_flat(base, flat, ["id"], ["v"]).collect()} == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_null_unique_keys_do_not_conflict(spark):
    src = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x"), (5, "y")], "id int, u string")
    dst = spark.createDataFrame([(9, "y"), (8, None)], "id int, u string")
    got = rows(L.copy_range(src, dst, "id", 1, 5, ["u"]))
    assert [r for r in got if r[1] is None] == [(1, None), (2, None)] and [r[1] for r in got if r[1]] == ["x"]


def test_findings_of_different_keys_keep_apart(spark, tmp_path):
    df = spark.createDataFrame([("a-b", "c", "o"), ("a", "b-c", "o"), (None, "c", "o"), ("c", None, "o")], "instance string, database string, obj string")
    found = findings(df, "check", "obj", "2024-01-01 00:00:00")
    assert found.count() == 4
    path = str(tmp_path / "f")
    for as_of in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        write_findings(findings(df, "check", "obj", as_of), path)
    write_findings(findings(df.limit(1), "other", "obj", "2024-01-01 00:00:00"), path)
    back = read_findings(spark, path)
    assert back.count() == 5 and back.filter("check_id = 'check' AND as_of = '2024-01-02'").count() == 4


def test_a_null_role_has_no_clients(spark):
    df = spark.createDataFrame([("d", None, "10.0.0.1"), ("d", "r", "10.0.0.2"), ("e", "r", "10.0.0.3")], "datname string, usename string, client_addr string").withColumn("state", F.lit("idle"))
    got = {(r.datname, r.usename): r.instances for r in A.activity_rollup(df, ["datname", "usename"]).collect()}
    assert got == {("d", None): 0, ("d", "r"): 2, ("e", "r"): 2}


def test_contents_with_nulls_in_other_places_differ(spark):
    a = spark.createDataFrame([(1, None), (2, 3)], "x int, y int")
    b = spark.createDataFrame([(None, 1), (2, 3)], "x int, y int")
    assert [L.compare_counts(a, other, content=True).first().same_content for other in (a.orderBy("x"), b)] == [True, False]


def test_a_threshold_is_not_rounded_before_it_is_compared(spark):
    df = spark.createDataFrame([("s", "t", 9, 10, None, 2)], "schemaname string, relname string, n_live_tup bigint, n_dead_tup bigint, reloptions string, relpages bigint")
    row = maintenance_due(df, "vacuum", 9, 0.11110666).first()
    assert (row.threshold, row.due, row.rows_per_page) == (10.0, "yes", 4.5)
    settings = spark.createDataFrame([(20, 0.0)], "autovacuum_vacuum_threshold int, autovacuum_vacuum_scale_factor double")
    assert maintenance_due(df, "vacuum", settings=settings).first().due is None
    # Without a row the two arguments hold; two rows are an error; so it is per server.
    assert maintenance_due(df, "vacuum", 9, 0.11110666, settings=settings.limit(0)).first().due == "yes"
    with pytest.raises(PySparkException, match="more than one row"):
        maintenance_due(df, "vacuum", settings=settings.union(settings)).collect()
    fleet, own = df.withColumn("i", F.lit(1)).union(df.withColumn("i", F.lit(2))), settings.withColumn("i", F.lit(2))
    assert {r.due for r in maintenance_due(fleet, "vacuum", 9, 0.11110666, settings=own, on=["i"], keep=["i"]).collect()} == {"yes", None}


@pytest.mark.parametrize("shape", ["sparse", "one day", "clustered"])
def test_blocks_hold_equal_numbers_of_rows(spark, shape):
    n = 4000
    df = spark.range(n)
    key = {"sparse": F.col("id") * (1 << 22), "one day": F.lit("2024-01-01").cast("date"),
           "clustered": F.when(F.col("id") < n - 3, F.col("id")).otherwise(F.col("id") * (1 << 40))}[shape]
    cut = B.with_blocks(df.withColumn("k", key), "k", 500)
    sizes = [r["count"] for r in cut.groupBy("_blk").count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 1500
    border = cut.groupBy("_blk").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("_blk").collect()
    assert all(x.b <= y.a for x, y in zip(border, border[1:]))


def test_gaps_and_purge_of_sparse_and_equal_keys(spark):
    ids = [i << 22 for i in range(1, 300)]
    got = W.gaps(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id", span=20)
    assert got.count() == 299 and got.agg(F.sum("missing")).first()[0] == ids[-1] - 299 + 1
    day = spark.range(1000).select(F.lit("2024-01-01").cast("date").alias("d"), "id")
    plan = L.purge(day, F.col("id") < 950, "d", limit=100, span=64).plan
    assert sorted(r["count"] for r in plan.groupBy("batch").count().collect()) == [50] + [100] * 9


def test_long_ranges_come_in_bounded_cells(spark):
    df = spark.createDataFrame([(0, 20_000_000, "a"), (5, 5, "b"), (7, 6, "c"), (-3, 4093, "d")], "lo bigint, hi bigint, x string")
    got = {r.x: (r.n, r.a, r.b, r.d) for r in expand_range(df, "lo", "hi").groupBy("x").agg(
        F.count("i").alias("n"), F.min("i").alias("a"), F.max("i").alias("b"), F.countDistinct("i").alias("d")).collect()}
    assert got == {"a": (20_000_001, 0, 20_000_000, 20_000_001), "b": (1, 5, 5, 1), "d": (4097, -3, 4093, 4097)}


def test_one_bad_target_does_not_stop_the_others(spark, tmp_path):
    def reader(s, target, sql):
        if target["instance"] == "i1":
            raise OSError("no route")
        df = s.range(2)
        return df.withColumn("x", F.raise_error(F.lit("broken"))) if target["instance"] == "i3" else df.withColumn("x", F.lit("ok"))

    targets = [{"instance": f"i{n}", "database": "d"} for n in range(5)]
    for _ in range(2):
        failed = land_snapshot(spark, targets, "select 1", "2024-01-01 00:00:00", str(tmp_path), reader, batch=3)
        assert sorted(r.instance for r in failed.collect()) == ["i1", "i3"]
    assert read_snapshots(spark, str(tmp_path)).count() == 6


def test_a_landing_that_first_failed_does_not_double_rows(spark, tmp_path):
    down = {"i1"}

    def reader(s, target, sql, schema):
        if target["instance"] in down:
            raise OSError("no route")
        return s.range(3).selectExpr(f"CAST(id AS {schema}) AS id")

    targets = [{"instance": f"i{n}", "database": "d"} for n in range(2)]
    first = land_snapshot(spark, targets, "select 1", "2024-01-01 00:00:00", str(tmp_path), reader, schema="int")
    assert [r.instance for r in first.collect()] == ["i1"] and read_snapshots(spark, str(tmp_path)).count() == 3
    down.clear()
    assert land_snapshot(spark, targets, "select 1", "2024-01-01 00:00:00", str(tmp_path), reader, schema="int").count() == 0
    landed = read_snapshots(spark, str(tmp_path))
    assert landed.count() == 6 and dict(landed.dtypes)["id"] == "int"
    land_snapshot(spark, targets[:1], "select 1", "2024-01-02 00:00:00", str(tmp_path), reader, schema="int")
    assert read_snapshots(spark, str(tmp_path)).count() == 9 and read_snapshots(spark, str(tmp_path), "2024-01-02-00-00-00").count() == 3


def test_lines_from_an_offset_skip_whole_files(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"f{k}").write_text("".join(f"{k}-{i}\n" for i in range(10)))
    got = read_lines_from(spark, str(tmp_path), 17).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(k * 10 + i, f"{k}-{i}") for k in range(4) for i in range(10)][17:]
