from pyspark.sql import functions as F

from fleetlake.operators.aggregates import activity_rollup
from fleetlake.sources import candidate_databases, fan_out, land_snapshot, read_inventory, read_lines_from, read_ops, render_rows, write_inventory


def test_inventory_round_trip(spark, tmp_path):
    (tmp_path / "in").write_text("AR:Mod:al:Name:ep:cn:5432:6000:Master\n")
    df = read_inventory(spark, str(tmp_path / "in"))
    assert df.first()["country"] == "ar" and df.first()["instance_role"] == "master"
    write_inventory(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == "ar:mod:al:name:ep:cn:5432:6000:master"


def test_line_numbers_run_over_files_and_splits(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    lines = [f"statement {i} " + "x" * (i % 50) for i in range(4000)]
    (folder / "a.txt").write_text("\n".join(lines[:2500]) + "\n")
    (folder / "b.txt").write_text("\n".join(lines[2500:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r["line_no"]: r["line"] for r in read_lines_from(spark, str(folder), 1000).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(list(enumerate(lines))[1000:])


def test_operation_documents_with_missing_fields(spark, tmp_path):
    (tmp_path / "ops").write_text('{"opid": 1, "WaitState": "Lock"}\n{"opid": 2, "command": {"findandmodify": "c"}}\n')
    got = {r["opid"]: (r["WaitState"], r["command"]["findandmodify"] if r["command"] else None) for r in read_ops(spark, str(tmp_path / "ops")).collect()}
    assert got == {1: ("Lock", None), 2: (None, "c")}


def test_land_snapshot_tags_rows(spark, tmp_path):
    targets = [{"instance": f"i{n}", "database": "d"} for n in range(3)]
    land_snapshot(spark, targets, "select 1", "2024-01-01 00:00:00", str(tmp_path / "s"), lambda s, t, q: s.range(2), batch=2)
    df = spark.read.parquet(str(tmp_path / "s"))
    assert df.count() == 6 and df.select("instance").distinct().count() == 3
    assert str(df.first()["snapshot_date"]) == "2024-01-01"


def test_fan_out_only_reads_wanted_primaries(spark):
    dbs = spark.createDataFrame([("i1", "app", "x", 300000000, True, False), ("i2", "app", "x", 300000000, True, False), ("i1", "small", "x", 1, True, False),
                                 ("i1", "old", "team_delete_me", 300000000, True, False)],
                                "instance string, datname string, owner string, size_bytes bigint, datallowconn boolean, datistemplate boolean")
    wanted = candidate_databases(dbs, min_bytes=220000000).select("instance", F.col("datname").alias("database"))
    instances = spark.createDataFrame([("i1", True), ("i2", False)], "instance string, is_primary boolean")
    snap = spark.createDataFrame([("i1", "app", "active"), ("i1", "small", "active"), ("i2", "app", "idle"), ("i1", "old", "idle")], "instance string, database string, state string")
    out = fan_out(lambda d: activity_rollup(d, ["instance", "database"], role=None), snap, wanted, instances, F.col("is_primary"))
    assert [(r["instance"], r["database"], r["active"], r["total"]) for r in out.collect()] == [("i1", "app", 1, 1)]


def test_render_rows_has_one_header(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = render_rows(df)
    assert got.filter("is_header").first()["line"] == "a,b"
    assert sorted(r["line"] for r in got.filter("NOT is_header").collect()) == ["1,", "2,x"]
