"""Streams give what the batch operators give on the same files."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlake.sources import read_change_log
from fleetlake.streaming import apply_stream, change_rate, compact, current_state, read_broker, write_slices
from fleetlake.streaming.apply import write_base, write_batch

FLAT = "_seq bigint, _kind string, _old_id bigint, _id bigint, _has_v boolean, v string"


def write_batches(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FLAT).coalesce(1).write.mode("append").json(path)


def test_apply_compact_and_go_on(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    write_base(spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string"), state)
    write_batches(spark, src, [[(1, "update", 1, 1, True, "c")], [(2, "delete", 2, 2, False, None), (3, "insert", 3, 3, True, "n")]])
    stream = spark.readStream.schema(FLAT).option("maxFilesPerTrigger", 1).json(src)
    apply_stream(stream, state, f"{state}/cp", once=True).awaitTermination()
    want = {1: "c", 3: "n"}
    assert {r["id"]: r["v"] for r in current_state(spark, state, ["id"], ["v"]).collect()} == want
    version = compact(spark, state, ["id"], ["v"])
    assert version >= 2 and compact(spark, state, ["id"], ["v"]) == version
    assert {r["id"]: r["v"] for r in current_state(spark, state, ["id"], ["v"]).collect()} == want
    write_batches(spark, src, [[(4, "update", 3, 7, True, "m")]])
    apply_stream(spark.readStream.schema(FLAT).option("maxFilesPerTrigger", 1).json(src), state, f"{state}/cp", once=True).awaitTermination()
    assert {r["id"]: r["v"] for r in current_state(spark, state, ["id"], ["v"]).collect()} == {1: "c", 7: "m"}


def test_repeated_batch_replaces_itself(spark, tmp_path):
    state = str(tmp_path / "state")
    write_base(spark.createDataFrame([(1, "a")], "id bigint, v string"), state)
    batch = spark.createDataFrame([(1, "update", 1, 1, True, "c")], FLAT)
    for _ in range(2):
        write_batch(batch, state, 0)
    assert spark.read.parquet(f"{state}/log/batch=0").count() == 1
    assert current_state(spark, state, ["id"], ["v"]).first()["v"] == "c"


def test_slices_keep_every_line(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    lines = [json.dumps({"change": [{"kind": "delete", "schema": "s", "table": "t", "oldkeys": {"keynames": ["id"], "keyvalues": [i]}}]}) for i in range(20)]
    (src / "a").write_text("\n".join(lines[:10]))
    (src / "b").write_text("\n".join(lines[10:]))
    stream = read_broker(spark, {"path": str(src), "maxFilesPerTrigger": "1"}, "text")
    write_slices(stream, str(tmp_path / "out"), str(tmp_path / "cp"), database="db1", once=True).awaitTermination()
    back = read_change_log(spark, str(tmp_path / "out"))
    assert back.count() == 20
    assert back.filter((F.col("database") == "db1") & F.col("slice_ts").isNotNull()).count() == 20


def test_change_rate_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(f"2024-01-01 00:0{i % 8}:30", "db", "t", "insert" if i % 2 else "delete") for i in range(40)]
    df = spark.createDataFrame(rows, "s string, database string, `table` string, kind string").withColumn("slice_ts", F.to_timestamp("s")).drop("s")
    df.coalesce(1).write.parquet(src)
    batch = {tuple(r) for r in change_rate(spark.read.parquet(src)).collect()}
    stream = change_rate(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("rate").collect()} == batch


def test_checks_of_alike_tables_are_made_once(spark):
    """The checks of a batch do not grow with tables of the same columns, and still name the table and the column."""
    import contextlib
    import io

    from fleetlake.operators.changes import CHANGE_TYPE, decode_changes
    from fleetlake.streaming.tables import StoredTable, _typed

    lines = [(i, f'[{{"kind":"insert","schema":"public","table":"t{i}","columnnames":["key","amount"],"columnvalues":[{i},"{v}"]}}]') for i, v in enumerate(("1.5", "2", "much"))]
    changes = decode_changes(spark.createDataFrame(lines, "seq long, value string").select("seq", F.from_json("value", CHANGE_TYPE).alias("change")), ["seq"])

    def typed(kinds):
        return _typed(changes, [StoredTable(f"t{i}", {"key": "bigint"}, {"amount": kind}) for i, kind in enumerate(kinds)], F.col("seq"))

    def looks(df):
        with contextlib.redirect_stdout(io.StringIO()) as text:
            df.explain()
        return text.getvalue().count("element_at(")

    assert looks(typed(["double"] * 9)) == looks(typed(["double"]))
    assert sorted((r["_table"], r.cols["amount"], r["_from"] == r["_to"]) for r in typed(["double", "bigint", "string"]).collect()) == [
        ("public.t0", "1.5", True), ("public.t1", "2", True), ("public.t2", "much", True)]
    with pytest.raises(Exception, match="public.t2.amount is no double: much"):
        typed(["double"] * 3).collect()
