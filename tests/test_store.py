"""Stored tables that change as one, and streams into them."""

import glob
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetlake.operators import changes as C
from fleetlake.sources import store
from fleetlake.sources.change_log import parse_envelopes, read_change_log, structured_line, write_change_log
from fleetlake.sources.findings import findings, read_findings, write_findings
from fleetlake.streaming.tables import StoredTable, apply_batch, apply_tables, compact_table, create_table, read_table

A = StoredTable("a", {"id": "bigint"}, {"v": "string", "n": "int"}, buckets=8)
B = StoredTable("b", {"x": "string", "y": "int"}, {"w": "double"}, buckets=4)


def change(table, kind, new=None, old=None):
    c = {"kind": kind, "schema": "public", "table": table}
    if new:
        c |= {"columnnames": list(new), "columnvalues": list(new.values())}
    if old:
        c["oldkeys"] = {"keynames": list(old), "keyvalues": list(old.values())}
    return c


def decoded(spark, changes, start=0):
    lines = [(start + i, json.dumps({"database": "d", "change": [c]})) for i, c in enumerate(changes)]
    return C.decode_changes(parse_envelopes(spark.createDataFrame(lines, "seq bigint, value string")))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def fresh(spark, path):
    create_table(spark.createDataFrame([(i, f"v{i}", i) for i in range(40)], "id bigint, v string, n int"), path, A)
    create_table(spark.createDataFrame([(f"k{i % 3}", i, float(i)) for i in range(12)], "x string, y int, w double"), path, B)


def test_a_batch_that_fails_in_the_second_table_changes_none(spark, tmp_path):
    path = str(tmp_path / "s")
    fresh(spark, path)
    before = rows(read_table(spark, path, A)), rows(read_table(spark, path, B))
    good = change("a", "update", {"id": 3, "v": "new"}, {"id": 3})
    with pytest.raises(PySparkException, match="public.b.w is no double: many"):
        apply_batch(decoded(spark, [good, change("b", "insert", {"x": "z", "y": 1, "w": "many"})]), path, [A, B], batch_id=0)
    assert (rows(read_table(spark, path, A)), rows(read_table(spark, path, B))) == before
    # The same batch, mended, is applied; repeated, it counts once.
    mended = decoded(spark, [good, change("b", "insert", {"x": "z", "y": 1, "w": 2.5}), change("c", "insert", {"q": 1})])
    assert apply_batch(mended, path, [A, B], batch_id=0)
    after = rows(read_table(spark, path, A)), rows(read_table(spark, path, B))
    assert (3, "new", 3) in after[0] and ("z", 1, 2.5) in after[1] and len(after[0]) == 40 and len(after[1]) == 13
    assert not apply_batch(mended, path, [A, B], batch_id=0)
    assert (rows(read_table(spark, path, A)), rows(read_table(spark, path, B))) == after


def test_a_stop_before_the_manifest_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    fresh(spark, path)
    before = rows(read_table(spark, path, A))

    def stopped(*_):
        raise OSError("the machine went away")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", stopped)
        with pytest.raises(OSError):
            apply_batch(decoded(spark, [change("a", "delete", old={"id": 1})]), path, [A, B])
        with pytest.raises(OSError):
            create_table(spark.createDataFrame([], "id bigint, v string, n int"), path, A)
    assert rows(read_table(spark, path, A)) == before
    create_table(spark.createDataFrame([(1, "x", 1)], "id bigint, v string, n int"), path, A)
    assert rows(read_table(spark, path, A)) == [(1, "x", 1)] and read_table(spark, path, B).count() == 12


def test_compaction_writes_the_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "s")
    fresh(spark, path)
    bucket = {r.id: r.b for r in spark.range(200).select("id", A.bucket().alias("b")).collect()}
    old = {e.part: e.folder for e in store.load(spark, path).of(A.name)}
    # A row moves from its bucket to another one; one more is changed in the first.
    target = next(i for i in range(100, 200) if bucket[i] != bucket[5])
    apply_batch(decoded(spark, [change("a", "update", {"id": target, "v": "moved"}, {"id": 5}), change("a", "update", {"n": -1, "id": target}, {"id": target})]), path, [A, B])
    want = rows(read_table(spark, path, A))
    assert (target, "moved", -1) in want and len(want) == 40
    assert compact_table(spark, path, A) == sorted({bucket[5], bucket[target]})
    now = {e.part: e.folder for e in store.load(spark, path).of(A.name)}
    assert {p for p in now if now[p] != old.get(p)} == {str(bucket[5]), str(bucket[target])}
    new = set(now.values()) - set(old.values())
    files = [f for folder in new for f in glob.glob(f"{path}/{folder}/_bucket=*")]
    assert sorted(f.rsplit("=")[-1] for f in files) == sorted({str(bucket[5]), str(bucket[target])})
    assert rows(read_table(spark, path, A)) == want and compact_table(spark, path, A) == []
    assert read_table(spark, path, B).count() == 12 and compact_table(spark, path, B) == []


def test_many_batches_equal_one_replay(spark, tmp_path):
    path, rng = str(tmp_path / "s"), random.Random(3)
    fresh(spark, path)
    changes = []
    for _ in range(120):
        i, j = rng.randrange(60), rng.randrange(60)
        kind = rng.choice(["insert", "update", "update", "delete"])
        changes.append(change("a", kind, {"id": i if kind != "update" else i, "v": f"x{j}"} if kind != "delete" else None, {"id": i} if kind != "insert" else None))
    base = spark.createDataFrame([(i, f"v{i}", i) for i in range(40)], "id bigint, v string, n int")
    want = rows(C.replay(base, decoded(spark, changes), dict(A.keys), dict(A.columns)))
    for n in range(4):
        apply_batch(decoded(spark, changes[30 * n:30 * n + 30], 30 * n), path, [A, B], batch_id=n)
        if n % 2:
            compact_table(spark, path, A)
    assert rows(read_table(spark, path, A)) == want
    # Changes that are folded into every table are given up later.
    compact_table(spark, path, B)
    for k in range(store.PLACES + 1):
        apply_batch(decoded(spark, []), path, [A, B], batch_id=10 + k)
    assert store.reclaim(spark, path) > 0 and rows(read_table(spark, path, A)) == want and store.reclaim(spark, path) == 0


def test_a_stream_feeds_many_tables(spark, tmp_path):
    path, src = str(tmp_path / "s"), str(tmp_path / "in")
    fresh(spark, path)
    batches = [[change("a", "delete", old={"id": 0}), change("b", "update", {"w": 9.0}, {"x": "k0", "y": 0})], [change("a", "insert", {"id": 0, "v": "again"})]]
    for n, batch in enumerate(batches):
        write_change_log(spark.createDataFrame([(json.dumps({"database": "d", "change": batch}), n, "20240101-000000")], "value string, seq bigint, slice string"), src)
    lines = spark.readStream.option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").text(src)
    parsed = parse_envelopes(lines.select(F.from_json("value", "seq bigint, line string").alias("l")).select("l.seq", F.col("l.line").alias("value")))
    stream = C.decode_changes(parsed, ["database", "seq"])
    apply_tables(stream, path, str(tmp_path / "cp"), [A, B], F.struct("seq", "pos"), once=True).awaitTermination()
    got = dict((r.id, (r.v, r.n)) for r in read_table(spark, path, A).collect())
    assert got[0] == ("again", None) and len(got) == 40
    assert ("k0", 0, 9.0) in rows(read_table(spark, path, B))


def test_findings_survive_a_stop(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f")
    df = spark.createDataFrame([("i", "d", "o1"), ("i", "d", "o2")], "instance string, database string, obj string")
    write_findings(findings(df, "check", "obj", "2024-01-01 00:00:00"), path)
    before = rows(read_findings(spark, path).drop("details"))

    def stopped(*_):
        raise OSError("the machine went away")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", stopped)
        with pytest.raises(OSError):
            write_findings(findings(df.limit(1), "check", "obj", "2024-02-01 00:00:00"), path)
    assert rows(read_findings(spark, path).drop("details")) == before
    write_findings(findings(df.limit(1), "check", "obj", "2024-02-01 00:00:00"), path)
    assert {r.object: str(r.as_of)[:7] for r in read_findings(spark, path).collect()} == {"o1": "2024-02", "o2": "2024-01"}
    assert read_findings(spark, str(tmp_path / "none")).count() == 0


def test_lines_of_any_text_keep_their_place(spark, tmp_path):
    """Empty and plain envelopes, ones with a ``seq`` of their own, and names with quotes, dollars and backslashes."""
    name = 'we"ird$1\\name}'
    lines = [(0, "{}"), (1, '{"change": [], "seq": 99}'), (2, '{"change": [{"kind": "delete", "schema": "s", "table": "t"}]}'), (3, None)]
    df = spark.createDataFrame(lines, "n bigint, value string")
    out = df.select(structured_line(F.col("value"), F.col("n"), F.lit(5), name).alias("value"), F.lit("20240101-000000").alias("slice")).where("value is not null")
    write_change_log(out, str(tmp_path / "log"), seq=None)
    got = sorted((r.seq.position, r.seq.partition, r.database, None if r.change is None else len(r.change)) for r in read_change_log(spark, str(tmp_path / "log")).collect())
    assert got == [(0, 5, name, None), (1, 5, name, 0), (2, 5, name, 1)]
    again = out.select(structured_line(F.col("value"), database="other").alias("value")).select(F.from_json("value", "seq bigint, database string, line string").alias("l"))
    assert sorted((r.l.seq, r.l.database, r.l.line) for r in again.collect()) == [(n, "other", v) for n, v in lines[:3]]
