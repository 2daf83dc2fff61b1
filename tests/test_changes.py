"""Replay against a plain sequential fold, with key changes and chains of them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import changes as C
from fleetlake.sources import read_change_log

KEYS = {"id": "bigint"}
COLUMNS = {"a": "string", "b": "double"}


def fold(base, log):
    """The state after a log, one change after another."""
    state = {k: dict(v) for k, v in base.items()}
    for kind, old, cols in log:
        if kind == "insert":
            state[cols["id"]] = {c: cols.get(c) for c in COLUMNS}
        elif kind == "delete":
            state.pop(old, None)
        elif old in state:
            row = state.pop(old)
            row.update({c: v for c, v in cols.items() if c != "id"})
            state[cols.get("id", old)] = row
    return state


def random_log(rnd, base, n, renames):
    """A log a server could have written: no insert or move onto a live key."""
    alive, log = set(base), []
    for _ in range(n):
        cols = {c: rnd.choice([None, f"v{rnd.randint(0, 99)}"]) if c == "a" else rnd.choice([0.0, 1.5, None]) for c in COLUMNS if rnd.random() < 0.6}
        roll = rnd.random()
        free = [k for k in range(12) if k not in alive]
        if roll < 0.2 and free:
            k = rnd.choice(free)
            log.append(("insert", None, {"id": k, **cols}))
            alive.add(k)
        elif roll < 0.35:
            k = rnd.randrange(12)
            log.append(("delete", k, {}))
            alive.discard(k)
        elif roll < 0.6 and renames and free and alive:
            k, new = rnd.choice(sorted(alive)), rnd.choice(free)
            log.append(("update", k, {"id": new, **cols}))
            alive.discard(k)
            alive.add(new)
        else:
            k = rnd.randrange(12)
            log.append(("update", k, {"id": k, **cols}))
    return log


def envelope(change, database="app"):
    kind, old, cols = change
    c = {"kind": kind, "schema": "public", "table": "t"}
    if kind != "delete":
        c["columnnames"], c["columnvalues"] = list(cols), list(cols.values())
    if kind != "insert":
        c["oldkeys"] = {"keynames": ["id"], "keyvalues": [old]}
    return json.dumps({"change": [c], "database": database})


def write_log(folder, log, per_slice=7):
    folder.mkdir()
    for i in range(0, len(log), per_slice):
        lines = "\n".join(envelope(c) for c in log[i : i + per_slice])
        (folder / f"20240101-{i // per_slice:06d}").write_text(lines + "\n")


def table(spark, state):
    rows = [(k, v["a"], v["b"]) for k, v in sorted(state.items())]
    return spark.createDataFrame(rows, "id bigint, a string, b double")


def as_state(df):
    return {r["id"]: {"a": r["a"], "b": r["b"]} for r in df.collect()}


@pytest.mark.parametrize("seed,renames", [(1, False), (2, False), (3, True), (4, True), (5, True)])
def test_replay_equals_fold(spark, tmp_path, seed, renames):
    rnd = random.Random(seed)
    base = {k: {"a": f"base{k}", "b": float(k)} for k in rnd.sample(range(12), 6)}
    log = random_log(rnd, base, 60, renames)
    write_log(tmp_path / "log", log)
    changes = C.decode_changes(read_change_log(spark, str(tmp_path / "log")), ["seq", "slice_ts"])
    got = C.replay(table(spark, base), changes, KEYS, COLUMNS)
    assert as_state(got) == fold(base, log)


def test_moves_in_integer_order_equal_fold(spark):
    rnd = random.Random(11)
    base = {k: {"a": f"base{k}", "b": float(k)} for k in range(5)}
    log = random_log(rnd, base, 80, True)
    rows = []
    for i, (kind, old, cols) in enumerate(log):
        new = cols.get("id", old)
        rows.append((i * 3, kind, old if old is not None else new, new, "a" in cols, cols.get("a"), "b" in cols, cols.get("b")))
    flat = spark.createDataFrame(rows, "_seq bigint, _kind string, _old_id bigint, _id bigint, _has_a boolean, a string, _has_b boolean, b double")
    for span in (1, 16, 1000):
        got = C.replay_flat(table(spark, base), flat, ["id"], ["a", "b"], block=F.col("_seq") - F.col("_seq") % span)
        assert as_state(got) == fold(base, log)


def test_key_change_then_delete_leaves_neither(spark, tmp_path):
    base = {1: {"a": "x", "b": 1.0}}
    write_log(tmp_path / "log", [("update", 1, {"id": 2}), ("delete", 2, {})])
    changes = C.decode_changes(read_change_log(spark, str(tmp_path / "log")), ["seq"])
    assert C.replay(table(spark, base), changes, KEYS, COLUMNS).count() == 0


def test_chain_of_key_changes_carries_columns(spark, tmp_path):
    base = {1: {"a": "x", "b": 1.0}}
    write_log(tmp_path / "log", [("update", 1, {"id": 2, "a": "y"}), ("update", 2, {"id": 3}), ("update", 3, {"id": 4, "b": 2.0}), ("update", 4, {"id": 5})], per_slice=1)
    changes = C.decode_changes(read_change_log(spark, str(tmp_path / "log")), ["seq"])
    got = C.replay(table(spark, base), changes, KEYS, COLUMNS)
    assert as_state(got) == {5: {"a": "y", "b": 2.0}}


def test_zero_false_and_empty_are_values(spark, tmp_path):
    line = json.dumps({"change": [{"kind": "update", "schema": "s", "table": "t", "columnnames": ["w", "x", "y", "z"], "columnvalues": [0, False, "", None],
                                   "oldkeys": {"keynames": ["id"], "keyvalues": ["it's"]}}], "database": "d"})
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "20240101-000000").write_text(line)
    rows = C.render_sql(C.decode_changes(read_change_log(spark, str(tmp_path / "log")), ["database"])).collect()
    assert rows[0]["statement"] == """UPDATE "s"."t" SET ("w","x","y","z") = ('0','false','',NULL) WHERE "id" = 'it''s';"""


def test_slices_across_midnight(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for name in ("20240131-234800", "20240131-235000", "20240201-000800", "20240201-001200"):
        (tmp_path / "log" / name).write_text(envelope(("delete", 1, {})))
    log = read_change_log(spark, str(tmp_path / "log"))
    assert C.select_slices(log, "2024-01-31 23:50:00", "2024-02-01 00:10:00").count() == 2
    pruned = read_change_log(spark, str(tmp_path / "log"), "2024-01-31 23:50:00", "2024-02-01 00:10:00")
    assert pruned.count() == 2
    assert files_read(pruned) == 2


def files_read(df):
    """Files the scan opened, from its own metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numFiles").value()


def test_values_that_do_not_fit_are_reported(spark, tmp_path):
    write_log(tmp_path / "log", [("insert", None, {"id": 1, "a": "x", "b": "no number"}), ("insert", None, {"id": 2, "b": None})])
    changes = C.decode_changes(read_change_log(spark, str(tmp_path / "log")), ["seq"])
    bad = C.cast_failures(changes, {"b": "double"}).collect()
    assert [(r["column"], r["value"]) for r in bad] == [("b", "no number")]
