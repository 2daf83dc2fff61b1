import random

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import aggregates as A
from fleetlake.operators import blocks as B
from fleetlake.operators import health as H
from fleetlake.operators import joins as J
from fleetlake.operators import lifecycle as L
from fleetlake.operators import metrics as M
from fleetlake.operators import windows as W
from fleetlake.operators.ordering import order, top
from fleetlake.operators.recursion import list_positions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_gaps_of_three_keys(spark):
    df = spark.createDataFrame([(5,), (6,), (9,)], "id bigint")
    assert rows(W.gaps(df, "id", span=4)) == [(0, 5, 5, 5, 4), (7, 8, 3, 2, 8)]


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_gaps_do_not_depend_on_the_block_width(spark, span):
    rnd = random.Random(span)
    ids = sorted(rnd.sample(range(-50, 400), 120))
    want = [(a + 1, b - 1, b - a, b - a - 1, b - 1) for a, b in zip(ids, ids[1:]) if a + 1 != b] + [(0, ids[0], ids[0], ids[0], ids[0] - 1)]
    got = rows(W.gaps(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id", top=None, span=span))
    assert got == sorted(want)


@pytest.mark.parametrize("span", [1, 5, 64])
def test_row_numbers_and_running_sum_over_blocks(spark, span):
    rnd = random.Random(3)
    data = [(s, k, rnd.randint(-5, 9)) for s in ("a", "b", None) for k in rnd.sample(range(200), 60)]
    df = spark.createDataFrame(data, "s string, k int, v int")
    numbered = B.running_sum(
        B.row_numbers(df, "k", ["s"], B.int_block(F.col("k"), span)), "k", "v", ["s"], B.int_block(F.col("k"), span))
    got = {(r["s"], r["k"]): (r["row_no"], r["cumulative"]) for r in numbered.collect()}
    for s in ("a", "b", None):
        total = 0
        for n, (_, k, v) in enumerate(sorted(x for x in data if x[0] == s), start=1):
            total += v
            assert got[(s, k)] == (n, total)
    assert len(got) == len(data)


def test_halo_reaches_over_sparse_blocks(spark):
    df = spark.createDataFrame([("x", t, float(t * t)) for t in (0, 1, 50, 51, 900, 901, 902)], "s string, t bigint, v double")
    halo = B.with_halo(df, ["s"], "t", B.int_block(F.col("t"), 10), 3)
    copies = sorted((r["_block"], r["t"]) for r in halo.filter("_halo").collect())
    assert copies == [(50, 0), (50, 1), (900, 1), (900, 50), (900, 51)]


def test_duplicate_groups_keep_the_first_members_and_the_whole_size(spark):
    df = spark.createDataFrame([(None, f"i{n}", 1000) for n in range(6)] + [("", "j", 5), ("z", "k", 1)], "sig string, m string, b bigint")
    got = A.duplicate_groups(df, ["sig"], "m", "b", keep=4).collect()
    assert [(r["members"], r["bytes"], r["member1"], r["member4"]) for r in got] == [(7, 6005, "i0", "i3")]


def test_lists_come_in_bounded_pages_and_lose_nothing(spark):
    df = spark.createDataFrame([("a", f"n{i:04d}") for i in range(500)] + [("b", "x"), ("b", "x"), ("b", None)], "k string, n string")
    pages = A.collect_names(df, ["k"], "n", page=50).collect()
    assert sorted(x for r in pages if r["k"] == "a" for x in r["names"]) == [f"n{i:04d}" for i in range(500)]
    assert max(len(r["names"]) for r in pages) < 120
    assert [r["names"] for r in pages if r["k"] == "b"] == [["x"]]


def test_ordered_concat_pages(spark):
    df = spark.createDataFrame([("a", i, str(i)) for i in range(7)], "k string, p int, v string")
    got = rows(A.ordered_concat(df, ["k"], "v", "p", page=3))
    assert got == [("a", 0, "0,1,2"), ("a", 1, "3,4,5"), ("a", 2, "6")]


def test_top_puts_nulls_first_when_descending(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "i int, v int")
    assert [r["i"] for r in top(df, ["-v", "i"], 2).collect()] == [2, 3]
    assert [r["i"] for r in order(df, ["v"]).collect()] == [1, 3, 2]
    assert [r["i"] for r in order(df, ["-v nulls last"]).collect()] == [3, 1, 2]


def test_purge_keeps_null_predicates_and_splits_whole(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9), (4, 1)], "id int, d int")
    p = L.purge(df, F.col("d") < 6, "id", limit=1)
    assert rows(p.kept.select("id")) == [(2,), (3,)]
    assert rows(p.plan) == [(1, 1, 1), (4, 2, 1)]
    assert rows(p.kept.unionAll(p.purged).fillna(-1)) == rows(df.fillna(-1))


def test_purge_without_key_is_refused(spark):
    with pytest.raises(ValueError):
        L.purge(spark.range(3), F.lit(True), None)
    with pytest.raises(TypeError):
        L.purge(spark.range(3).select(F.array("id").alias("id")), F.lit(True), "id")


@pytest.mark.parametrize("kind", ["string", "decimal(30,4)", "double", "date", "timestamp", "timestamp_ntz", "boolean"])
def test_purge_follows_the_order_of_any_key(spark, kind):
    key = {"string": F.concat(F.lit("a/very/long/beginning/of/a/path/"), F.col("id").cast("string")), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")),
           "boolean": F.col("id") > 0, "timestamp_ntz": (F.col("id") * 1_000_003).cast("timestamp").cast("timestamp_ntz")}.get(kind)
    key = (F.col("id") * 1_000_003).cast(kind) if key is None else key
    df = spark.range(-300, 1200).select(key.alias("k")).repartition(5)
    plan = L.purge(df, F.lit(True), "k", limit=70, span=40).plan
    got = [(r.k, r.batch) for r in plan.collect()]
    if kind == "boolean":
        assert sorted(n for n, in [(sum(b == x for _, b in got),) for x in set(b for _, b in got)]) == [30] + [70] * 21
        return
    ordered = sorted(r.k for r in df.collect())
    assert sorted(got) == [(k, i // 70 + 1) for i, k in enumerate(ordered)]


def test_names_with_a_common_beginning_fill_blocks_evenly(spark):
    names = spark.range(20_000).select(F.concat(F.lit("/srv/data/archive/2024/customer/"), F.sha2(F.col("id").cast("string"), 256)).alias("n"))
    sizes = [r["count"] for r in B.with_blocks(names, "n", 1000).groupBy("_blk").count().collect()]
    assert 17 <= len(sizes) <= 22 and max(sizes) < 1800
    listed = A.ranked_names(names.withColumn("s", F.lit(1)), ["s"], "n", span=1000).orderBy("place").collect()
    assert [r.place for r in listed] == list(range(1, 20_001)) and [r.n for r in listed] == sorted(r.n for r in listed)


def test_blocks_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None,)] * 50 + [("x",)] * 50, "k string")
    assert B.with_blocks(df, "k", 10).count() == 100
    assert B.with_blocks(df.limit(0), "k", 10).count() == 0
    assert B.with_blocks(spark.range(5), "id", 1 << 20).select("_blk").distinct().collect() == [(0,)]


def test_schema_diff_of_itself_is_empty(spark):
    df = spark.createDataFrame([("s", "t", "c", "int"), ("s", "t", "d", None)], "table_schema string, table_name string, column_name string, data_type string")
    assert J.schema_diff(df, df).count() == 0


def test_replica_bigger_returns_every_larger_replica(spark):
    members = [("c", "w", "db.r5.large", True), ("c", "r1", "db.r5.xlarge", False), ("c", "r2", "db.r5.2xlarge", False), ("c", "r3", "db.r5.large", False), ("d", "x", "db.r5.8xlarge", False)]
    df = spark.createDataFrame(members, "cluster string, identifier string, instance_class string, is_writer boolean")
    assert sorted(r["replica"] for r in J.replica_bigger(df).collect()) == ["r1", "r2"]


def test_semi_join_matches_no_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert rows(J.semi(df, df, ["a", "b"])) == [(2, 3)]


def test_expand_range_of_an_empty_range(spark):
    df = spark.createDataFrame([(1, 3), (5, 4)], "lo int, hi int")
    assert rows(J.expand_range(df, "lo", "hi").select("lo", "i")) == [(1, 1), (1, 2), (1, 3)]


def test_ids_left_by_sign_and_step(spark):
    cases = [("int_end", "integer", 2147483647, 1, 0), ("neg_up", "integer", -10, 1, 10), ("neg_down", "integer", -10, -1, 2147483637), ("pos_down", "integer", 10, -1, 10),
             ("big", "bigint", -9223372036854775807, -1, 0)]
    df = spark.createDataFrame([c[:4] for c in cases], "seqname string, data_type string, last_value bigint, increment_by int")
    got = {r["seqname"]: (int(r["ids_left"]), r["status"]) for r in H.int_exhaustion(df, None).collect()}
    assert {k: v[0] for k, v in got.items()} == {c[0]: c[4] for c in cases}
    assert got["int_end"][1] == "exhausted"


def test_missing_index_rules_and_null_scans(spark):
    df = spark.createDataFrame([("public", "t", 200, None, 20000, 2000000)], "schemaname string, relname string, seq_scan bigint, idx_scan bigint, n_live_tup bigint, table_bytes bigint")
    assert H.missing_index(df, "positive_gap").count() == 0
    assert H.missing_index(df, "scan_gap").count() == 0
    assert H.missing_index(df, "two_percent").count() == 1


def test_list_positions_long_chain_cycle_and_orphan(spark):
    n = 300
    chain = [("a", i, i - 1 if i > 1 else None) for i in range(1, n + 1)]
    rest = [("b", 1, 2), ("b", 2, 1), ("c", 5, 4), ("c", 9, None)]
    df = spark.createDataFrame(chain + rest, "s string, node int, prev int")
    got = rows(list_positions(df, ["s"], "node", "prev"))
    assert got == [("a", i, i) for i in range(1, n + 1)] + [("c", 9, 1)]


def test_gate_with_missing_samples(spark):
    df = spark.createDataFrame([("i", "CPUUtilization", 1, 10.0)], "instance string, metric string, ts int, value double")
    wide = M.wide(df)
    assert M.metric_gate(wide).first()["gate_open"] is True
    assert M.metric_gate(wide, {"min_burst_balance": 100.5}).first()["gate_open"] is False


def test_widen_schema_only_for_huge_tables(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b bigint")
    assert L.widen_schema(df).dtypes == [("a", "bigint"), ("b", "bigint")]


def test_compare_counts_sees_changed_content(spark):
    a, b = spark.range(10), spark.range(1, 11)
    r = L.compare_counts(a, b, content=True).first()
    assert r["same_count"] and not r["same_content"]


def test_copy_range_skips_present_rows(spark):
    src = spark.createDataFrame([(i, i * 10) for i in range(6)], "id int, v int")
    assert rows(L.copy_range(src, src.filter("id in (2, 5)"), "id", 1, 4, ["id"])) == [(1, 10), (3, 30), (4, 40)]


def test_win3_ordinal_counts_without_a_sort(spark, tmp_path):
    """Null and repeated identifiers, null and empty texts; words are counted in a hash aggregate."""
    from fleetlake.plans import catalog

    rows = [(1, "a b  c"), (1, "d e"), (None, "x y z"), (None, "w"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["win3_ordinal"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 6, 4, "c"), (2, 1, 1, ""), (None, 4, 3, "z")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[doc_id" in plan.replace("ObjectHashAggregate", "")


def test_index_shape_keeps_its_tasks_small(spark, tmp_path, monkeypatch):
    """With few shuffle partitions a task still gets about as many lines as it may, and the rows are those of the plain shape."""
    from fleetlake.plans import shapes

    lines = spark.range(8000).select(
        (F.col("id") % 1000).alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey"), F.col("id").cast("double").alias("l_extendedprice"))
    lines.unionByName(lines.limit(50)).unionByName(lines.limit(1).withColumn("l_partkey", F.lit(None).cast("bigint"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(shapes, "DEALT_ROWS", 400, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        t = shapes.Tables(spark, str(tmp_path))
        got = t.v_indexes
        assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 800
        plain = spark.sql(shapes.SHAPES["v_indexes"].replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.lineitem)
        assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty() and got.count() > 6000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
