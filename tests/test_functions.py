import datetime as dt

from pyspark.sql import functions as F

from fleetlake import functions as X


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return df.select(column.alias("x")).first()["x"]


def test_size_pretty_switches_at_ten_times_the_unit(spark):
    cases = {
        0: "0 bytes", 10239: "10239 bytes", 10240: "10 kB", 10485247: "10239 kB", 10485248: "10 MB", 10485760: "10 MB",
        -10240: "-10 kB", 1610612736: "1536 MB", 10 * 1024 ** 4: "10 TB", 2 ** 62: "4194304 TB",
    }
    df = spark.createDataFrame([(k,) for k in cases], "n bigint")
    got = {r["n"]: r["s"] for r in df.select("n", X.size_pretty("n").alias("s")).collect()}
    assert got == cases


def test_size_pretty_beyond_64_bits(spark):
    """Wide figures agree with narrow ones where both exist, and go on behind them."""
    small = [0, 1, -1, 10239, 10240, 10751, 10752, 10485247, 10485248, (1 << 50) - 1, -(1 << 50), (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in small], "n bigint")
    for r in df.select("n", X.size_pretty("n").alias("a"), X.size_pretty("n", wide=True).alias("b")).collect():
        assert r.a == r.b, r.n
    big = F.lit(16_000_000).cast("decimal(20,0)") * F.lit(1_200_000).cast("bigint") * -1000000
    assert one(spark, X.size_pretty(big, wide=True)) == f"-{(16 * 12 * 10 ** 17 + (1 << 39)) >> 40} TB"
    assert one(spark, X.size_pretty(F.lit("9" * 30).cast("decimal(38,0)"), wide=True)) == f"{(int('9' * 30) + (1 << 39)) >> 40} TB"
    assert one(spark, X.size_pretty(F.lit(None).cast("decimal(38,0)"), wide=True)) is None


def test_prj2_size_pretty_of_many_parts(spark, tmp_path):
    """Part keys of a table sixty times the size: the largest product needs 65 bits."""
    from fleetlake.plans import catalog

    spark.createDataFrame([(1_200_000, "b", 1800.5, 3), (7, "b", 1.0, 4)], "p_partkey bigint, p_brand string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([], "l_orderkey bigint, l_partkey bigint, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.relid: tuple(r)[1:] for r in catalog.queries()["prj2_size_pretty"](spark, str(tmp_path)).collect()}
    size = int(1800.5 * 8192) * 1_200_000
    assert got[1_200_000] == ("14 MB", f"{(size * 1000 + (1 << 39)) >> 40} TB", f"-{(size * 10 ** 6 + (1 << 39)) >> 40} TB")
    assert got[7] == ("8192 bytes", "55 MB", "-53 GB")


def test_size_pretty_null(spark):
    assert one(spark, X.size_pretty(F.lit(None).cast("bigint"))) is None


def test_lsn_difference_crosses_the_high_word(spark):
    assert int(one(spark, X.lsn_diff("a", "b"), a="1A/10", b="19/FFFFFFF0")) == 32
    assert int(one(spark, X.lsn_diff("a", "b"), a="FFFFFFFF/FFFFFFFF", b="0/0")) == 2 ** 64 - 1


def test_ratio_of_zero_is_null(spark):
    assert one(spark, X.ratio(F.lit(5), F.lit(0))) is None


def test_tag_predicate_needs_every_key(spark):
    tags = F.create_map(F.lit("ENV"), F.lit("PROD"))
    assert one(spark, X.match_tags(tags, "env=prod,dev;team=x")) is False
    assert one(spark, X.match_tags(tags, "env=prod,dev")) is True
    pair = F.array(F.struct(F.lit("Env").alias("Key"), F.lit("dev").alias("Value")), F.struct(F.lit("ENV").alias("Key"), F.lit("prod").alias("Value")))
    assert one(spark, X.match_tags(pair, "env=PROD", as_map=False)) is True


def test_similar_pattern_is_anchored(spark):
    names = ["postgres", "postgres2", "template9", "app_delete_me", "app", "a.b", "dba_x", "dbaXx"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    kept = {r["n"] for r in df.filter(X.not_similar("n", "postgres|template%|%delete_me|dba_x|a.b")).collect()}
    assert kept == {"postgres2", "app"}


def test_mentions_table_respects_the_name_end(spark):
    texts = {
        "autovacuum: VACUUM public.t1": True, "vacuum analyze public.t10": False, 'COPY x FROM "public"."t1" x': True,
        "copy x from public.t1": False, "VACUUM public.t1;": True, "SELECT public.t1": False,
    }
    df = spark.createDataFrame([(q,) for q in texts], "q string")
    got = {r["q"]: r["m"] for r in df.select("q", X.mentions_table("q", "public", "t1").alias("m")).collect()}
    assert got == texts


def test_delay_text_drops_days_only_in_compat(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    as_of = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    assert one(spark, X.delay_text(start, as_of)) == "27 hours 4 minutes 5.68 seconds"
    assert one(spark, X.delay_text(start, as_of, compat=True)) == "3 hours 4 minutes 5.68 seconds"


def test_slice_time_of_a_path(spark):
    got = one(spark, X.slice_time(F.lit("pg/inst/20240131-235959")))
    assert got == dt.datetime(2024, 1, 31, 23, 59, 59)
    assert one(spark, X.slice_time(F.lit("pg/inst/readme"))) is None


def test_identifier_with_dashes_in_the_name(spark):
    p = one(spark, X.split_identifier(F.lit("my-data-base-us-east-1-acct")))
    assert (p["name"], p["region"], p["account"]) == ("my-data-base", "us-east-1", "acct")


def test_severity_and_enum_rank(spark):
    assert one(spark, X.severity(F.lit(500), [500, 2500], ["a", "b", "c"])) == "b"
    assert one(spark, X.enum_rank(F.lit("db.r5.2xlarge"), ["large", "2xlarge"])) == 2
    assert one(spark, X.enum_rank(F.lit("db.r5.metal"), ["large"])) is None


def test_quoting(spark):
    assert one(spark, X.quote_ident(F.lit('My"Table'))) == '"My""Table"'
    assert one(spark, X.quote_ident(F.lit("plain_1"))) == "plain_1"
    assert one(spark, X.quote_literal(F.lit("it's"))) == "'it''s'"
    assert one(spark, X.quote_literal(F.lit(None).cast("string"))) == "NULL"


def test_primary_test_by_engine(spark):
    rows = [("docdb", True, None, True), ("docdb", None, None, False), ("postgres", None, None, True), ("mysql", None, "src", False), ("neptune", True, None, False)]
    df = spark.createDataFrame(rows, "e string, w boolean, s string, want boolean")
    assert df.filter(X.is_primary("e", "w", "s") != F.col("want")).count() == 0


def test_number_format(spark):
    assert one(spark, X.fmt_num(F.lit(1234567))) == "       1,234,567"
    assert one(spark, X.fmt_num(F.lit(0))) == "               0"
