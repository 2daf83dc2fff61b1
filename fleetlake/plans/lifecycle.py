"""Bulk table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import lifecycle as L
from ..operators.aggregates import key_bounds
from .registry import query, scratch
from .relational import index_frames
from .shapes import AS_OF

CUT = "1997-01-01 00:00:00"


def purged(t, limit=1000):
    return L.purge(t.orders, F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"), "o_orderkey", limit, span=4096)


@query("lif1_purge", f"""
    SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS batch, CAST(1 AS BIGINT) AS rows FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}'""")
def _(t):
    return purged(t).plan


@query("lif1_purge_text_key", f"""
    WITH o AS (SELECT concat('orders/', o_orderpriority, '/', CAST(o_orderkey AS STRING)) AS path, o_orderdate FROM orders)
    SELECT path, (row_number() OVER (ORDER BY path) - 1) // 100 + 1 AS batch, CAST(1 AS BIGINT) AS rows FROM o WHERE o_orderdate < TIMESTAMP '{CUT}'""")
def _(t):
    # A key like the path of an object: all names begin alike.
    orders = t.orders.select(F.concat(F.lit("orders/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), "o_orderdate")
    return L.purge(orders, F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"), "path", 100, span=1024).plan


@query("lif1_purge_decimal_key", """
    WITH l AS (SELECT CAST(l_orderkey AS DECIMAL(20,0)) * 100000 + l_linenumber AS id, l_quantity FROM lineitem)
    SELECT CAST(id AS STRING) AS id, (row_number() OVER (ORDER BY l.id) - 1) // 500 + 1 AS batch, CAST(1 AS BIGINT) AS rows FROM l WHERE l_quantity < 10""")
def _(t):
    # Wider than any binary integer once the factor is large; the order is that of the numbers, not of their texts.
    lines = t.lineitem.select((F.col("l_orderkey").cast("decimal(20,0)") * 100000 + F.col("l_linenumber")).cast("decimal(30,0)").alias("id"), "l_quantity")
    return L.purge(lines, F.col("l_quantity") < 10, "id", 500, span=4096).plan.withColumn("id", F.col("id").cast("string"))


@query("lif1_purge_kept", f"""
    SELECT 'kept' AS side, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}'
    UNION ALL SELECT 'purged', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}'""")
def _(t):
    p = purged(t)

    def side(df, name):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).withColumn("side", F.lit(name))

    return side(p.kept, "kept").unionByName(side(p.purged, "purged"))


@query("lif1_purge_by_row", """
    SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS tuples, CAST(ceil(count(*) / 500.0) AS BIGINT) AS batches, least(500, count(*)) AS largest
    FROM (SELECT l_returnflag, l_linestatus, l_suppkey, l_linenumber, l_quantity, count(*) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY ALL)""")
def _(t):
    df = t.lineitem.select("l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber", "l_quantity")
    plan = L.purge(df, F.col("l_quantity") < 10, None, 500, force=True).plan
    sizes = plan.groupBy("batch").agg(F.sum("rows").alias("r"), F.count(F.lit(1)).alias("t"))
    return sizes.agg(F.sum("r").alias("rows"), F.sum("t").alias("tuples"), F.max("batch").alias("batches"), F.max("t").alias("largest"))


@query("lif1_kept_by_row", """
    SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_quantity >= 10 OR l_quantity IS NULL""")
def _(t):
    kept = L.purge(t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity"), F.col("l_quantity") < 10, None, 500, force=True).kept
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("lif2_purge_progress", f"""
    WITH b AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 + 1 AS batch FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}'),
    c AS (SELECT batch, count(*) AS rows FROM b GROUP BY batch)
    SELECT batch, rows, CAST(sum(rows) OVER (ORDER BY batch) AS BIGINT) AS cumulative FROM c""")
def _(t):
    return L.purge_progress(purged(t, 100).plan, span=16)


@query("lif5_copy_range", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'""")
def _(t):
    # Finished orders were copied before the job was stopped.
    target = t.orders.filter("o_orderstatus = 'F'")
    lo, hi = key_bounds(t.orders, "o_orderkey").first()
    return L.copy_range(t.orders, target, "o_orderkey", lo, hi, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("lif6_resume_point", """
    SELECT region, min(v) AS resume_from FROM (SELECT l_suppkey % 5 AS region, l_suppkey, max(l_orderkey) AS v FROM lineitem GROUP BY ALL) GROUP BY region""")
def _(t):
    progress = t.lineitem.groupBy((F.col("l_suppkey") % 5).alias("region"), "l_suppkey").agg(F.max("l_orderkey").alias("value"))
    return L.resume_point(progress, by=["region"])


@query("lif7_widen_schema", """
    SELECT p_partkey, CAST(p_size AS BIGINT) * 2000000000 AS wide, p_name FROM part""")
def _(t):
    wide = L.widen_schema(t.part)
    return wide.select("p_partkey", (F.col("p_size") * F.lit(2000000000)).alias("wide"), "p_name")


@query("lif7_huge_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n} HAVING count(*) > 1000" for n in ("orders", "part", "lineitem", "supplier")))
def _(t):
    from ..operators.aggregates import row_counts

    return L.huge_tables(row_counts({n: getattr(t, n) for n in ("orders", "part", "lineitem", "supplier")}), threshold=1000)


@query("lif8_backfill", "SELECT c_custkey, CAST(CASE WHEN c_nationkey >= 3 AND c_nationkey < 20 THEN c_nationkey END AS BIGINT) AS nation_new FROM customer")
def _(t):
    return L.backfill(t.customer, "c_nationkey", "nation_new", "bigint", 3, 20).select("c_custkey", "nation_new")


@query("lif9_compare_counts", """
    SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS target_rows, false AS same_count, false AS same_content""")
def _(t):
    copied = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return L.compare_counts(t.orders, copied, content=True)


@query("lif9_equal_contents", "SELECT count(*) AS source_rows, count(*) AS target_rows, true AS same_count, true AS same_content FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    # The same rows in another order, with nulls where a document has no label.
    rows = t.documents.join(t.labels, "doc_id", "left")
    return L.compare_counts(rows, rows.repartition(7, "n_chars"), content=True)


SEQ = {"customer": "c_custkey", "events": "event_id", "lineitem": "l_orderkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey",
       "documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


@query("lif10_sequence_targets", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{c}' AS column_name, coalesce(max({c}), 1) AS set_to FROM {n}" for n, c in SEQ.items()))
def _(t):
    return L.sequence_targets({n: (getattr(t, n), c) for n, c in SEQ.items()})


@query("lif10_orphan_sequences", "SELECT seqname, last_value + 1 AS set_to FROM v_sequences WHERE increment_by < 0")
def _(t):
    seqs = t.v_sequences
    return L.orphan_sequence_targets(seqs, seqs.filter("increment_by > 0"), ["seqname"])


@query("lif11_repartition_table", f"""
    SELECT CASE WHEN ts < TIMESTAMP '2024-01-20 00:00:00' THEN 'default' ELSE strftime(ts, '%Y-%m-%d') END AS part, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
    FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1""")
def _(t):
    rows = L.repartition_table(t.events, "ts", "day", "2024-01-20 00:00:00", "2 weeks", AS_OF)
    path = scratch(t.spark, "partitions")
    L.write_partitioned(rows, path)
    back = t.spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("lif12_readiness", """
    WITH tb AS (SELECT relid, CASE WHEN relid % 2 = 0 THEN 'a2' ELSE 'a3' END AS key_column FROM v_tables)
    SELECT relid, 'key leads no index' AS obstacle FROM tb WHERE NOT EXISTS (SELECT 1 FROM v_indexes i WHERE i.relid = tb.relid AND concat('a', CAST(n_columns AS STRING)) = key_column)
    UNION ALL SELECT relid, CASE WHEN relid % 3 = 0 THEN 'no primary key' ELSE 'composite primary key' END FROM tb WHERE relid % 3 <> 1
    UNION ALL SELECT relid, 'referenced by other tables' FROM tb WHERE EXISTS (SELECT 1 FROM v_indexes i WHERE i.relid = tb.relid AND NOT i.is_valid)""")
def _(t):
    tables = t.v_tables.select("relid", F.when(F.col("relid") % 2 == 0, F.lit("a2")).otherwise(F.lit("a3")).alias("key_column"))
    cols = J.index_columns(*index_frames(t), ["relid"])
    # One row per primary-key column: none, one or two by table.
    constraints = t.v_tables.select("relid", F.explode(F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("relid") % 3).cast("int"))).alias("column_name"))
    return L.readiness(tables, cols, constraints, t.v_indexes.filter("NOT is_valid"), ["relid"])


@query("lif13_copy_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ["orders", "part", "events"]))
def _(t):
    from ..operators.aggregates import row_counts

    path = scratch(t.spark, "copies")
    names = L.copy_tables(["orders", "part", "events"], lambda n: getattr(t, n), lambda df, n: df.write.parquet(f"{path}/{n}"))
    return row_counts({n: t.spark.read.parquet(f"{path}/{n}") for n in names})
