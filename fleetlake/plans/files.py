"""Sources and sinks, written and read back below the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..operators.changes import decode_changes
from ..sources import (
    kv_scan, land_snapshot, land_targets, read_change_log, read_inventory, read_items, read_landed, read_lines_from, read_lines_indexed, read_ops, read_snapshots, write_change_log,
    write_findings, write_inventory, write_tree,
)
from ..sources.findings import findings, read_findings
from ..streaming import read_broker, write_slices
from .change import envelope_lines
from ..functions.times import epoch_seconds
from .registry import query, scratch
from .shapes import AS_OF


@query("src1_land_snapshot", """
    SELECT 'inst' || CAST(o_orderkey % 3 AS STRING) AS instance, 'app' AS database, o_orderpriority, o_orderkey, o_orderstatus = 'F' AS finished
    FROM orders WHERE o_totalprice > 1000
    UNION ALL SELECT 'inst3', 'app', 'failed', NULL, NULL""")
def _(t):
    targets = [{"instance": f"inst{i}", "database": "app", "rest": i} for i in range(4)]
    path = scratch(t.spark, "snapshot")
    view = "SELECT o_orderpriority, o_orderkey, o_orderstatus = 'F' AS finished FROM {orders} WHERE o_totalprice > 1000"

    def reader(spark, target, view_sql):
        if target["rest"] == 3:
            raise ConnectionError("no route")
        return spark.sql(view_sql, orders=t.orders.filter(F.col("o_orderkey") % 3 == target["rest"]))

    # The second landing of the run replaces the first.
    land_snapshot(t.spark, targets[:2], view, AS_OF, path, reader, batch=2)
    failed = land_snapshot(t.spark, targets, view, AS_OF, path, reader, batch=2)
    columns = ["instance", "database", "o_orderpriority", "o_orderkey", "finished"]
    return read_snapshots(t.spark, path).select(*columns).unionByName(
        failed.select("instance", "database", F.lit("failed").alias("o_orderpriority")), allowMissingColumns=True)


@query("src1_targets_in_tasks", """
    SELECT 'inst' || CAST(o_orderkey % 3 AS STRING) AS instance, 'app' AS database, o_orderpriority, o_orderkey, o_orderstatus = 'F' AS finished FROM orders
    UNION ALL SELECT 'inst3', 'app', 'failed', NULL, NULL""")
def _(t):
    # Files stand in for the servers; a task opens its own.
    path = scratch(t.spark, "targets")
    fields = "o_orderpriority string, o_orderkey bigint, finished boolean"
    rows = t.orders.select("o_orderpriority", "o_orderkey", (F.col("o_orderstatus") == "F").alias("finished"), (F.col("o_orderkey") % 3).alias("server"))
    rows.repartition("server").write.partitionBy("server").parquet(f"{path}/servers")

    def fetch(target):
        import pyarrow.dataset as ds

        if target["server"] == 3:
            raise ConnectionError("no route")
        for batch in ds.dataset(f"{path}/servers/server={target['server']}", format="parquet").to_batches():
            yield from zip(*[batch.column(c).to_pylist() for c in ("o_orderpriority", "o_orderkey", "finished")])

    targets = [{"instance": f"inst{i}", "database": "app", "server": i} for i in range(4)]
    # The run is landed twice; a target that failed the first time and came later would not be there twice.
    land_targets(t.spark, targets[1:], fetch, fields, AS_OF, f"{path}/landed")
    failed = land_targets(t.spark, targets, fetch, fields, AS_OF, f"{path}/landed")
    return read_landed(t.spark, f"{path}/landed", fields).drop("snapshot_ts").unionByName(
        failed.select("instance", "database", F.lit("failed").alias("o_orderpriority")), allowMissingColumns=True)


def sliced_lines(t):
    from ..functions import slice_name

    # A transaction's place in the log is part of what is written.
    return envelope_lines(t).select("value", "seq", slice_name("ts", 43200).alias("slice"))


@query("src4_read_change_log", """
    WITH s AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM v_changes)
    SELECT database, kind, table_name AS "table", e - e % 43200 AS slice_epoch, count(*) AS n FROM s GROUP BY ALL""")
def _(t):
    path = scratch(t.spark, "changelog")
    write_change_log(sliced_lines(t), path)
    rows = decode_changes(read_change_log(t.spark, path), ["database", "slice_ts", "seq"])
    return rows.groupBy("database", "kind", "table", epoch_seconds("slice_ts").alias("slice_epoch")).agg(F.count(F.lit(1)).alias("n"))


@query("src5_write_slices", "SELECT database, kind, count(*) AS n FROM v_changes GROUP BY ALL")
def _(t):
    path = scratch(t.spark, "slices")
    write_change_log(sliced_lines(t), f"{path}/in")
    stream = read_broker(t.spark, {"path": f"{path}/in", "recursiveFileLookup": "true"}, "text")
    write_slices(stream, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    rows = decode_changes(read_change_log(t.spark, f"{path}/out"), ["database", "slice_ts"])
    return rows.filter(F.col("slice_ts").isNotNull()).groupBy("database", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("src6_read_broker", "SELECT seq, kind FROM v_changes")
def _(t):
    path = scratch(t.spark, "broker")
    envelope_lines(t).select("value", F.floor(F.col("seq") / 1000).alias("seq_block"), "seq").select(
        F.concat(F.col("seq").cast("string"), F.lit("\t"), F.col("value")).alias("value")).write.text(f"{path}/in")
    query_ = read_broker(t.spark, {"path": f"{path}/in"}, "text").writeStream.format("text").option(
        "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
    query_.awaitTermination()
    cut = F.split_part("value", F.lit("\t"), F.lit(1)).cast("bigint")
    return t.spark.read.text(f"{path}/out").select(cut.alias("seq"), F.regexp_extract("value", '"kind":"(\\w+)"', 1).alias("kind"))


INVENTORY = """
    SELECT 'ar' AS country, 'mod' AS instance_module, lower(cluster) AS instance_alias, lower(identifier) AS instance_name, lower(concat(identifier, '.Host')) AS instance_endpoint,
           '' AS instance_cname, '5432' AS instance_port, CAST(retention_days AS STRING) AS instance_tunnel_port, lower(instance_class) AS instance_role FROM v_instances"""


def inventory_rows(t):
    return t.v_instances.select(
        F.lit("AR").alias("country"), F.lit("Mod").alias("instance_module"), F.col("cluster").alias("instance_alias"), F.col("identifier").alias("instance_name"),
        F.concat("identifier", F.lit(".Host")).alias("instance_endpoint"), F.lit(None).cast("string").alias("instance_cname"), F.lit("5432").alias("instance_port"),
        F.col("retention_days").cast("string").alias("instance_tunnel_port"), F.col("instance_class").alias("instance_role"))


@query("src7_read_inventory", INVENTORY)
def _(t):
    path = scratch(t.spark, "inventory")
    write_inventory(inventory_rows(t), path)
    return read_inventory(t.spark, path)


@query("src8_write_inventory", """
    SELECT concat('AR:Mod:', cluster, ':', identifier, ':', identifier, '.Host::5432:', CAST(retention_days AS STRING), ':', instance_class) AS line FROM v_instances""")
def _(t):
    path = scratch(t.spark, "inventory")
    write_inventory(inventory_rows(t), path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query("src9_kv_scan", """
    SELECT 'eq' AS mode, concat('user', CAST(user_id AS STRING), '/', CAST(event_id AS STRING)) AS id, props AS value FROM events WHERE props = '{"k": 7}'
    UNION ALL SELECT 'contains', concat('user', CAST(user_id AS STRING), '/', CAST(event_id AS STRING)), props FROM events WHERE contains(concat('user', CAST(user_id AS STRING), '/', CAST(event_id AS STRING)), 'r12/')""")
def _(t):
    path = scratch(t.spark, "items")
    t.events.select(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("value")).write.json(path)
    items = read_items(t.spark, path)
    return kv_scan(items, "value", '{"k": 7}').withColumn("mode", F.lit("eq")).unionByName(kv_scan(items, "id", "r12/", "contains").withColumn("mode", F.lit("contains")))


@query("src10_read_lines_from", """
    SELECT row_number() OVER (ORDER BY event_id) - 1 AS line_no, concat(CAST(event_id AS STRING), ' ', event_type) AS line FROM events QUALIFY line_no >= 500""")
def _(t):
    path = scratch(t.spark, "lines")
    t.events.orderBy("event_id").select(F.concat(F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"))).write.text(path)
    return read_lines_from(t.spark, path, 500)


@query("src10_resumed_lines", """
    SELECT row_number() OVER (ORDER BY event_id) - 1 AS line_no, concat(CAST(event_id AS STRING), ' ', event_type) AS line FROM events QUALIFY line_no >= 700""")
def _(t):
    # The first read indexes half of the lines; the rest is appended in a file of its own, and the second read resumes.
    path = scratch(t.spark, "resumed")
    half = t.events.agg(F.floor(F.avg("event_id"))).first()[0]
    text = t.events.select("event_id", F.concat(F.col("event_id").cast("string"), F.lit(" "), F.col("event_type")).alias("value"))
    for k, part in enumerate([text.filter(F.col("event_id") <= half), text.filter(F.col("event_id") > half)]):
        part.orderBy("event_id").select("value").write.text(f"{path}/in/part{k}")
        found = read_lines_indexed(t.spark, f"{path}/in", f"{path}/index", 700, every=100)
        if not k:
            found.agg(F.max("line_no")).first()
    return found


@query("src11_read_ops", "SELECT opid, secs_running, wait_state AS \"WaitState\", ns, op FROM v_ops WHERE secs_running > 10 OR wait_state IS NOT NULL")
def _(t):
    path = scratch(t.spark, "ops")
    t.v_ops.withColumnRenamed("wait_state", "WaitState").write.json(path)
    return filters.slow_or_waiting(read_ops(t.spark, path), keep=["opid", "secs_running", "WaitState", "ns", "op"])


@query("snk1_write_findings", "SELECT 'dead-rows' AS check_id, concat('t', CAST(relid AS STRING)) AS object, 'warning' AS severity FROM v_tables WHERE n_dead_tup > 12")
def _(t):
    path = scratch(t.spark, "findings")
    bad = t.v_tables.filter("n_dead_tup > 12")
    write_findings(findings(bad, "dead-rows", "relname", AS_OF, [], details=["n_dead_tup"]), path)
    return read_findings(t.spark, path, []).select("check_id", "object", "severity")


@query("snk3_write_tree", """
    WITH i AS (SELECT replace(engine, '-', '_') AS e, identifier AS n, instance_class AS h, retention_days AS p FROM v_instances)
    SELECT 'all:' AS line UNION ALL SELECT '  children:' UNION ALL SELECT DISTINCT concat('    ', e, ':') FROM i UNION ALL SELECT '      hosts:' FROM (SELECT DISTINCT e FROM i)
    UNION ALL SELECT concat('        ', n, ':') FROM i UNION ALL SELECT concat('          host: ', h) FROM i UNION ALL SELECT concat('          port: ', CAST(p AS STRING)) FROM i""")
def _(t):
    path = scratch(t.spark, "tree")
    write_tree(t.v_instances, path, levels=["engine"], name="identifier", host="instance_class", port="retention_days")
    return t.spark.read.text(path).withColumnRenamed("value", "line")
