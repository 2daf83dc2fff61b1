"""Joins, aggregates, windows and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import windows as W
from ..operators.blocks import join_null_safe
from ..functions.times import epoch_seconds
from .registry import query
from .shapes import AS_OF, TABLES
from .twins import size_sql


def rows_count():
    return F.count(F.lit(1))


@query("jn1_enrich", """
    SELECT n_name, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name""")
def _(t):
    dims = J.enrich(t.customer, t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    owners = J.enrich(t.orders, dims, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    lines = J.enrich(t.lineitem, owners, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return lines.groupBy("n_name").agg(rows_count().alias("n_lines"), revenue.alias("revenue"))


@query("jn2_enrich_left", """
    SELECT t.relid, t.n_live_tup, i.indexrelname FROM v_tables t LEFT JOIN v_indexes i ON t.relid = i.relid AND NOT i.is_valid""")
def _(t):
    invalid = t.v_indexes.filter(~F.col("is_valid")).select("relid", "indexrelname")
    return J.enrich(t.v_tables.select("relid", "n_live_tup"), invalid, ["relid"], "left")


@query("jn3_missing_children", """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P'
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 5)""")
def _(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return J.missing_children(t.orders, lines, ["o_orderkey"], F.col("l_quantity") > 5, F.col("o_orderstatus") == "P").select("o_orderkey", "o_custkey")


@query("jn4_orphans", """
    SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND 1 + o_custkey % 7 = l_linenumber)""")
def _(t):
    a = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("n")).distinct()
    b = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 7 + 1).alias("n"))
    return J.orphans(a, b, ["k", "n"])


@query("jn5_lock_holders", """
    SELECT o_orderkey AS relation, l_returnflag AS mode, l_suppkey AS pid FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_custkey >= 700 AND l_returnflag = 'R'""")
def _(t):
    relations = t.orders.select(F.col("o_orderkey").alias("relation"), F.col("o_custkey").alias("relnamespace"))
    locks = t.lineitem.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("relation"), F.col("l_returnflag").alias("mode"), F.col("l_suppkey").alias("pid"))
    return J.lock_holders(relations, locks, min_namespace=700).select("relation", "mode", "pid")


@query("jn6_semi", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R')""")
def _(t):
    keys = t.lineitem.filter((F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R")).select(F.col("l_orderkey").alias("o_orderkey"))
    return J.semi(t.orders, keys, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("jn7_with_scalar", """
    SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey HAVING count(*) > 0) AS n_orders FROM customer""")
def _(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(rows_count().alias("n_orders"))
    return J.with_scalar(t.customer.select("c_custkey", "c_name"), counts, ["c_custkey"])


@query("jn8_with_constants", """
    SELECT relid, CAST(ceil(table_bytes / (8192 - 20.0)) AS BIGINT) AS pages, 23 AS hdr FROM v_tables""")
def _(t):
    rows = J.with_constants(t.v_tables.select("relid", "table_bytes"), bs=8192, hdr=23)
    return rows.select("relid", F.ceil(F.col("table_bytes") / (F.col("bs") - 20.0)).cast("bigint").alias("pages"), "hdr")


@query("jn9_expand_range", """
    SELECT p_partkey, i FROM part, LATERAL (SELECT unnest(generate_series(1, CAST(p_size AS BIGINT) - 1)) AS i)""")
def _(t):
    return J.expand_range(t.part.select("p_partkey", "p_size"), F.lit(1), F.col("p_size") - 1).select("p_partkey", "i")


FK_KEYS = "SELECT p_brand AS table_schema, concat('fk_', CAST(p_partkey AS STRING)) AS constraint_name, concat('c', CAST(l_linenumber AS STRING)) AS column_name FROM part JOIN lineitem ON p_partkey = l_partkey"
FK_COLS = "SELECT p_brand AS table_schema, concat('fk_', CAST(p_partkey AS STRING)) AS constraint_name, 'public' AS foreign_table_schema, concat('supplier', CAST(p_size % 3 AS STRING)) AS foreign_table_name, concat('s', CAST(l_linenumber % 3 AS STRING)) AS column_name FROM part JOIN lineitem ON p_partkey = l_partkey"
FK_HEAD = "SELECT p_brand AS table_schema, concat('fk_', CAST(p_partkey AS STRING)) AS constraint_name, concat('t', CAST(p_partkey AS STRING)) AS table_name, CASE WHEN p_size % 2 = 0 THEN 'FOREIGN KEY' ELSE 'CHECK' END AS constraint_type FROM part"


@query("jn10_fk_map", f"""
    WITH h AS ({FK_HEAD}), k AS ({FK_KEYS}), c AS ({FK_COLS}),
    ka AS (SELECT table_schema, constraint_name, string_agg(column_name, ',' ORDER BY column_name) AS original_tab_columns FROM (SELECT DISTINCT * FROM k) GROUP BY ALL),
    ca AS (SELECT table_schema, constraint_name, foreign_table_schema, foreign_table_name, string_agg(column_name, ',' ORDER BY column_name) AS foreign_column_names FROM (SELECT DISTINCT * FROM c) GROUP BY ALL)
    SELECT h.table_schema, h.constraint_name, h.table_name, foreign_table_schema, foreign_table_name, original_tab_columns, foreign_column_names
    FROM h JOIN ka ON h.table_schema = ka.table_schema AND h.constraint_name = ka.constraint_name
           JOIN ca ON h.table_schema = ca.table_schema AND h.constraint_name = ca.constraint_name WHERE constraint_type = 'FOREIGN KEY'""")
def _(t):
    return J.fk_map(t.sql(FK_HEAD), t.sql(FK_KEYS), t.sql(FK_COLS))


@query("jn10_referencing", """
    SELECT DISTINCT 'own' AS table_schema, concat('c', CAST(o_custkey AS STRING)) AS table_name, 'own' AS fk_schema_name,
           concat('o', CAST(o_orderkey % 500 AS STRING)) AS fk_table_name, concat('fk_', CAST(o_orderkey AS STRING)) AS fk_name FROM orders""")
def _(t):
    children = t.orders.select(F.lit("own").alias("table_schema"), F.concat(F.lit("o"), (F.col("o_orderkey") % 500).cast("string")).alias("table_name"),
                               F.concat(F.lit("fk_"), F.col("o_orderkey").cast("string")).alias("constraint_name"))
    parents = t.customer.select(F.lit("own").alias("table_schema"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("table_name"),
                                F.concat(F.lit("pk_"), F.col("c_custkey").cast("string")).alias("constraint_name"))
    links = t.orders.select(F.lit("own").alias("constraint_schema"), F.concat(F.lit("fk_"), F.col("o_orderkey").cast("string")).alias("constraint_name"),
                            F.lit("own").alias("unique_constraint_schema"), F.concat(F.lit("pk_"), F.col("o_custkey").cast("string")).alias("unique_constraint_name"))
    return J.referencing(links, children.unionByName(parents))


def index_frames(t):
    n = F.col("n_columns").cast("int")
    indexes = t.v_indexes.select("relid", "indexrelname", F.reverse(F.sequence(F.lit(1), n)).alias("indkey"))
    attributes = t.v_tables.select("relid", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attnum")).withColumn(
        "attname", F.concat(F.lit("a"), F.col("attnum").cast("string")))
    return indexes, attributes


@query("jn11_index_columns", """
    SELECT relid, indexrelname, p AS position, concat('a', CAST(n_columns + 1 - p AS STRING)) AS attname
    FROM v_indexes, LATERAL (SELECT unnest(generate_series(1, n_columns)) AS p)""")
def _(t):
    return J.index_columns(*index_frames(t), ["relid"])


@query("jn11_has_leading_index", "SELECT relid, bool_or(n_columns = 2) AS has_leading_index FROM v_indexes GROUP BY relid")
def _(t):
    return J.has_leading_index(J.index_columns(*index_frames(t), ["relid"]), ["relid"], "a2")


@query("jn12_latest_inventory", f"""
    WITH f AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
               FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)
    SELECT user_id, c_name, event_id, event_type FROM f JOIN customer ON c_custkey = user_id WHERE r = 1""")
def _(t):
    endpoints = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    inventory = t.events.select("user_id", "ts", "event_id", "event_type")
    return J.latest_inventory(endpoints, inventory, ["user_id"], "ts", AS_OF, tie=["event_id"]).select("user_id", "c_name", "event_id", "event_type")


@query("jn13_schema_diff", """
    WITH a AS (SELECT * FROM v_columns WHERE side = 'source'), b AS (SELECT * FROM v_columns WHERE side = 'target')
    SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name,
           a.data_type AS source_type, b.data_type AS target_type,
           CASE WHEN b.side IS NULL THEN 'removed' WHEN a.side IS NULL THEN 'added' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.table_name = b.table_name AND a.column_name = b.column_name
    WHERE a.data_type IS DISTINCT FROM b.data_type""")
def _(t):
    c = t.v_columns
    return J.schema_diff(c.filter("side = 'source'"), c.filter("side = 'target'"), ["table_name", "column_name"])


@query("jn14_replica_bigger", """
    WITH m AS (SELECT *, list_position(['small', 'medium', 'large', 'xlarge', '2xlarge', '4xlarge', '8xlarge', '12xlarge', '16xlarge', '18xlarge', '24xlarge'],
                                       split_part(instance_class, '.', 3)) AS r FROM v_instances),
    p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY r, identifier) AS k FROM m WHERE is_writer)
    SELECT m.cluster, m.identifier AS replica, m.instance_class AS replica_class, p.identifier AS "primary", p.instance_class AS primary_class
    FROM m JOIN p ON m.cluster = p.cluster AND p.k = 1 WHERE NOT m.is_writer AND m.r > p.r""")
def _(t):
    return J.replica_bigger(t.v_instances)


@query("jn16_attribute_services", """
    SELECT DISTINCT concat('db', CAST(user_id % 8 AS STRING)) AS database, event_type AS service, concat('v', CAST(user_id AS STRING)) AS variable FROM events""")
def _(t):
    var = F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("variable")
    variables = t.events.select(var, F.concat(F.lit("db"), (F.col("user_id") % 8).cast("string")).alias("database")).distinct()
    requirements = t.events.select(F.col("event_type").alias("service"), var).distinct()
    return J.attribute_services(variables, requirements, keep=["database"])


@query("agg1_activity_rollup", """
    WITH c AS (SELECT usename, count(DISTINCT client_addr) AS instances FROM v_activity GROUP BY usename),
    l AS (SELECT DISTINCT concat('role', CAST(user_id % 20 AS STRING)) AS usename, 5 * (user_id % 20) AS max_conn FROM events WHERE user_id % 20 > 3)
    SELECT a.datname, a.usename, count(*) FILTER (WHERE state = 'idle') AS idle, count(*) FILTER (WHERE state = 'idle in transaction') AS idle_in_tran,
           count(*) FILTER (WHERE state = 'active') AS active,
           count(*) FILTER (WHERE state = 'idle' AND query_start < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 300 SECOND) AS idle_5_min,
           count(*) FILTER (WHERE state = 'idle' AND query_start < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 180 SECOND) AS idle_3_min,
           count(*) AS total, any_value(c.instances) AS instances, any_value(l.max_conn) AS max_conn
    FROM v_activity a JOIN c ON a.usename = c.usename LEFT JOIN l ON a.usename = l.usename GROUP BY a.datname, a.usename""")
def _(t):
    role = F.col("user_id") % 20
    limits = t.events.filter(role > 3).select(F.concat(F.lit("role"), role.cast("string")).alias("usename"), (role * 5).alias("max_conn")).distinct()
    return A.activity_rollup(t.v_activity, ["datname", "usename"], as_of="2024-01-15 12:00:00", limits=limits)


@query("agg1_activity_by_client", """
    WITH c AS (SELECT usename, count(DISTINCT client_addr) AS instances FROM v_activity GROUP BY usename),
    n AS (SELECT datname, CASE WHEN usename <> 'role7' THEN usename END AS usename, client_addr, state FROM v_activity)
    SELECT n.datname, n.usename, n.client_addr, count(*) FILTER (WHERE state = 'idle') AS idle, count(*) FILTER (WHERE state = 'idle in transaction') AS idle_in_tran,
           count(*) FILTER (WHERE state = 'active') AS active, count(*) AS total, coalesce(any_value(c.instances), 0) AS instances
    FROM n LEFT JOIN c ON n.usename = c.usename GROUP BY ALL""")
def _(t):
    # Sessions without a role, as background processes have.
    sessions = t.v_activity.withColumn("usename", F.when(F.col("usename") != "role7", F.col("usename")))
    return A.activity_rollup(sessions, ["datname", "usename", "client_addr"])


@query("agg2_state_counts", """
    SELECT count(*) AS total, count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'idle') AS idle,
           count(*) FILTER (WHERE state = 'idle in transaction (aborted)') AS idle_in_tran_abort, (SELECT max(o_orderkey) FROM orders) AS max_connections
    FROM v_activity""")
def _(t):
    states = {"active": "active", "idle": "idle", "idle_in_tran_abort": "idle in transaction (aborted)"}
    return A.state_counts(t.v_activity, "state", states, setting=t.orders.agg(F.max("o_orderkey").alias("max_connections")))


@query("agg3_distinct_per", "SELECT usename, count(DISTINCT client_addr) AS clients FROM v_activity GROUP BY usename")
def _(t):
    return A.distinct_per(t.v_activity, ["usename"], "client_addr", "clients")


@query("agg3_united_sketches", "SELECT usename, count(DISTINCT client_addr) AS clients, true AS within_three_percent FROM v_activity GROUP BY usename")
def _(t):
    # A sketch per role and day is the history; the days are united later, without the rows.
    days = A.distinct_sketches(t.v_activity.withColumn("day", F.to_date("query_start")), ["usename", "day"], "client_addr")
    exact = A.distinct_per(t.v_activity, ["usename"], "client_addr", "clients")
    near = F.abs(F.col("distinct_estimate") - F.col("clients")) <= F.greatest(F.col("clients") * 0.03, F.lit(1.0))
    return exact.join(A.united_distinct(days, ["usename"]), "usename").select("usename", "clients", near.alias("within_three_percent"))


@query("agg4_duplicate_groups", f"""
    WITH g AS (SELECT signature, count(*) AS members, CAST(sum(index_bytes) AS BIGINT) AS bytes, list_sort(list(indexrelname)) AS m FROM v_indexes GROUP BY signature HAVING count(*) > 1)
    SELECT members, bytes, {size_sql('bytes')} AS size, m[1] AS member1, m[2] AS member2, m[3] AS member3, m[4] AS member4 FROM g""")
def _(t):
    return A.duplicate_groups(t.v_indexes, ["signature"], "indexrelname", "index_bytes", keep=4)


@query("agg4_duplicate_members", """
    SELECT first_member, members, bytes, doc_id FROM documents JOIN (SELECT text, min(doc_id) AS first_member, count(*) AS members, CAST(sum(n_chars) AS BIGINT) AS bytes
        FROM documents GROUP BY text HAVING count(*) > 1) USING (text)""")
def _(t):
    return A.duplicate_members(t.documents, ["text"], "doc_id", "n_chars", wide=True)


@query("agg4_duplicate_texts", f"""
    WITH g AS (SELECT text, count(*) AS members, CAST(sum(n_chars) AS BIGINT) AS bytes, list_sort(list(doc_id)) AS m FROM documents GROUP BY text HAVING count(*) > 1)
    SELECT members, bytes, {size_sql('bytes')} AS size, m[1] AS member1, m[2] AS member2 FROM g""")
def _(t):
    return A.duplicate_groups(t.documents, ["text"], "doc_id", "n_chars", keep=2, wide=True)


@query("agg5_hit_rates", """
    SELECT 'index hit rate' AS name, round(CAST(sum(idx_scan) AS DOUBLE) / CAST(nullif(sum(idx_scan + n_columns), 0) AS DOUBLE), 6) AS ratio FROM v_indexes
    UNION ALL SELECT 'table hit rate', round(CAST(sum(n_live_tup) AS DOUBLE) / CAST(nullif(sum(n_live_tup) + sum(n_dead_tup), 0) AS DOUBLE), 6) FROM v_tables""")
def _(t):
    index_io = t.v_indexes.select(F.col("idx_scan").alias("idx_blks_hit"), F.col("n_columns").alias("idx_blks_read"))
    table_io = t.v_tables.select(F.col("n_live_tup").alias("heap_blks_hit"), F.col("n_dead_tup").alias("heap_blks_read"))
    return A.hit_rates(index_io, table_io).withColumn("ratio", F.round("ratio", 6))


@query("agg6_index_summary", f"""
    SELECT t.relid, t.relname, t.n_live_tup AS num_rows, {size_sql('t.n_live_tup')} AS rows_in_bytes, count(i.indexrelname) AS number_of_indexes,
           CASE WHEN bool_or(i.is_unique) THEN 'Y' ELSE 'N' END AS "unique", count(*) FILTER (WHERE i.n_columns = 1) AS single_column,
           count(*) FILTER (WHERE i.n_columns > 1) AS multi_column
    FROM v_tables t LEFT JOIN v_indexes i ON t.relid = i.relid GROUP BY t.relid, t.relname, t.n_live_tup""")
def _(t):
    return A.index_summary(t.v_tables, t.v_indexes, rows="n_live_tup")


@query("agg7_state_groups", "SELECT op, ns, wait_state, count(*) AS count FROM v_ops GROUP BY op, ns, wait_state")
def _(t):
    return A.state_groups(t.v_ops, ["op", "ns", "wait_state"])


@query("agg8_connections_by_host", """
    SELECT coalesce(split_part(client, ':', 1), 'Internal') AS host, count(*) AS connections FROM v_ops GROUP BY 1
    UNION ALL SELECT 'TOTAL_CONNECTION_COUNT', count(*) FROM v_ops""")
def _(t):
    return A.connections_by_host(t.v_ops, total=True)


@query("agg9_storage_totals", """
    WITH d AS (SELECT source, n_chars, doc_id FROM documents WHERE NOT regexp_matches(source, 'src1$'))
    SELECT coalesce(source, 'Total') AS source, CAST(sum(n_chars) AS BIGINT) AS "dataSize", CAST(sum(2 * n_chars) AS BIGINT) AS "storageSize",
           CAST(sum(doc_id) AS BIGINT) AS "indexSize", count(*) AS objects, round(CAST(sum(n_chars) AS DOUBLE) / count(*), 0) AS avg_object_size
    FROM d GROUP BY ROLLUP (source)""")
def _(t):
    rows = t.documents.select("source", F.col("n_chars").alias("dataSize"), (F.col("n_chars") * 2).alias("storageSize"),
                              F.col("doc_id").alias("indexSize"), F.lit(1).alias("one"))
    return A.storage_totals(rows, "source", count="one", exclude=["src1"])


@query("agg10_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES))
def _(t):
    return A.row_counts({n: getattr(t, n) for n in TABLES})


@query("agg11_ordered_concat", """
    SELECT conv_id, turn // 4 AS page, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id, turn // 4""")
def _(t):
    return A.ordered_concat(t.conversations, ["conv_id"], "role", "turn", page=4, out="roles")


@query("agg12_distinct_concat", """
    SELECT user_id, CAST(0 AS BIGINT) AS page, string_agg(event_type, ',' ORDER BY event_type) AS types FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def _(t):
    return A.distinct_concat(t.events, ["user_id"], "event_type", out="types")


@query("agg13_collect_names", """
    SELECT p_brand, CAST(0 AS BIGINT) AS page, string_agg(p_name, '|' ORDER BY p_name) AS names FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY p_brand""")
def _(t):
    return A.collect_names(t.part, ["p_brand"], "p_name").withColumn("names", F.array_join("names", "|"))


@query("agg14_key_bounds", """
    SELECT min(l_shipdate) AS min_key, max(l_shipdate) AS max_key FROM lineitem
    UNION ALL SELECT min(l_shipdate), max(l_shipdate) FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-15 12:00:00'""")
def _(t):
    upper = F.lit("1998-06-15 12:00:00").cast("timestamp_ntz")
    return A.key_bounds(t.lineitem, "l_shipdate").unionByName(A.key_bounds(t.lineitem, "l_shipdate", upper))


@query("agg14_footer_bounds", """
    SELECT min(l_orderkey) AS min_key, max(l_orderkey) AS max_key FROM lineitem
    UNION ALL SELECT min(l_orderkey), max(l_orderkey) FROM lineitem WHERE l_orderkey <= 777""")
def _(t):
    path = f"{t.folder}/lineitem.parquet"
    return A.footer_bounds(t.spark, path, "l_orderkey").unionByName(A.footer_bounds(t.spark, path, "l_orderkey", 777))


@query("agg15_area_team_counts", """
    SELECT r_name AS area, coalesce(n_name, 'total') AS team, count(*) AS count
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (r_name, n_name))""")
def _(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("area"), F.col("n_name").alias("team"))
    return A.area_team_counts(t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")))


@query("agg16_cache_share", f"""
    WITH b AS (SELECT l_partkey AS relfilenode, count(*) AS buffers FROM lineitem GROUP BY 1)
    SELECT relfilenode, relname, buffers, {size_sql('(buffers * 8192)')} AS buffered, round(100.0 * CAST(buffers AS DOUBLE) / 1000.0, 1) AS buffers_percent,
           round(CAST(819200 AS DOUBLE) * buffers / table_bytes, 1) AS percent_of_relation
    FROM b JOIN v_tables ON relid = relfilenode WHERE table_bytes > 0 ORDER BY buffers_percent DESC, buffers DESC, relfilenode LIMIT 30""")
def _(t):
    relations = t.v_tables.select(F.col("relid").alias("relfilenode"), "relname", "table_bytes")
    return A.cache_share(t.lineitem.select(F.col("l_partkey").alias("relfilenode")), relations, 1000, size="table_bytes", top=30)


@query("agg17_inventory_tree", """
    WITH i AS (SELECT replace(cluster, '-', '_') AS c, replace(engine, '-', '_') AS e, identifier AS n, instance_class AS h, retention_days AS p FROM v_instances),
    s AS (SELECT chr(1) AS x)
    SELECT 'all' AS path, 'all:' AS line
    UNION ALL SELECT concat('all', x, 'children'), '  children:' FROM s
    UNION ALL SELECT DISTINCT concat('all', x, 'children', x, c), concat('    ', c, ':') FROM i, s
    UNION ALL SELECT DISTINCT concat('all', x, 'children', x, c, x, 'children'), '      children:' FROM i, s
    UNION ALL SELECT DISTINCT concat('all', x, 'children', x, c, x, 'children', x, e), concat('        ', e, ':') FROM i, s
    UNION ALL SELECT DISTINCT concat('all', x, 'children', x, c, x, 'children', x, e, x, 'hosts'), '          hosts:' FROM i, s
    UNION ALL SELECT concat('all', x, 'children', x, c, x, 'children', x, e, x, 'hosts', x, n), concat('            ', n, ':') FROM i, s
    UNION ALL SELECT concat('all', x, 'children', x, c, x, 'children', x, e, x, 'hosts', x, n, x, 'host'), concat('              host: ', h) FROM i, s
    UNION ALL SELECT concat('all', x, 'children', x, c, x, 'children', x, e, x, 'hosts', x, n, x, 'port'), concat('              port: ', CAST(p AS STRING)) FROM i, s""")
def _(t):
    return A.inventory_tree(t.v_instances, ["cluster", "engine"], "identifier", "instance_class", "retention_days")


@query("agg18_extensions", """
    SELECT instance, database, CAST(0 AS BIGINT) AS page, string_agg(extname, ',' ORDER BY extname) AS extensions
    FROM (SELECT DISTINCT l_suppkey AS instance, l_returnflag AS database, concat('ext', CAST(l_linenumber AS STRING)) AS extname FROM lineitem WHERE l_linenumber IN (1, 4, 6))
    GROUP BY instance, database""")
def _(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("instance"), F.col("l_returnflag").alias("database"),
                             F.concat(F.lit("ext"), F.col("l_linenumber").cast("string")).alias("extname"))
    return A.extensions(rows, names=["ext1", "ext4", "ext6"]).withColumn("extensions", F.array_join("extensions", ","))


@query("agg19_estimated_rows", """
    SELECT p.parent, CAST(sum(n_live_tup) AS BIGINT) AS estimated_rows, count(*) AS children
    FROM v_tables JOIN (VALUES ('t1'), ('t2'), ('t25')) p(parent) ON starts_with(lower(relname), p.parent) GROUP BY p.parent""")
def _(t):
    return A.estimated_rows(t.v_tables, ["t1", "T2", "t25"]).withColumn("parent", F.lower("parent"))


@query("agg19_parents_of_a_frame", """
    SELECT concat('T', CAST(s_suppkey AS STRING)) AS parent, CAST(sum(n_live_tup) AS BIGINT) AS estimated_rows, count(*) AS children
    FROM supplier JOIN v_tables ON starts_with(lower(relname), concat('t', CAST(s_suppkey AS STRING))) GROUP BY ALL""")
def _(t):
    parents = t.supplier.select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("parent"))
    return A.estimated_rows(t.v_tables, parents)


@query("agg20_table_traffic", """
    SELECT relid, seq_scan + idx_scan AS table_reads_count, n_live_tup + n_dead_tup AS table_writes_count FROM v_tables""")
def _(t):
    return A.table_traffic(t.v_tables, writes=("n_live_tup", "n_dead_tup")).select("relid", "table_reads_count", "table_writes_count")


@query("agg21_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return A.dedupe(t.events.select("user_id", "event_type"))


@query("win1_gaps", """
    WITH k AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), n AS (SELECT id, lead(id) OVER (ORDER BY id) AS nx FROM k),
    g AS (SELECT id + 1 AS gap_start, nx - 1 AS gap_end, nx - id AS diff, nx - id - 1 AS missing FROM n WHERE id + 1 <> nx
          UNION ALL SELECT 0, min(id), min(id), min(id) FROM k)
    SELECT gap_start, gap_end, diff, missing, gap_start + missing - 1 AS last_missing FROM g""")
def _(t):
    return W.gaps(t.lineitem.select("l_orderkey").distinct(), "l_orderkey", top=None, span=4096)


@query("win1_gaps_widest", """
    WITH k AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS id FROM lineitem), n AS (SELECT s, id, lead(id) OVER (PARTITION BY s ORDER BY id) AS nx FROM k),
    g AS (SELECT s, id + 1 AS gap_start, nx - 1 AS gap_end, nx - id AS diff, nx - id - 1 AS missing FROM n WHERE id + 1 <> nx
          UNION ALL SELECT s, 0, min(id), min(id), min(id) FROM k GROUP BY s),
    r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY diff DESC, gap_start) AS rn FROM g)
    SELECT s AS l_suppkey, gap_start, gap_end, diff, missing, gap_start + missing - 1 AS last_missing FROM r WHERE rn <= 10""")
def _(t):
    return W.gaps(t.lineitem.select("l_suppkey", "l_orderkey").distinct(), "l_orderkey", ["l_suppkey"], top=10, span=4096)


@query("win2_share_of_total", """
    WITH r AS (SELECT l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue FROM lineitem GROUP BY l_partkey)
    SELECT l_partkey, CAST(revenue AS DOUBLE) AS revenue, round(CAST(revenue AS DOUBLE) * 100 / CAST((SELECT sum(revenue) FROM r) AS DOUBLE), 4) AS share_pct FROM r""")
def _(t):
    amount = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    revenue = t.lineitem.groupBy("l_partkey").agg(F.sum(amount).alias("revenue"))
    shared = W.share_of_total(revenue, "revenue", digits=4)
    return shared.select("l_partkey", F.col("revenue").cast("double").alias("revenue"), F.col("share_pct").cast("double").alias("share_pct"))


@query("win3_ordinal", """
    SELECT doc_id, count(*) AS words, max(p) AS last_position, max_by(w, p) AS last_word
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents) GROUP BY doc_id""")
def _(t):
    listed = t.documents.select("doc_id", F.split("text", " ").alias("words")).withColumn("n", F.size("words"))
    words = W.ordinal(listed, "words", ["doc_id", "n"], "w", "p")
    counts = words.groupBy("doc_id").agg(rows_count().alias("words"), F.max("p").alias("last_position"))
    # A maximum of texts is sorted for, so only the words that may be last meet it; counts are hashed.
    last = words.filter(F.col("p") == F.col("n")).groupBy("doc_id").agg(F.max_by("w", "p").alias("last_word"))
    return join_null_safe(counts, last, ["doc_id"])


@query("win4_trend", """
    SELECT instance, metric, epoch(ts)::BIGINT AS at, count(*) OVER w AS samples,
           CASE WHEN count(*) OVER w >= 2 THEN round(regr_slope(value, epoch(ts) - 1704067200) OVER w * 86400, 4) END AS per_day
    FROM v_metrics WINDOW w AS (PARTITION BY instance, metric ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(t):
    sloped = W.trend(t.v_metrics, ["instance", "metric"], "ts", "value", 5, "week")
    return sloped.select("instance", "metric", epoch_seconds("ts").alias("at"), "samples", F.round(F.col("slope") * 86400, 4).alias("per_day"))


@query("win5_eta", """
    WITH l AS (SELECT instance, metric, epoch(ts)::BIGINT AS day_epoch, value, lag(value) OVER (PARTITION BY instance, metric ORDER BY ts) AS before FROM v_metrics),
    e AS (SELECT *, CASE WHEN before IS NULL OR before = value THEN 9999 ELSE CAST(round_even(before / (before - value), 0) AS BIGINT) END AS eta FROM l)
    SELECT instance, metric, day_epoch, round(value - before, 4) AS delta, eta, CASE WHEN eta < 0 THEN 'Close to end' ELSE concat(CAST(eta AS STRING), ' seconds') END AS eta_text FROM e""")
def _(t):
    rows = W.eta(t.v_metrics, ["instance", "metric"], "ts", "value", "week")
    return rows.select("instance", "metric", epoch_seconds("ts").alias("day_epoch"), F.round("delta", 4).alias("delta"), "eta", "eta_text")


@query("win6_latest", """
    SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def _(t):
    return W.latest(t.events.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], "ts", ["event_id"]).drop("ts")


@query("top1_top", "SELECT relid, relname, n_live_tup FROM v_tables ORDER BY n_live_tup DESC, relid LIMIT 50")
def _(t):
    return O.top(t.v_tables.select("relid", "relname", "n_live_tup"), ["-n_live_tup", "relid"], 50)


@query("top2_null_placement", "SELECT relid, idx_scan FROM v_tables ORDER BY idx_scan DESC NULLS FIRST, relid LIMIT 60")
def _(t):
    return O.top(t.v_tables.select("relid", "idx_scan"), ["-idx_scan", "relid"], 60)


@query("top3_mixed_order", "SELECT schemaname, relid, n_dead_tup FROM v_tables ORDER BY schemaname, n_dead_tup DESC NULLS LAST, relid LIMIT 100")
def _(t):
    return O.top(t.v_tables.select("schemaname", "relid", "n_dead_tup"), ["schemaname", "-n_dead_tup nulls last", "relid"], 100)


@query("set1_union_all", "SELECT l_returnflag AS f, l_orderkey AS k FROM lineitem UNION ALL SELECT o_orderstatus, o_orderkey FROM orders")
def _(t):
    return O.union_all(t.lineitem.select(F.col("l_returnflag").alias("f"), F.col("l_orderkey").alias("k")),
                       t.orders.select(F.col("o_orderstatus").alias("f"), F.col("o_orderkey").alias("k")))


@query("set2_union_distinct", "SELECT l_returnflag AS f, l_orderkey AS k FROM lineitem UNION SELECT o_orderstatus, o_orderkey FROM orders")
def _(t):
    return O.union_distinct(t.lineitem.select(F.col("l_returnflag").alias("f"), F.col("l_orderkey").alias("k")),
                            t.orders.select(F.col("o_orderstatus").alias("f"), F.col("o_orderkey").alias("k")))


@query("set3_distinct", "SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem")
def _(t):
    return O.distinct(t.lineitem, ["l_suppkey", "l_shipdate"])
