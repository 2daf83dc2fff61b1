"""Filters, projections and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..constants import INSTANCE_SIZES
from ..functions.times import epoch_micros
from ..operators import filters
from ..operators.health import maintenance_windows
from .registry import query
from .shapes import AS_OF
from .twins import lsn_sql, size_sql


@query("flt1_not_similar", """
    SELECT usename, datname, count(*) AS n FROM v_activity
    WHERE NOT regexp_full_match(usename, 'role1|role2.|.*5') GROUP BY usename, datname""")
def _(t):
    rows = t.v_activity.filter(X.not_similar("usename", "role1|role2_|%5"))
    return rows.groupBy("usename", "datname").agg(F.count(F.lit(1)).alias("n"))


@query("flt2_text_filter", """
    SELECT pid, usename, datname FROM v_activity WHERE usename ILIKE 'ROLE1%' AND contains(datname, '3')""")
def _(t):
    cond = X.text_filter("usename", "ROLE1%", ci=True) & X.text_filter("datname", "3") & X.text_filter("state", None)
    return t.v_activity.filter(cond).select("pid", "usename", "datname")


@query("flt3_regex_filter", """
    SELECT pid, usename, datname FROM v_activity
    WHERE NOT regexp_matches(datname, '^db[0-3]$') AND NOT regexp_matches(usename, 'ROLE1', 'i') AND regexp_matches(query, '7')""")
def _(t):
    cond = (
        X.regex_filter("datname", "^db[0-3]$", negate=True) & X.regex_filter("usename", "ROLE1", negate=True, ci=True)
        & X.regex_filter("query", "7")
    )
    return t.v_activity.filter(cond).select("pid", "usename", "datname")


@query("flt4_mentions_table", """
    WITH q AS (SELECT relid, concat(CASE relid % 3 WHEN 0 THEN 'autovacuum: VACUUM ANALYZE ' WHEN 1 THEN 'COPY x FROM ' ELSE 'SELECT * FROM ' END,
                      schemaname, '.t', CAST(relid % 20 AS STRING), CASE relid % 4 WHEN 0 THEN '' WHEN 1 THEN ';' ELSE ' now' END) AS query FROM v_tables)
    SELECT relid, query FROM q
    WHERE query ILIKE '%vacuum%Brand#1%t1' OR query ILIKE '%vacuum%Brand#1%t1"%' OR query ILIKE '%vacuum%Brand#1%t1 %' OR query ILIKE '%vacuum%Brand#1%t1;%'
       OR query LIKE 'COPY%FROM%Brand#1%t1' OR query LIKE 'COPY%FROM%Brand#1%t1;%' OR query LIKE 'COPY%FROM%Brand#1%t1 %' OR query LIKE 'COPY%FROM%Brand#1%t1"%'""")
def _(t):
    rows = t.sql("""
        SELECT relid, concat(CASE relid % 3 WHEN 0 THEN 'autovacuum: VACUUM ANALYZE ' WHEN 1 THEN 'COPY x FROM ' ELSE 'SELECT * FROM ' END,
               schemaname, '.t', CAST(relid % 20 AS STRING), CASE relid % 4 WHEN 0 THEN '' WHEN 1 THEN ';' ELSE ' now' END) AS query FROM v_tables""")
    return rows.filter(X.mentions_table("query", "Brand#1", "t1"))


@query("flt5_slow_or_waiting", """
    SELECT opid, secs_running, wait_state, ns, client FROM v_ops WHERE secs_running > 10 OR wait_state IS NOT NULL""")
def _(t):
    return filters.slow_or_waiting(t.v_ops, limit=10, wait="wait_state", keep=["opid", "secs_running", "wait_state", "ns", "client"])


@query("flt6_lock_waiters", """
    SELECT opid, ns, op FROM v_ops
    WHERE secs_running >= 3 AND (op IN ('insert', 'update', 'remove') OR wait_state IS NOT NULL)""")
def _(t):
    return filters.lock_waiters(t.v_ops, F.col("secs_running") >= 3, "op", F.col("wait_state")).select("opid", "ns", "op")


@query("flt7_active_in_namespace", """
    SELECT opid, ns, secs_running FROM v_ops WHERE regexp_matches(ns, '^db1[.]') AND secs_running > 3""")
def _(t):
    return filters.active_in_namespace(t.v_ops, "^db1[.]", 3, active=None).select("opid", "ns", "secs_running")


@query("flt8_match_tags", """
    SELECT p_partkey, p_type, p_brand FROM part
    WHERE upper(p_type) IN ('PROMO', 'SMALL') AND upper(p_brand) IN ('BRAND#11', 'BRAND#4') AND p_size >= 10""")
def _(t):
    tags = F.map_concat(
        F.create_map(F.lit("type"), F.col("p_type"), F.lit("Brand"), F.col("p_brand")),
        F.when(F.col("p_size") >= 10, F.create_map(F.lit("env"), F.lit("prod"))).otherwise(F.create_map().cast("map<string,string>")))
    rows = t.part.withColumn("tags", tags)
    return rows.filter(X.match_tags("tags", "TYPE=promo,Small;brand=brand#11,BRAND#4;ENV=PROD,DEV")).select("p_partkey", "p_type", "p_brand")


@query("flt9_is_primary", """
    SELECT identifier, engine, CASE WHEN engine IN ('docdb', 'aurora-mysql') THEN is_writer ELSE retention_days >= 4 END AS is_primary FROM v_instances""")
def _(t):
    rows = t.v_instances.withColumn("source", F.when(F.col("retention_days") < 4, F.lit("other")))
    return rows.select("identifier", "engine", X.is_primary("engine", "is_writer", "source").alias("is_primary"))


@query("flt10_fresh", f"""
    SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def _(t):
    return t.events.filter(X.fresh("ts", AS_OF, "7 days")).select("event_id", "user_id")


@query("flt11_unknown_types", "SELECT DISTINCT data_type FROM v_columns WHERE data_type ILIKE 'INTEGER'")
def _(t):
    return filters.unknown_types(t.v_columns, wanted="INTEGER")


@query("flt12_stale", f"""
    SELECT event_type, count(*) AS n FROM events WHERE TIMESTAMP '{AS_OF}' - ts >= INTERVAL 10 DAY GROUP BY event_type""")
def _(t):
    return t.events.filter(X.stale("ts", AS_OF, 10)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("prj1_running", f"""
    SELECT CAST(floor(epoch(TIMESTAMP '{AS_OF}') - epoch(query_start)) AS BIGINT) AS running_seconds, pid, datname, state, left(query, 6) AS query
    FROM v_activity WHERE state <> 'idle'""")
def _(t):
    return filters.running(t.v_activity, "query_start", AS_OF, "query", 6, ["pid", "datname", "state"], F.col("state") != "idle")


@query("prj2_size_pretty", f"""
    SELECT relid, {size_sql('table_bytes')} AS size, {size_sql('(table_bytes * relid * 1000)')} AS large,
           {size_sql('(table_bytes * relid * -1000000)')} AS huge FROM v_tables""")
def _(t):
    # The products outgrow 64 bits from half a million parts on.
    b = F.col("table_bytes").cast("decimal(20,0)") * F.col("relid")
    sizes = t.v_tables.select("relid", "table_bytes", (b * 1000).alias("large"), (b * -1000000).alias("huge"))
    return sizes.select("relid", X.size_pretty("table_bytes").alias("size"), X.size_pretty("large", wide=True).alias("large"), X.size_pretty("huge", wide=True).alias("huge"))


@query("prj3_bytes_to", """
    SELECT relid, round(table_bytes / 1048576.0, 4) AS mb, concat(printf('%.2f', round(table_bytes / 1048576.0, 2)), 'MB') AS mb_text FROM v_tables""")
def _(t):
    return t.v_tables.select("relid", F.round(X.bytes_to("table_bytes", "m"), 4).alias("mb"), X.bytes_text("table_bytes", "m").alias("mb_text"))


@query("prj4_fmt_num", """
    SELECT event_id, lpad(format('{:,}', CAST(event_id * 1001 AS BIGINT)), 16, ' ') AS num, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events""")
def _(t):
    return t.events.select("event_id", X.fmt_num(F.col("event_id") * 1001).alias("num"), X.fmt_ts("ts").alias("at"))


@query("prj5_delay_text", f"""
    WITH g AS (SELECT pid, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(query_start) AS gap FROM v_activity)
    SELECT pid, concat(CAST(gap // 3600000000 AS STRING), ' hours ', CAST((gap // 60000000) % 60 AS STRING), ' minutes ',
                       CAST(CAST(round(CAST(gap % 60000000 AS DECIMAL(18,6)) / 1000000, 2) AS DECIMAL(18,2)) AS STRING), ' seconds') AS delay,
           concat(CAST((gap // 3600000000) % 24 AS STRING), ' hours ', CAST((gap // 60000000) % 60 AS STRING), ' minutes ',
                  CAST(CAST(round(CAST(gap % 60000000 AS DECIMAL(18,6)) / 1000000, 2) AS DECIMAL(18,2)) AS STRING), ' seconds') AS short
    FROM g""")
def _(t):
    return t.v_activity.select("pid", X.delay_text("query_start", AS_OF).alias("delay"), X.delay_text("query_start", AS_OF, compat=True).alias("short"))


@query("prj6_option_or_default", """
    SELECT relid, CAST(coalesce(nullif(regexp_extract(reloptions, 'autovacuum_vacuum_threshold=([0-9.]+)', 1), ''), '50') AS INTEGER) AS threshold,
           CAST(coalesce(nullif(regexp_extract(reloptions, 'autovacuum_vacuum_scale_factor=([0-9.]+)', 1), ''), '0.2') AS DOUBLE) AS scale FROM v_tables""")
def _(t):
    return t.v_tables.select(
        "relid", X.option_or_default("reloptions", "autovacuum_vacuum_threshold", 50, "int").alias("threshold"),
        X.option_or_default("reloptions", "autovacuum_vacuum_scale_factor", F.lit(0.2)).alias("scale"))


@query("prj7_explode_options", """
    WITH o AS (SELECT relid, unnest(string_split(reloptions, ',')) AS kv FROM v_tables)
    SELECT relid, split_part(kv, '=', 1) AS option, split_part(kv, '=', 2) AS value FROM o""")
def _(t):
    return X.explode_options(t.v_tables.withColumn("opts", F.split("reloptions", ",")), "opts", ["relid"])


@query("prj8_extract_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return X.extract_paths(t.events, "props", "k", keep=["event_id"])


@query("prj9_xml_int", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS row_count FROM events")
def _(t):
    xml = F.concat(F.lit("<row><cnt>"), F.get_json_object("props", "$.k"), F.lit("</cnt></row>"))
    return t.events.select("event_id", X.xml_int(xml, "/row/cnt/text()").alias("row_count"))


@query("prj10_parse_sequence_default", """
    SELECT seqname, CASE WHEN increment_by > 0 THEN 'public' ELSE 'own' END AS sequence_schema, seqname AS sequence_name FROM v_sequences""")
def _(t):
    name = F.when(F.col("increment_by") > 0, F.concat(F.lit("public."), F.col("seqname"))).otherwise(F.col("seqname"))
    rows = t.v_sequences.select("seqname", F.concat(F.lit("nextval('"), name, F.lit("'::regclass)")).alias("d"), F.lit("own").alias("s"))
    return X.parse_sequence_default(rows, "d", "s").select("seqname", "sequence_schema", "sequence_name")


@query("prj11_lsn_diff", f"""
    SELECT slot_name, CAST({lsn_sql('current_lsn')} - {lsn_sql('restart_lsn')} AS BIGINT) AS lag FROM v_slots""")
def _(t):
    return t.v_slots.select("slot_name", X.lsn_diff("current_lsn", "restart_lsn").cast("bigint").alias("lag"))


@query("prj12_remediation", """
    SELECT relid, concat('REINDEX TABLE "', schemaname, '".', relname, ';') AS remediation FROM v_tables""")
def _(t):
    return X.remediation(t.v_tables, "REINDEX TABLE %s.%s;", ["schemaname", "relname"]).select("relid", "remediation")


@query("prj13_severity", """
    SELECT relid, CASE WHEN seq_scan - idx_scan < 500 THEN 'minor' WHEN seq_scan - idx_scan < 2500 THEN 'major'
                       WHEN seq_scan - idx_scan >= 2500 THEN 'extreme' END AS severity FROM v_tables""")
def _(t):
    return t.v_tables.select("relid", X.severity(F.col("seq_scan") - F.col("idx_scan"), [500, 2500], ["minor", "major", "extreme"]).alias("severity"))


@query("prj14_ratio", """
    SELECT relid, round(100.0 * CAST(n_dead_tup AS DOUBLE) / nullif(n_live_tup, 0), 2) AS pct FROM v_tables""")
def _(t):
    return t.v_tables.select("relid", X.ratio("n_dead_tup", "n_live_tup", 2, 100.0).alias("pct"))


@query("prj15_chunk_bound", """
    SELECT pid, epoch_us(date_trunc('second', query_start)) AS lo, epoch_us(date_trunc('second', query_start)) + 999999 AS hi FROM v_activity""")
def _(t):
    return t.v_activity.select("pid", epoch_micros(X.chunk_bound("query_start")).alias("lo"), epoch_micros(X.chunk_bound("query_start", end=True)).alias("hi"))


@query("prj16_slice_time", """
    WITH s AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM events)
    SELECT event_id, e - e % 120 AS slice_epoch FROM s""")
def _(t):
    named = t.events.select("event_id", F.concat(F.lit("pg/inst/"), X.slice_name("ts", 120)).alias("name"))
    return named.select("event_id", (epoch_micros(X.slice_time("name")) / F.lit(1000000)).cast("bigint").alias("slice_epoch"))


@query("prj17_enum_rank", """
    SELECT identifier, CAST(list_position(['small', 'medium', 'large', 'xlarge', '2xlarge', '4xlarge', '8xlarge', '12xlarge', '16xlarge', '18xlarge', '24xlarge'],
                            split_part(instance_class, '.', 3)) AS BIGINT) AS size_rank FROM v_instances""")
def _(t):
    return t.v_instances.select("identifier", X.enum_rank("instance_class", INSTANCE_SIZES).alias("size_rank"))


@query("prj18_split_identifier", """
    SELECT identifier, split_part(identifier, '-us-east-1-', 1) AS name, 'us-east-1' AS region, split_part(identifier, '-us-east-1-', 2) AS account FROM v_instances""")
def _(t):
    return t.v_instances.select("identifier", X.split_identifier("identifier").alias("p")).select("identifier", "p.name", "p.region", "p.account")


@query("prj19_omit", "SELECT pid, datname, usename, state, wait_event_type FROM v_activity")
def _(t):
    return filters.omit(t.v_activity, ["query", "client_addr", "query_start"])


@query("prj20_maintenance_windows", """
    SELECT identifier, concat('sun:0', CAST(retention_days AS STRING), ':00-sun:0', CAST(retention_days AS STRING), ':30') AS maintenance_window
    FROM v_instances WHERE engine = 'postgres'""")
def _(t):
    day = F.concat(F.lit("sun:0"), F.col("retention_days").cast("string"))
    rows = t.v_instances.withColumn("w", F.concat(day, F.lit(":00-"), day, F.lit(":30")))
    return maintenance_windows(rows, "postgres", "identifier", "engine", "w")
