"""Fleet-health reports, fan-out over the fleet, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..functions.times import epoch_micros
from ..operators import filters
from ..operators import health as H
from ..operators.aggregates import activity_rollup
from ..sources import candidate_databases, fan_out, findings, render_rows
from .registry import query
from .shapes import AS_OF
from .twins import lsn_sql, size_sql


@query("hlt1_database_sizes", f"""
    SELECT instance, datname, size_bytes, {size_sql('size_bytes')} AS db_size FROM v_databases
    WHERE datallowconn AND NOT regexp_full_match(datname, 'rdsadmin|template.*|postgres|.*delete_me')""")
def _(t):
    return H.database_sizes(t.v_databases, active_only=True, keys=["instance"])


@query("hlt1_all_database_sizes", f"SELECT instance, datname, size_bytes, {size_sql('size_bytes')} AS db_size FROM v_databases")
def _(t):
    return H.database_sizes(t.v_databases, keys=["instance"])


TABLE_SIZES = """SELECT t.schemaname, t.relid, t.relname, t.table_bytes + coalesce(i.index_bytes, 0) + coalesce(t.toast, 0) AS total_bytes,
    coalesce(i.index_bytes, 0) AS index_bytes, t.toast AS toast_bytes
    FROM (SELECT schemaname, relid, relname, table_bytes, nullif(n_dead_tup * 8192, 0) AS toast FROM v_tables) t
    LEFT JOIN (SELECT relid, CAST(sum(index_bytes) AS BIGINT) AS index_bytes FROM v_indexes GROUP BY relid) i ON t.relid = i.relid"""


@query("hlt2_table_sizes", f"""
    WITH s AS ({TABLE_SIZES}), d AS (SELECT *, total_bytes - index_bytes - coalesce(toast_bytes, 0) AS table_bytes FROM s)
    SELECT relid, schemaname, relname, total_bytes, index_bytes, toast_bytes, table_bytes, {size_sql('total_bytes')} AS total_size,
           {size_sql('index_bytes')} AS index_size, {size_sql('toast_bytes')} AS toast_size, {size_sql('table_bytes')} AS table_size
    FROM d ORDER BY total_bytes DESC, schemaname, relname, relid LIMIT 30""")
def _(t):
    return H.table_sizes(t.sql(TABLE_SIZES), "total", schema="schemaname", top=30, keys=["relid"])


ALL_SIZES = f"""
    WITH s AS ({TABLE_SIZES}), d AS (SELECT *, total_bytes - index_bytes - coalesce(toast_bytes, 0) AS table_bytes FROM s)
    SELECT relid, schemaname, relname, total_bytes, index_bytes, toast_bytes, table_bytes, {size_sql('total_bytes')} AS total_size,
           {size_sql('index_bytes')} AS index_size, {size_sql('toast_bytes')} AS toast_size, {size_sql('table_bytes')} AS table_size FROM d"""


@query("hlt2_all_table_sizes", ALL_SIZES)
def _(t):
    return H.table_sizes(t.sql(TABLE_SIZES), schema="schemaname", keys=["relid"])


@query("hlt2_toast_sizes", ALL_SIZES + " ORDER BY toast_bytes DESC NULLS LAST, schemaname, relname, relid LIMIT 25")
def _(t):
    return H.table_sizes(t.sql(TABLE_SIZES), "toast", schema="schemaname", top=25, keys=["relid"])


@query("hlt2_index_sizes", ALL_SIZES + " ORDER BY index_bytes DESC NULLS LAST, schemaname, relname, relid LIMIT 25")
def _(t):
    return H.table_sizes(t.sql(TABLE_SIZES), "index", schema="schemaname", top=25, keys=["relid"])


@query("hlt3_index_ratio", f"""
    SELECT i.relid, i.indexrelname, floor(100.0::DOUBLE * i.index_bytes / t.table_bytes) / 100.0::DOUBLE AS index_ratio, i.index_bytes,
           {size_sql('i.index_bytes')} AS index_size, {size_sql('t.table_bytes')} AS table_size
    FROM v_indexes i JOIN v_tables t ON i.relid = t.relid WHERE t.table_bytes > 0 ORDER BY i.index_bytes DESC, i.indexrelname, i.relid LIMIT 60""")
def _(t):
    return H.index_ratio(t.v_indexes, t.v_tables, top=60)


@query("hlt3_all_index_ratio", f"""
    SELECT i.relid, i.indexrelname, floor(100.0::DOUBLE * i.index_bytes / t.table_bytes) / 100.0::DOUBLE AS index_ratio, i.index_bytes,
           {size_sql('i.index_bytes')} AS index_size, {size_sql('t.table_bytes')} AS table_size
    FROM v_indexes i JOIN v_tables t ON i.relid = t.relid WHERE t.table_bytes > 0""")
def _(t):
    return H.index_ratio(t.v_indexes, t.v_tables)


STATS = """SELECT lang AS schemaname, source AS tablename, 'text' AS attname, CAST(0.0 AS DOUBLE) AS null_frac, CAST(floor(avg(n_chars)) AS INT) AS avg_width FROM documents GROUP BY lang, source
    UNION ALL SELECT lang, source, 'quality', 1.0 - round(CAST(count(quality) AS DOUBLE) / count(*), 4), 4 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang, source
    UNION ALL SELECT lang, source, 'toxic', 1.0 - round(CAST(count(toxic) AS DOUBLE) / count(*), 4), 1 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang, source"""
RELS = "SELECT lang AS schemaname, source AS tablename, count(*) AS reltuples, CAST(floor(sum(n_chars) / 8192.0) + 1 AS BIGINT) AS relpages FROM documents GROUP BY lang, source"
IDX = "SELECT lang AS schemaname, source AS tablename, 'doc_idx' AS iname, count(*) AS ituples, CAST(floor(count(*) / 10.0) AS BIGINT) AS ipages FROM documents GROUP BY lang, source"


@query("hlt4_bloat", f"""
    WITH st AS ({STATS}), re AS ({RELS}), ix AS ({IDX}),
    w AS (SELECT schemaname, tablename, sum((1.0::DOUBLE - null_frac) * avg_width ORDER BY attname) + 24 AS datahdr, max(null_frac) AS mf,
                 24 + count(*) FILTER (WHERE null_frac <> 0) // 8 AS nh FROM st GROUP BY ALL),
    x AS (SELECT schemaname, tablename, datahdr, mf * (nh + 4 - CASE WHEN nh % 4 = 0 THEN 4 ELSE nh % 4 END) AS nullhdr2,
                 datahdr + 4 - CASE WHEN datahdr % 4 = 0 THEN 4 ELSE datahdr % 4 END AS pad FROM w),
    tb AS (SELECT 'table' AS type, schemaname, tablename AS object_name, relpages AS p, ceil(reltuples * (pad + nullhdr2 + 4) / 8172.0::DOUBLE) AS want FROM re JOIN x USING (schemaname, tablename)),
    ib AS (SELECT 'index', schemaname, concat(tablename, '::', iname), ipages, ceil(ituples * (datahdr - 12) / 8172.0::DOUBLE) FROM ix JOIN x USING (schemaname, tablename)),
    u AS (SELECT type, schemaname, object_name, CASE WHEN want = 0 OR (type = 'index' AND p = 0) THEN 0.0 ELSE round(p / want, 1) END AS bloat,
                 CAST(CASE WHEN p < want THEN 0 ELSE 8192 * (p - want) END AS BIGINT) AS raw_waste FROM (SELECT * FROM tb UNION ALL SELECT * FROM ib))
    SELECT type, schemaname, object_name, CAST(bloat AS DOUBLE) AS bloat, raw_waste, {size_sql('raw_waste')} AS waste FROM u""")
def _(t):
    return H.bloat(t.sql(STATS), t.sql(RELS), t.sql(IDX))


@query("hlt5_dead_rows", """
    SELECT schemaname, relname, n_live_tup, n_dead_tup, (n_dead_tup * 100) // n_live_tup AS pct,
           concat('VACUUM (VERBOSE,ANALYZE) ', schemaname, '.', relname, ';') AS vacuum
    FROM v_tables WHERE n_live_tup > 0 ORDER BY n_dead_tup DESC, schemaname, relname LIMIT 30""")
def _(t):
    return H.dead_rows(t.v_tables, top=30)


@query("hlt5_all_dead_rows", """
    SELECT schemaname, relname, n_live_tup, n_dead_tup, (n_dead_tup * 100) // n_live_tup AS pct,
           concat('VACUUM (VERBOSE,ANALYZE) ', schemaname, '.', relname, ';') AS vacuum FROM v_tables WHERE n_live_tup > 0""")
def _(t):
    return H.dead_rows(t.v_tables)


DUE = """SELECT schemaname, relname, {1}, n_live_tup, n_dead_tup,
    round(CAST(coalesce(nullif(regexp_extract(reloptions, 'autovacuum_{0}_threshold=([0-9.]+)', 1), ''), '{2}') AS DOUBLE)
        + CAST(coalesce(nullif(regexp_extract(reloptions, 'autovacuum_{0}_scale_factor=([0-9.]+)', 1), ''), '{3}') AS DOUBLE) * n_live_tup, 4) AS threshold,
    CASE WHEN CAST(coalesce(nullif(regexp_extract(reloptions, 'autovacuum_{0}_threshold=([0-9.]+)', 1), ''), '{2}') AS DOUBLE)
        + CAST(coalesce(nullif(regexp_extract(reloptions, 'autovacuum_{0}_scale_factor=([0-9.]+)', 1), ''), '{3}') AS DOUBLE) * n_live_tup < n_dead_tup THEN 'yes' END AS due,
    round(CAST(n_live_tup AS DOUBLE) / nullif(relpages, 0), 2) AS rows_per_page
    FROM (SELECT *, table_bytes // 8192 AS relpages, strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (relid % 1000) HOUR, '%Y-%m-%d %H:%M') AS seen,
                 regexp_replace(reloptions, 'vacuum_', '{0}_', 'g') AS own FROM v_tables)"""


def upkeep(t, kind: str):
    """The tables with pages and the times of their last upkeep; the options name the kind."""
    last = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(relid % 1000 AS INT))")
    return t.v_tables.withColumns({"relpages": F.floor(F.col("table_bytes") / 8192).cast("bigint"), f"last_{kind}": last, f"last_auto{kind}": F.lit(None).cast("timestamp_ntz")})


def shown_upkeep(df, kind: str):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in (f"last_{kind}", f"last_auto{kind}")})


VACUUM_DUE = DUE.format("vacuum", "seen AS last_vacuum, CAST(NULL AS VARCHAR) AS last_autovacuum", "4", "0.2")
ANALYZE_DUE = DUE.format("analyze", "seen AS last_analyze, CAST(NULL AS VARCHAR) AS last_autoanalyze", "2", "0.3").replace("(reloptions, 'autovacuum_analyze", "(replace(reloptions, 'autovacuum_vacuum', 'autovacuum_analyze'), 'autovacuum_analyze")


@query("hlt6_vacuum_due", VACUUM_DUE)
def _(t):
    return shown_upkeep(H.maintenance_due(upkeep(t, "vacuum"), "vacuum", 4, 0.2), "vacuum")


@query("hlt6_analyze_due", ANALYZE_DUE)
def _(t):
    # The server's settings as a frame, and every fifth table with options of its own.
    settings = t.spark.sql("SELECT 2 AS autovacuum_analyze_threshold, 0.3D AS autovacuum_analyze_scale_factor")
    tables = upkeep(t, "analyze").withColumn("reloptions", F.replace("reloptions", F.lit("autovacuum_vacuum"), F.lit("autovacuum_analyze")))
    return shown_upkeep(H.maintenance_due(tables, "analyze", settings=settings), "analyze")


@query("hlt7_vacuum_progress", """
    WITH p AS (SELECT relid AS pid, seq_scan AS heap_blks_total, 100 * n_dead_tup AS heap_blks_scanned FROM v_tables),
    q AS (SELECT *, heap_blks_scanned * 100.0::DOUBLE / nullif(heap_blks_total, 0) AS x FROM p)
    SELECT q.pid, a.usename, heap_blks_total, heap_blks_scanned, round(x, 2) AS pct,
           CAST(CASE WHEN x < 25 THEN 4.0 WHEN x < 50 THEN 3.0 WHEN x < 75 THEN 2.0 WHEN x >= 75 THEN 1.05 END AS DOUBLE) AS wait_factor
    FROM q JOIN v_activity a ON a.pid = q.pid""")
def _(t):
    progress = t.v_tables.select(F.col("relid").alias("pid"), F.col("seq_scan").alias("heap_blks_total"), (F.col("n_dead_tup") * 100).alias("heap_blks_scanned"))
    return H.vacuum_progress(progress, t.v_activity.select("pid", "usename"), keep=["usename"])


@query("hlt8_positive_gap", """
    SELECT schemaname, relname, seq_scan - idx_scan AS too_much_seq, CASE WHEN seq_scan - coalesce(idx_scan, 0) > 0 THEN 'Missing Index ?' ELSE 'OK' END AS verdict,
           table_bytes AS rel_size, seq_scan, idx_scan
    FROM v_tables WHERE table_bytes > 80000 AND idx_scan > 0 ORDER BY too_much_seq DESC, verdict, schemaname, relname LIMIT 15""")
def _(t):
    return H.missing_index(t.v_tables, "positive_gap", top=15)


@query("hlt8_one_schema", """
    SELECT schemaname, relname, seq_scan - idx_scan AS too_much_seq, CASE WHEN seq_scan - coalesce(idx_scan, 0) > 0 THEN 'Missing Index ?' ELSE 'OK' END AS verdict,
           table_bytes AS rel_size, seq_scan, idx_scan
    FROM v_tables WHERE table_bytes > 80000 AND idx_scan > 0 AND schemaname = 'Brand#1'""")
def _(t):
    return H.missing_index(t.v_tables, "positive_gap", only_schema="Brand#1")


@query("hlt8_scan_gap", """
    SELECT schemaname, relname, concat(schemaname, '.', relname) AS table_in_trouble, table_bytes AS size_bytes, seq_scan, idx_scan,
           CASE WHEN seq_scan - idx_scan < 500 THEN 'Minor Problem' WHEN seq_scan - idx_scan < 2500 THEN 'Major Problem' ELSE 'Extreme Problem' END AS priority
    FROM v_tables WHERE seq_scan > idx_scan AND seq_scan > 100 AND schemaname <> 'pg_catalog'""")
def _(t):
    return H.missing_index(t.v_tables, "scan_gap")


@query("hlt8_two_percent", f"""
    SELECT schemaname, relname, lpad(format('{{:,}}', seq_scan), 16, ' ') AS total_seqscan, lpad(format('{{:,}}', idx_scan), 16, ' ') AS total_indexscan,
           lpad(format('{{:,}}', n_live_tup), 16, ' ') AS table_rows, {size_sql('table_bytes')} AS table_size, seq_scan
    FROM v_tables WHERE 50 * seq_scan > coalesce(idx_scan, 0) AND n_live_tup > 20 AND table_bytes > 1000000""")
def _(t):
    return H.missing_index(t.v_tables, "two_percent", min_rows=20)


@query("hlt8_scan_ratio", f"""
    SELECT schemaname, relname, seq_scan, CASE WHEN ((seq_scan + 1) * 100) // (idx_scan + 1) > 0.10 THEN 'Missing Index Found' ELSE 'Missing Index Not Found' END AS missing_index,
           {size_sql('table_bytes')} AS table_size, idx_scan
    FROM v_tables WHERE table_bytes > 8000000 AND seq_scan > 500""")
def _(t):
    return H.missing_index(t.v_tables, "scan_ratio", min_size=8000000)


@query("hlt9_unused_traffic", f"""
    SELECT i.relid, i.indexrelname, i.idx_scan AS index_scans, i.index_bytes, t.seq_scan, t.idx_scan AS table_idx_scan, t.seq_scan + t.idx_scan AS table_reads_count,
           n_live_tup + n_dead_tup AS table_writes_count, t.table_bytes, {size_sql('i.index_bytes')} AS index_size, {size_sql('t.table_bytes')} AS table_size
    FROM v_indexes i JOIN v_tables t ON i.relid = t.relid WHERE NOT i.is_unique""")
def _(t):
    tables = t.v_tables.withColumnRenamed("idx_scan", "table_idx_scan")
    return H.unused_indexes(t.v_indexes, tables, "traffic", writes=("n_live_tup", "n_dead_tup"))


@query("hlt9_unused_few_scans", f"""
    SELECT i.relid, i.indexrelname, i.idx_scan AS index_scans, i.index_bytes, i.index_bytes // nullif(i.idx_scan, 0) AS bytes_per_scan, {size_sql('i.index_bytes')} AS index_size
    FROM v_indexes i JOIN v_tables t ON i.relid = t.relid WHERE NOT i.is_unique AND i.idx_scan < 3 AND t.table_bytes > 40960
""")
def _(t):
    return H.unused_indexes(t.v_indexes, t.v_tables, "few_scans", max_scans=3)


@query("hlt10_index_usage", f"""
    SELECT t.relid, t.relname, i.indexrelname AS index_name, t.n_live_tup AS num_rows, {size_sql('t.table_bytes')} AS table_size, {size_sql('i.index_bytes')} AS index_size,
           CASE WHEN i.is_unique THEN 'Y' ELSE 'N' END AS "unique", i.idx_scan AS number_of_scans
    FROM v_tables t LEFT JOIN v_indexes i ON t.relid = i.relid ORDER BY t.n_live_tup DESC, t.relname, t.relid, i.indexrelname LIMIT 50""")
def _(t):
    return H.index_usage(t.v_tables.drop("idx_scan"), t.v_indexes, top=50)


@query("hlt10_all_index_usage", f"""
    SELECT t.relid, t.relname, i.indexrelname AS index_name, t.n_live_tup AS num_rows, {size_sql('t.table_bytes')} AS table_size, {size_sql('i.index_bytes')} AS index_size,
           CASE WHEN i.is_unique THEN 'Y' ELSE 'N' END AS "unique", i.idx_scan AS number_of_scans
    FROM v_tables t LEFT JOIN v_indexes i ON t.relid = i.relid""")
def _(t):
    return H.index_usage(t.v_tables.drop("idx_scan"), t.v_indexes)


@query("hlt10_index_hit_rate", """
    SELECT relid, relname, CASE WHEN idx_scan = 0 THEN NULL ELSE round(100.0::DOUBLE * idx_scan / (seq_scan + idx_scan), 5) END AS percent_of_times_index_used,
           n_live_tup AS rows_in_table FROM v_tables""")
def _(t):
    return H.index_hit_rate(t.v_tables, keys=["relid"])


@query("hlt11_invalid_indexes", "SELECT relid, indexrelname FROM v_indexes WHERE NOT is_valid")
def _(t):
    return H.invalid_indexes(t.v_indexes)


STATEMENTS = """SELECT p_name AS query, p_partkey AS userid, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total_time,
    count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_rows, CAST(sum(l_linenumber) AS BIGINT) AS hits, CAST(sum(l_suppkey) AS BIGINT) AS disk
    FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_name"""


@query("hlt12_statement_costs", f"""
    WITH s AS ({STATEMENTS})
    SELECT userid, left(query, 100) AS query, CAST(total_time AS DOUBLE) AS total_time, calls, n_rows AS rows, round(CAST(total_time AS DOUBLE) / calls, 2) AS avg_time,
           round(CAST(total_time AS DOUBLE) * 100 / CAST((SELECT sum(total_time) FROM s) AS DOUBLE), 2) AS percentage_cpu,
           round(100.0::DOUBLE * hits / (hits + disk), 2) AS hit_percent
    FROM s ORDER BY s.total_time DESC, s.query, userid LIMIT 20""")
def _(t):
    out = H.statement_costs(t.sql(STATEMENTS), 20, rows="n_rows", hit="hits", read="disk", n=100, keys=["userid"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("total_time", "avg_time", "percentage_cpu")})


@query("hlt12_all_statement_costs", f"""
    WITH s AS ({STATEMENTS})
    SELECT userid, query, CAST(total_time AS DOUBLE) AS total_time, calls, n_rows AS rows,
           CAST((2 * CAST(total_time * 100 AS HUGEINT) + calls) // (2 * calls) AS DOUBLE) / 100.0::DOUBLE AS avg_time,
           round(CAST(total_time AS DOUBLE) * 100 / CAST((SELECT sum(total_time) FROM s) AS DOUBLE), 2) AS percentage_cpu,
           round(100.0::DOUBLE * hits / (hits + disk), 2) AS hit_percent FROM s""")
def _(t):
    out = H.statement_costs(t.sql(STATEMENTS), rows="n_rows", hit="hits", read="disk", keys=["userid"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("total_time", "avg_time", "percentage_cpu")})


@query("hlt12_costs_by_call", f"""
    SELECT userid, left(query, 50) AS query, calls, round(CAST(total_time AS DOUBLE) / calls, 2) AS avg_time_ms, n_rows // calls AS avg_rows,
           hits // calls AS avg_tmp_read, disk // calls AS avg_temp_written
    FROM ({STATEMENTS}) s WHERE calls <> 0 ORDER BY total_time DESC, s.query, userid LIMIT 10""")
def _(t):
    out = H.costs_by_call(t.sql(STATEMENTS), 10, n=50, rows="n_rows", temp_read="hits", temp_written="disk", keys=["userid"])
    return out.withColumn("avg_time_ms", F.col("avg_time_ms").cast("double"))


LAG = f"CAST({lsn_sql('current_lsn')} - {lsn_sql('restart_lsn')} AS BIGINT)"


@query("hlt13_slot_lag", f"""
    WITH l AS (SELECT slot_name, active, {LAG} AS lag_bytes FROM v_slots WHERE plugin = 'pgoutput')
    SELECT slot_name, active, lag_bytes, {size_sql('lag_bytes')} AS lag FROM l""")
def _(t):
    return H.slot_lag(t.v_slots, ["pgoutput"]).withColumn("lag_bytes", F.col("lag_bytes").cast("bigint"))


@query("hlt13_standby_lag", f"""
    SELECT slot_name, {LAG} AS write_lag, {LAG} + 2000000 AS flush_lag, {LAG} AS replay_lag, {LAG} AS total_lag FROM v_slots""")
def _(t):
    s = t.v_slots.withColumn("flush", F.concat(F.lit("19/"), F.hex(F.conv(F.split("restart_lsn", "/")[1], 16, 10).cast("bigint") - 2000000)))
    out = H.standby_lag(s, "current_lsn", "restart_lsn", "flush", "restart_lsn", ["slot_name"])
    return out.select("slot_name", *[F.col(c).cast("bigint").alias(c) for c in ("write_lag", "flush_lag", "replay_lag", "total_lag")])


@query("hlt14_catch_up", """
    WITH d AS (SELECT user_id, ts, event_id, CAST(floor(value * 7) AS BIGINT) AS distance FROM events),
    l AS (SELECT *, lag(distance) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM d)
    SELECT user_id, epoch_us(ts) AS at_us, distance, CASE WHEN distance <= 100 THEN 'in sync' ELSE 'catching up' END AS status,
           CASE WHEN distance > 100 THEN CASE WHEN b IS NULL OR b = distance THEN 9999 ELSE CAST(round_even(CAST(b AS DOUBLE) / (b - distance), 0) AS BIGINT) END END AS eta FROM l""")
def _(t):
    far = (F.floor(F.col("value") * 7) + F.col("event_id") * 16).cast("bigint")
    readings = t.events.select("user_id", "ts", F.concat(F.lit("2/"), F.hex(far)).alias("current_lsn"),
                               F.concat(F.lit("2/"), F.hex(F.col("event_id") * 16)).alias("confirmed_flush_lsn"))
    out = H.catch_up(readings, ["user_id"], "ts", unit="week")
    return out.select("user_id", epoch_micros("ts").alias("at_us"), "distance", "status", "eta")


@query("hlt15_txid_age", "SELECT seqname, abs(last_value) AS frozen_age FROM v_sequences ORDER BY frozen_age DESC, seqname LIMIT 20")
def _(t):
    return H.txid_age(t.v_sequences.select("seqname", F.abs("last_value").alias("frozen_age")), keep=["seqname"], top=20)


@query("hlt15_all_txid_age", "SELECT seqname, abs(last_value) AS frozen_age FROM v_sequences")
def _(t):
    return H.txid_age(t.v_sequences.select("seqname", F.abs("last_value").alias("frozen_age")), keep=["seqname"])


@query("hlt15_txid_limit", """
    SELECT seqname AS instance, abs(last_value) AS used, CAST(CASE WHEN data_type = 'integer' THEN 400000000 ELSE 200000000 END AS BIGINT) AS "limit" FROM v_sequences
    WHERE CASE WHEN data_type = 'integer' THEN 400000000 ELSE 200000000 END <= abs(last_value) * 1.05""")
def _(t):
    used = t.v_sequences.select(F.col("seqname").alias("instance"), F.abs("last_value").alias("value"))
    settings = t.v_sequences.filter("data_type = 'integer'").select(F.col("seqname").alias("instance"), F.lit(400000000).alias("freeze_max_age"))
    return H.txid_limit(used, settings)


LEFT_SQL = """SELECT seqname, data_type, last_value, increment_by, CASE WHEN last_value < 0 AND increment_by < 0 THEN m + last_value WHEN last_value < 0 AND increment_by > 0 THEN -last_value
    WHEN last_value > 0 AND increment_by < 0 THEN last_value WHEN last_value > 0 AND increment_by > 0 THEN m - last_value END AS ids_left
    FROM (SELECT *, CAST(CASE data_type WHEN 'integer' THEN 2147483647 ELSE 9223372036854775807 END AS HUGEINT) AS m FROM v_sequences)"""


@query("hlt16_int_exhaustion", f"""
    SELECT seqname, data_type, last_value, increment_by, CAST(ids_left AS BIGINT) AS ids_left, CASE WHEN ids_left <= 0 THEN 'exhausted' ELSE 'reaching limit' END AS status
    FROM ({LEFT_SQL}) WHERE ids_left < 300000000""")
def _(t):
    return H.int_exhaustion(t.v_sequences).withColumn("ids_left", F.col("ids_left").cast("bigint"))


@query("hlt16_int_suggestion", f"""
    SELECT seqname, data_type, last_value, increment_by, CAST(ids_left AS BIGINT) AS ids_left, CASE WHEN ids_left <= 0 THEN 'exhausted' ELSE 'reaching limit' END AS status
    FROM ({LEFT_SQL}) WHERE ids_left < 1000000000""")
def _(t):
    return H.int_exhaustion(t.v_sequences, 1000000000).withColumn("ids_left", F.col("ids_left").cast("bigint"))


@query("hlt17_retention_audit", """
    SELECT identifier, engine, retention_days, CAST(CASE engine WHEN 'docdb' THEN 1 ELSE 6 END AS BIGINT) AS required_days FROM v_instances
    WHERE retention_days < CASE engine WHEN 'docdb' THEN 1 ELSE 6 END AND CASE WHEN engine IN ('docdb', 'aurora-mysql') THEN is_writer ELSE true END""")
def _(t):
    primary = X.is_primary("engine", "is_writer", F.lit(None).cast("string"))
    return H.retention_audit(t.v_instances, engine="engine", days="retention_days", keep=["identifier"], primary=primary)


@query("hlt18_class_drift", """
    WITH d AS (SELECT identifier, CASE WHEN retention_days % 3 = 0 THEN instance_class ELSE 'db.r5.large' END AS desired_class, instance_class,
                      CASE WHEN retention_days % 2 = 0 THEN 'available' ELSE 'modifying' END AS status FROM v_instances)
    SELECT *, CASE WHEN desired_class = instance_class AND status = 'available' THEN 'done'
                   WHEN desired_class <> instance_class AND status = 'modifying' THEN 'modifying' ELSE 'drifted' END AS result FROM d""")
def _(t):
    i = t.v_instances
    desired = i.select("identifier", F.when(F.col("retention_days") % 3 == 0, F.col("instance_class")).otherwise(F.lit("db.r5.large")).alias("desired_class"))
    actual = i.select("identifier", "instance_class", F.when(F.col("retention_days") % 2 == 0, F.lit("available")).otherwise(F.lit("modifying")).alias("status"))
    return H.class_drift(desired, actual)


@query("hlt19_connections", "SELECT opid, secs_running AS current, 500 - secs_running AS available, secs_running % 7 AS open_cursors FROM v_ops")
def _(t):
    status = t.v_ops.select("opid", F.struct(F.col("secs_running").alias("current"), (F.lit(500) - F.col("secs_running")).alias("available")).alias("connections"),
                            F.struct((F.col("secs_running") % 7).alias("open")).alias("cursor"))
    return H.connections(status, cursors="cursor.open", keys=["opid"])


@query("hlt20_unexpected_sessions", """
    SELECT pid, usename FROM v_activity WHERE NOT regexp_full_match(usename, 'role1.*|role.5|role[0-4]')""")
def _(t):
    return filters.unexpected_sessions(t.v_activity, pattern="role1%|role_5|role[0-4]").select("pid", "usename")


@query("hlt21_instances", "SELECT identifier, instance_class, retention_days * 100 AS storage, engine FROM v_instances WHERE engine = 'mysql'")
def _(t):
    return H.instances(t.v_instances, "identifier", "instance_class", F.col("retention_days") * 100, "engine", "mysql")


@query("hlt22_collection_stats", """
    SELECT source AS name, count(*) AS collections, concat(printf('%.2f', round(CAST(sum(n_chars) AS DOUBLE) / 1024.0, 2)), 'KB') AS "dataSize",
           concat(CAST(CAST(round(avg(n_chars), 0) AS BIGINT) AS STRING), 'B') AS "avgObjSize" FROM documents GROUP BY source""")
def _(t):
    stats = t.documents.groupBy(F.col("source").alias("name")).agg(
        F.count(F.lit(1)).alias("collections"), F.sum("n_chars").alias("dataSize"), F.avg("n_chars").alias("avgObjSize"))
    return H.collection_stats(stats, counts=["collections"], sizes=["dataSize"], unit="k")


@query("hlt23_non_admin_databases", """
    SELECT instance, datname FROM v_databases WHERE datname NOT IN ('postgres', 'template0', 'template1', 'rdsadmin') AND datname NOT ILIKE '%delete_me%'""")
def _(t):
    return H.non_admin_databases(t.v_databases).select("instance", "datname")


@query("hlt23_doomed_databases", "SELECT instance, datname FROM v_databases WHERE datname ILIKE '%delete_me%'")
def _(t):
    return H.non_admin_databases(t.v_databases, doomed=True).select("instance", "datname")


@query("hlt24_subscription_status", """
    WITH tb AS (SELECT l_suppkey AS subid, f AS relname, row_number() OVER (PARTITION BY l_suppkey ORDER BY f) AS place
                FROM (SELECT DISTINCT l_suppkey, concat('t', CAST(l_linenumber AS STRING)) AS f FROM lineitem))
    SELECT s_suppkey AS subid, s_name AS subname, CASE WHEN s_nationkey % 2 = 0 THEN 'replicating' ELSE 'disabled' END AS state, concat('slot_', s_name) AS subslotname,
           concat('0/', hex(s_suppkey * 1000)) AS received_lsn, relname, place
    FROM supplier JOIN tb ON subid = s_suppkey""")
def _(t):
    subs = t.supplier.select(F.col("s_suppkey").alias("subid"), F.col("s_name").alias("subname"), (F.col("s_nationkey") % 2 == 0).alias("subenabled"),
                             F.concat(F.lit("slot_"), F.col("s_name")).alias("subslotname"))
    stats = t.supplier.select(F.col("s_suppkey").alias("subid"), F.concat(F.lit("0/"), F.hex(F.col("s_suppkey") * 1000)).alias("received_lsn"))
    tables = t.lineitem.select(F.col("l_suppkey").alias("subid"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("relname"))
    return H.subscription_status(subs, stats, tables=tables)


CANDIDATES = """SELECT instance, datname, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY size_bytes DESC, datname) AS r FROM v_databases
    WHERE datname NOT IN ('rdsadmin', 'template1', 'template0', 'postgres') AND datallowconn AND NOT datistemplate
    AND NOT regexp_full_match(owner, 'dba_.*|.*delete_me') AND size_bytes > 1000000) WHERE r <= 2"""


ALL_CANDIDATES = CANDIDATES.replace("WHERE r <= 2", "")


@query("src3_all_databases", ALL_CANDIDATES)
def _(t):
    return candidate_databases(t.v_databases, min_bytes=1000000).select("instance", "datname", "size_bytes")


@query("src3_candidate_databases", CANDIDATES)
def _(t):
    return candidate_databases(t.v_databases, min_bytes=1000000, cap=2).select("instance", "datname", "size_bytes")


FAN_OUT = """
    WITH d AS ({candidates}), p AS (SELECT instance FROM d WHERE instance <> 'inst4'),
    a AS (SELECT concat('inst', CAST(n_regionkey AS STRING)) AS instance, lower(n_name) AS database, o_orderstatus AS state FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT a.instance, a.database, count(*) FILTER (WHERE state = 'F') AS finished, count(*) AS total, concat(a.instance, '.db') AS endpoint
    FROM a WHERE EXISTS (SELECT 1 FROM d WHERE d.instance = a.instance AND d.datname = a.database) AND instance IN (SELECT instance FROM p) GROUP BY a.instance, a.database"""


@query("src2_fan_out", FAN_OUT.format(candidates=CANDIDATES))
def _(t):
    return audited(t, 2)


@query("src2_fan_out_all", FAN_OUT.format(candidates=ALL_CANDIDATES))
def _(t):
    return audited(t, None)


def audited(t, cap):
    wanted = candidate_databases(t.v_databases, min_bytes=1000000, cap=cap).select("instance", F.col("datname").alias("database"))
    instances = t.v_databases.select("instance", F.concat("instance", F.lit(".db")).alias("endpoint")).distinct()
    snapshots = t.sql("""SELECT concat('inst', CAST(n_regionkey AS STRING)) AS instance, lower(n_name) AS database, o_orderstatus AS state
                         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")

    def rollup(df):
        return activity_rollup(df, ["instance", "database"], states={"finished": "F"}, role=None)

    return fan_out(rollup, snapshots, wanted, instances, F.col("instance") != "inst4", endpoint="endpoint")


@query("snk1_findings", f"""
    SELECT 'int-limit' AS check_id, seqname AS object, CASE WHEN ids_left <= 0 THEN 'critical' ELSE 'warning' END AS severity, concat(seqname, ' has ', CAST(ids_left AS STRING), ' ids left') AS message,
           CAST(ids_left AS STRING) AS ids_left, '{AS_OF}' AS as_of, concat('int\\-limit-', seqname) AS alias
    FROM ({LEFT_SQL}) WHERE ids_left < 1000000000""")
def _(t):
    seqs = H.int_exhaustion(t.v_sequences, 1000000000)
    level = F.when(F.col("status") == "exhausted", F.lit("critical")).otherwise(F.lit("warning"))
    message = F.concat(F.col("seqname"), F.lit(" has "), F.col("ids_left").cast("string"), F.lit(" ids left"))
    out = findings(seqs, "int-limit", "seqname", AS_OF, [], level, message, ["ids_left"])
    return out.select("check_id", "object", "severity", "message", F.col("details")["ids_left"].alias("ids_left"),
                      F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"), "alias")


@query("snk2_render_rows", """
    SELECT true AS is_header, 'pid,datname,usename,state,wait_event_type' AS line
    UNION ALL SELECT false, concat_ws(',', CAST(pid AS STRING), datname, usename, state, coalesce(wait_event_type, '')) FROM v_activity""")
def _(t):
    return render_rows(t.v_activity.select("pid", "datname", "usename", "state", "wait_event_type"))
