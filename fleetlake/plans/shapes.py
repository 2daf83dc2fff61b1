"""Catalog-shaped views of the test tables, in SQL both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
AS_OF = "2024-01-31 00:00:00"
#: Shapes with about as many groups as their table has rows: the table's rows are dealt by this column, so many to a task.
DEALT = {"v_indexes": ("lineitem", "l_partkey")}
DEALT_ROWS = 1 << 18

SHAPES = {
    "v_activity": """
        SELECT event_id AS pid, concat('db', CAST(user_id % 8 AS STRING)) AS datname,
               concat('role', CAST(user_id % 20 AS STRING)) AS usename,
               concat('10.0.0.', CAST(user_id AS STRING)) AS client_addr,
               CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'idle' WHEN 'purchase' THEN 'idle in transaction'
                               WHEN 'error' THEN 'idle in transaction (aborted)' ELSE 'active' END AS state,
               CASE WHEN event_type = 'error' THEN 'Lock' END AS wait_event_type, ts AS query_start, props AS query
        FROM events""",
    "v_tables": """
        SELECT p_brand AS schemaname, p_partkey AS relid, concat('t', CAST(p_partkey AS STRING)) AS relname,
               CAST(sum(CASE WHEN l_quantity < 30 THEN 100 ELSE 0 END) AS BIGINT) AS seq_scan,
               nullif(CAST(sum(CASE WHEN l_quantity >= 30 THEN 60 ELSE 0 END) AS BIGINT), 0) AS idx_scan,
               CAST(count(l_orderkey) AS BIGINT) AS n_live_tup,
               CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_dead_tup,
               CAST(floor(p_retailprice * 8192) AS BIGINT) AS table_bytes,
               CASE WHEN p_size % 5 = 0 THEN 'autovacuum_vacuum_threshold=3,autovacuum_vacuum_scale_factor=0.1' END AS reloptions
        FROM part LEFT JOIN lineitem ON p_partkey = l_partkey
        GROUP BY p_brand, p_partkey, p_retailprice, p_size""",
    "v_indexes": """
        SELECT l_partkey AS relid, concat('i', CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING)) AS indexrelname,
               CAST(count(*) - 1 AS BIGINT) AS idx_scan,
               CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)))) AS BIGINT) AS index_bytes,
               l_suppkey % 5 = 0 AS is_unique, l_suppkey % 11 <> 0 AS is_valid,
               CAST(1 + l_suppkey % 3 AS BIGINT) AS n_columns,
               concat(CAST(l_partkey AS STRING), '/', CAST(l_suppkey % 7 AS STRING)) AS signature
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "v_sequences": """
        SELECT s_name AS seqname, CASE WHEN s_suppkey % 2 = 0 THEN 'integer' ELSE 'bigint' END AS data_type,
               CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE 1 END * (CAST(s_suppkey AS BIGINT) * 21000000 + 1000) AS last_value,
               CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE 1 END AS increment_by
        FROM supplier""",
    "v_slots": """
        SELECT concat('slot_', CAST(c_custkey AS STRING)) AS slot_name,
               CASE WHEN c_custkey % 2 = 0 THEN 'pgoutput' ELSE 'wal2json' END AS plugin,
               concat('1A/', hex(CAST(c_custkey AS BIGINT) * 4096 + 4000000)) AS current_lsn,
               concat('19/', hex(CAST(c_custkey AS BIGINT) * 1024 + 3000000)) AS restart_lsn, c_custkey % 3 <> 0 AS active
        FROM customer""",
    "v_metrics": """
        SELECT concat('inst', CAST(user_id % 4 AS STRING)) AS instance,
               CASE event_type WHEN 'click' THEN 'CPUUtilization' WHEN 'view' THEN 'DiskQueueDepth'
                               WHEN 'error' THEN 'OldestReplicationSlotLag' WHEN 'signup' THEN 'BurstBalance'
                               ELSE 'ReadLatency' END AS metric,
               date_trunc('day', ts) AS ts, max(value) AS value
        FROM events GROUP BY 1, 2, 3""",
    "v_changes": """
        SELECT concat('db', CAST(user_id % 8 AS STRING)) AS database, event_id AS seq, ts,
               CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS kind,
               'public' AS schema_name, concat('t', CAST(user_id % 3 AS STRING)) AS table_name, user_id AS key,
               event_type <> 'error' AS has_label, event_type AS label,
               event_type IN ('signup', 'purchase') AS has_amount, value AS amount
        FROM events""",
    "v_ops": """
        SELECT event_id AS opid, CAST(floor(value / 10) AS BIGINT) AS secs_running,
               CASE WHEN event_type = 'error' THEN 'CollectionLock' END AS wait_state,
               concat('db', CAST(user_id % 3 AS STRING), '.', event_type) AS ns,
               CASE WHEN user_id % 10 = 0 THEN NULL
                    ELSE concat('10.0.0.', CAST(user_id AS STRING), ':', CAST(event_id % 1000 AS STRING)) END AS client,
               CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'update' ELSE 'query' END AS op
        FROM events""",
    "v_columns": """
        SELECT CASE WHEN p_partkey % 2 = 0 THEN 'source' ELSE 'target' END AS side, p_brand AS table_name,
               concat(p_type, CAST(p_size % 9 AS STRING)) AS column_name,
               CASE WHEN max(p_size) > 45 THEN 'bigint' ELSE 'integer' END AS data_type
        FROM part GROUP BY 1, 2, 3""",
    "v_instances": """
        SELECT concat(replace(s_name, '#', ''), '-us-east-1-acct', CAST(s_nationkey AS STRING)) AS identifier,
               concat('cluster', CAST(s_nationkey AS STRING)) AS cluster,
               CASE s_suppkey % 4 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mysql' WHEN 2 THEN 'docdb' ELSE 'aurora-mysql' END AS engine,
               concat('db.r5.', CASE s_suppkey % 5 WHEN 0 THEN 'large' WHEN 1 THEN 'xlarge' WHEN 2 THEN '2xlarge'
                                                   WHEN 3 THEN '4xlarge' ELSE '8xlarge' END) AS instance_class,
               s_suppkey % 3 = 0 AS is_writer, CAST(s_suppkey % 9 AS BIGINT) AS retention_days
        FROM supplier""",
    "v_databases": """
        SELECT concat('inst', CAST(n_regionkey AS STRING)) AS instance,
               CASE WHEN n_nationkey = 3 THEN 'template1' WHEN n_nationkey = 7 THEN 'nation_7_delete_me' ELSE lower(n_name) END AS datname,
               CASE WHEN n_nationkey % 6 = 5 THEN 'dba_owner' ELSE 'app' END AS owner, n_nationkey % 5 <> 4 AS datallowconn,
               n_nationkey = 3 AS datistemplate, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS size_bytes
        FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
        GROUP BY n_regionkey, n_nationkey, n_name""",
}


class Tables:
    """The parquet tables of a folder, and the shapes over them, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in DEALT:
            table, column = DEALT[name]
            return self.sql(SHAPES[name], **{table: self.dealt(table, column)})
        if name in SHAPES:
            return self.sql(SHAPES[name])
        raise AttributeError(name)

    def dealt(self, table: str, column: str) -> DataFrame:
        """The rows of a table by the hash of a column, in tasks of DEALT_ROWS however large the table is.

        The number of shuffle partitions is fixed and small ones are merged by
        their bytes, so groups that nearly every row has one of would fill a
        task's memory.
        """
        rows = getattr(self, table)
        return rows.repartition(max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // DEALT_ROWS)), column)

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        """Run SQL whose FROM and JOIN items are tables or shapes of this folder, or the frames given in their place."""
        names = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)) & (set(TABLES) | set(SHAPES))
        for name in names:
            text = re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2{{{name}}}", text)
        return self.spark.sql(text, **{n: given[n] if n in given else getattr(self, n) for n in names})


def with_shapes(text: str) -> str:
    """SQL with the shapes it names put in front as common table expressions."""
    body = text.strip()
    used = [n for n in SHAPES if re.search(rf"\b{n}\b", body)]
    if not used:
        return body
    heads = ", ".join(f"{n} AS ({SHAPES[n].strip()})" for n in used)
    lower = body.lower()
    if lower.startswith("with recursive "):
        return f"WITH RECURSIVE {heads}, {body[len('with recursive '):]}"
    if lower.startswith("with "):
        return f"WITH {heads}, {body[len('with '):]}"
    return f"WITH {heads} {body}"
