"""Metric gates and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..functions.times import epoch_seconds
from ..operators.windows import latest
from ..streaming.readings import live_trend
from .registry import query, scratch
from .shapes import AS_OF

LIMITS = {"max_cpu": 250.0, "max_disk_queue": 300.0, "min_burst_balance": 50.0, "max_read_latency": 300.0, "max_write_latency": 0.08, "max_slot_lag_gb": 100.0}
WIDE = """SELECT instance, CAST(floor(epoch(ts)) AS BIGINT) AS day_epoch,
    coalesce(max(value) FILTER (WHERE metric = 'CPUUtilization'), -1) AS cpu, coalesce(max(value) FILTER (WHERE metric = 'DiskQueueDepth'), -1) AS dq,
    coalesce(max(value) FILTER (WHERE metric = 'BurstBalance'), 100) AS bb, coalesce(max(value) FILTER (WHERE metric = 'ReadLatency'), 0) AS rl,
    coalesce(max(value) FILTER (WHERE metric = 'OldestReplicationSlotLag'), 0) AS lag FROM v_metrics GROUP BY ALL"""
OPEN = "cpu < 250 AND dq < 300 AND bb >= 50 AND rl <= 300 AND lag / 1073741824.0 <= 100"


def day(c="ts"):
    return epoch_seconds(c)


@query("stm1_metric_gate", f"SELECT instance, day_epoch, round(cpu, 2) AS cpu, {OPEN} AS gate_open FROM ({WIDE})")
def _(t):
    gated = M.metric_gate(M.wide(t.v_metrics, ["instance", "ts"]), LIMITS)
    return gated.select("instance", day().alias("day_epoch"), F.col("CPUUtilization").alias("cpu"), "gate_open")


SLOPES = """SELECT instance, metric, ts, CASE WHEN metric = 'OldestReplicationSlotLag' THEN value / 1073741824.0 ELSE value END AS v,
    CASE WHEN count(*) OVER w >= 2 THEN regr_slope(CASE WHEN metric = 'OldestReplicationSlotLag' THEN value / 1073741824.0 ELSE value END, (epoch(ts) - 1704067200) / 86400) OVER w END AS s
    FROM v_metrics WINDOW w AS (PARTITION BY instance, metric ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""


@query("stm2_trend_verdict", f"""
    WITH s AS ({SLOPES}),
    w AS (SELECT instance, ts, coalesce(max(s) FILTER (WHERE metric = 'CPUUtilization'), 0) AS cs, coalesce(max(v) FILTER (WHERE metric = 'CPUUtilization'), 0) AS c,
                 coalesce(max(s) FILTER (WHERE metric = 'DiskQueueDepth'), 0) AS ds, coalesce(max(v) FILTER (WHERE metric = 'DiskQueueDepth'), 0) AS d,
                 coalesce(max(s) FILTER (WHERE metric = 'OldestReplicationSlotLag'), 0) AS ls, coalesce(max(v) FILTER (WHERE metric = 'OldestReplicationSlotLag'), 0) AS l
          FROM s WHERE metric IN ('CPUUtilization', 'DiskQueueDepth', 'OldestReplicationSlotLag') GROUP BY instance, ts)
    SELECT instance, CAST(floor(epoch(ts)) AS BIGINT) AS day_epoch,
           CASE WHEN (cs > 0.2 AND c * 1.2 > 250) OR (ds > 0.1 AND d * 1.2 > 300) OR (ls > 0.1 AND l * 1.2 > 100) THEN 'rising'
                WHEN cs < -0.04 AND ds < -0.03 AND ls < -0.03 AND c * 1.2 < 250 AND d * 1.2 < 300 AND l * 1.2 < 100 THEN 'falling'
                WHEN c * 1.4 < 250 AND d * 1.5 < 300 AND l * 1.6 < 100 THEN 'idle' ELSE 'steady' END AS verdict FROM w""")
def _(t):
    wide = M.trends_wide(t.v_metrics, unit="week")
    # Readings are a day apart here, so slopes are taken per day.
    daily = wide.withColumns({f"{m}_slope": F.col(f"{m}_slope") * 86400 for m in ("cpu", "queue", "lag")})
    return M.trend_verdict(daily, LIMITS).select("instance", day().alias("day_epoch"), "verdict")


def live(t, label: str):
    """The newest trend of every series after a stream over three files, each of which brings readings older than those before it."""
    path = scratch(t.spark, label)
    rows = t.v_metrics.withColumn("part", F.pmod(F.xxhash64("ts"), F.lit(3)))
    for k in range(3):
        rows.filter(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{path}/in/file={k}")
    stream = t.spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/file=*")

    def save(batch, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    trends = live_trend(stream, delay="60 days", keep="90 days")
    trends.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return latest(t.spark.read.parquet(f"{path}/out"), ["instance", "metric"], "batch")


@query("stm2_live_trend", """
    SELECT instance, metric, CAST(floor(epoch(ts)) AS BIGINT) AS day_epoch, value, samples, round(CASE WHEN samples >= 2 THEN s END, 6) AS daily_slope FROM (
        SELECT instance, metric, ts, value, count(value) OVER w AS samples, regr_slope(value, (epoch(ts) - 1704067200) / 86400) OVER w AS s,
               row_number() OVER (PARTITION BY instance, metric ORDER BY ts DESC) AS r
        FROM v_metrics WINDOW w AS (PARTITION BY instance, metric ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE r = 1""")
def _(t):
    return live(t, "trend").select("instance", "metric", day().alias("day_epoch"), "value", "samples", F.round(F.col("slope") * 86400, 6).alias("daily_slope"))


@query("stm1_live_gate", f"""
    WITH n AS (SELECT instance, metric, arg_max(value, ts) AS value FROM v_metrics GROUP BY ALL),
    w AS (SELECT instance, coalesce(max(value) FILTER (WHERE metric = 'CPUUtilization'), -1) AS cpu, coalesce(max(value) FILTER (WHERE metric = 'DiskQueueDepth'), -1) AS dq,
        coalesce(max(value) FILTER (WHERE metric = 'BurstBalance'), 100) AS bb, coalesce(max(value) FILTER (WHERE metric = 'ReadLatency'), 0) AS rl,
        coalesce(max(value) FILTER (WHERE metric = 'OldestReplicationSlotLag'), 0) AS lag FROM n GROUP BY instance)
    SELECT instance, round(cpu, 2) AS cpu, {OPEN} AS gate_open FROM w""")
def _(t):
    gated = M.metric_gate(M.wide(live(t, "gate"), ["instance"]), LIMITS)
    return gated.select("instance", F.col("CPUUtilization").alias("cpu"), "gate_open")


@query("stm4_latest_metric", f"""
    SELECT instance, metric, arg_max(value, ts) AS value, CAST(floor(epoch(max(ts))) AS BIGINT) AS day_epoch FROM v_metrics
    WHERE ts <= TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY GROUP BY ALL""")
def _(t):
    return M.latest_metric(t.v_metrics, AS_OF, "5 days").select("instance", "metric", "value", day().alias("day_epoch"))
