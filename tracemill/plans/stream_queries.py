"""Batch twins of the streaming operators over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.plans.adapters import ctes, given, shape
from tracemill.plans.registry import query
from tracemill.streaming import alerts as A
from tracemill.streaming import flows as W
from tracemill.streaming import triggers as G


@query(ctes("alerts").replace("WITH", "WITH RECURSIVE", 1) + """, o AS (SELECT * REPLACE (CASE WHEN event_id % 40 <> 0 THEN message END AS message), row_number() OVER (PARTITION BY channel ORDER BY ts, event_id) AS n, epoch_us(ts) / 1e6 AS sec FROM alerts),
s AS (SELECT channel, n, event_id, message IS NOT NULL AS send, CASE WHEN delivered THEN message END AS d, message AS a, sec AS t FROM o WHERE n = 1 UNION ALL
  SELECT o.channel, o.n, o.event_id, x.send, CASE WHEN o.message IS NULL OR (x.send AND o.delivered) THEN o.message ELSE s.d END, CASE WHEN o.message IS NULL OR x.send THEN o.message ELSE s.a END, CASE WHEN x.send THEN o.sec ELSE s.t END
  FROM s JOIN o ON o.channel = s.channel AND o.n = s.n + 1, LATERAL (SELECT o.message IS NOT NULL AND NOT (coalesce(o.message = s.d, false) OR coalesce(o.message = s.a AND o.sec - s.t < 3600, false)) AS send) x)
SELECT channel, event_id, send FROM s""")
def suppressed_alerts(spark, sf_dir):
    alerts = shape(spark, sf_dir, "alerts").withColumn("message", F.when(F.col("event_id") % 40 != 0, F.col("message")))  # every fortieth is a recovery
    return A.suppress_alerts_batch(alerts).select("channel", "event_id", "send")


_TURNS = """WITH RECURSIVE o AS (SELECT user_id AS session_id, event_id, epoch_us(ts) // 1000000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
s AS (SELECT session_id, event_id, turn, 'snapshot_30min' AS trigger, sec AS last FROM o WHERE turn = 1 UNION ALL
  SELECT o.session_id, o.event_id, o.turn, x.f, CASE WHEN x.f IS NOT NULL THEN o.sec ELSE s.last END FROM s JOIN o ON o.session_id = s.session_id AND o.turn = s.turn + 1,
  LATERAL (SELECT CASE WHEN o.turn % 5 = 0 THEN 'snapshot_5turn' WHEN o.sec - s.last >= 1800 THEN 'snapshot_30min' END AS f) x)
SELECT session_id, event_id, turn, trigger FROM s"""


@query(_TURNS)
def snapshot_triggers(spark, sf_dir):
    e = given(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    return G.snapshot_triggers_batch(e).select("session_id", "event_id", "turn", "trigger")


_USED = "CAST(floor(value * 37) AS BIGINT) % 2400"


@query(f"SELECT event_id, u AS used, CASE WHEN u > 1800 THEN 'urgent' WHEN u > 1500 THEN 'warn' END AS level, u * 100 // 2200 AS percent FROM (SELECT event_id, {_USED} AS u FROM events)")
def memory_levels(spark, sf_dir):
    e = given(spark, sf_dir, "events").select("event_id", (F.floor(F.col("value") * 37) % 2400).alias("used"))
    return e.select("event_id", "used", G.memory_level("used").alias("level"), G.memory_percent("used").alias("percent"))


@query(f"""WITH u AS (SELECT user_id AS session_id, event_id, ts, CASE WHEN x > 1800 THEN 'urgent' WHEN x > 1500 THEN 'warn' ELSE 'normal' END AS level FROM (SELECT *, {_USED} AS x FROM events))
SELECT session_id, event_id, level FROM (SELECT *, lag(level, 1, 'normal') OVER (PARTITION BY session_id ORDER BY ts, event_id) AS b FROM u) WHERE level <> b""")
def memory_level_changes(spark, sf_dir):
    e = given(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts", (F.floor(F.col("value") * 37) % 2400).alias("used"))
    return G.level_changes_batch(e).select("session_id", "event_id", "level")


@query("SELECT arg_min(event_id, ts) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def deduplicated_events(spark, sf_dir):
    e = given(spark, sf_dir, "events")
    return W.dedupe_events_batch(e, ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query("""SELECT 'day' AS grain, strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'week', strftime(date_trunc('week', ts), '%Y-%m-%d'), event_type, count(*) FROM events GROUP BY ALL""")
def tumbling_event_counts(spark, sf_dir):
    e = given(spark, sf_dir, "events")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    parts = [W.tumbling_counts(e, ["event_type"], width=w).select(F.lit(g).alias("grain"), F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n") for g, w in (("day", "1 day"), ("week", "7 days"))]
    return parts[0].unionByName(parts[1])
