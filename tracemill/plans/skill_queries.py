"""Queries over skill loads and the skill catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import skills as K
from tracemill.plans.adapters import ctes, shape
from tracemill.plans.registry import query


def as_of():
    return F.lit("2001-11-05").cast("timestamp")


_AS_OF = "TIMESTAMP '2001-11-05 00:00:00'"


def _loads(spark, sf_dir):
    return shape(spark, sf_dir, "loads")


def _facts(spark, sf_dir):
    return K.skill_facts(K.skill_metrics(_loads(spark, sf_dir), as_of()), shape(spark, sf_dir, "catalog"))


_METRICS = ctes("loads", "catalog") + f""",
ps AS (SELECT tenant_id, skill, session_id, count(*) AS n, count(*) FILTER (WHERE failed) AS e, bool_or(ts >= {_AS_OF} - INTERVAL 30 DAY) AS r,
  count(*) FILTER (WHERE failed AND ts >= {_AS_OF} - INTERVAL 30 DAY) AS re, max(ts) AS last FROM loads GROUP BY ALL),
metrics AS (SELECT tenant_id, skill, count(*) AS load_sessions, count(*) FILTER (WHERE r) AS load_sessions_30d, CAST(sum(e) AS BIGINT) AS self_errors,
  CAST(sum(re) AS BIGINT) AS recent_self_errors, count(*) FILTER (WHERE n >= 2) AS reload_sessions,
  CAST(floor(date_diff('second', max(last), {_AS_OF}) / 86400) AS BIGINT) AS last_used_days FROM ps GROUP BY ALL),
cat AS (SELECT * EXCLUDE (archived, nth, any_archived), any_archived AS archived FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, lower(name) ORDER BY installed DESC, name) AS nth,
  bool_or(archived) OVER (PARTITION BY tenant_id, lower(name)) AS any_archived FROM catalog) WHERE nth = 1),
facts AS (SELECT coalesce(c.tenant_id, m.tenant_id) AS tenant_id, coalesce(c.name, m.skill) AS name, coalesce(c.installed, false) AS installed,
  coalesce(c.disabled, false) AS disabled, coalesce(c.archived, false) AS archived, c.size_bytes, c.age_days, coalesce(m.load_sessions, 0) AS load_sessions,
  coalesce(m.load_sessions_30d, 0) AS load_sessions_30d, coalesce(m.self_errors, 0) AS self_errors, coalesce(m.recent_self_errors, 0) AS recent_self_errors,
  coalesce(m.reload_sessions, 0) AS reload_sessions, m.last_used_days, coalesce(c.vault_mentions_90d, 0) AS vault_mentions_90d
  FROM cat c FULL JOIN metrics m ON m.tenant_id = c.tenant_id AND m.skill = lower(c.name))
"""


@query(_METRICS + "SELECT * FROM metrics")
def skill_metrics(spark, sf_dir):
    return K.skill_metrics(_loads(spark, sf_dir), as_of()).drop("skill_key").withColumn("last_used_days", F.col("last_used_days").cast("long"))


@query(_METRICS + "SELECT * FROM facts")
def skill_facts(spark, sf_dir):
    return _facts(spark, sf_dir).drop("skill_key", "edits", "usage_quality").withColumn("last_used_days", F.col("last_used_days").cast("long"))


@query(_METRICS + """SELECT tenant_id, count(*) FILTER (WHERE installed) AS total_installed, count(*) FILTER (WHERE load_sessions > 0) AS used,
count(*) FILTER (WHERE installed AND load_sessions = 0) AS dead, count(*) FILTER (WHERE NOT installed AND load_sessions > 0) AS broken_ref FROM facts GROUP BY 1""")
def usage_totals(spark, sf_dir):
    return K.usage_totals(_facts(spark, sf_dir))


@query(_METRICS + """SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY load_sessions DESC, name) AS position, name, load_sessions
FROM facts WHERE load_sessions > 0 QUALIFY position <= 10""")
def top_used_skills(spark, sf_dir):
    return K.top_used(_facts(spark, sf_dir))


_WEEKLY = ctes("loads") + f""", weekly AS (SELECT tenant_id, CAST(date_trunc('week', ts) AS DATE) AS week, skill, count(*) AS load FROM loads
  WHERE ts >= {_AS_OF} - INTERVAL 42 DAY GROUP BY ALL)"""


@query(_WEEKLY + " SELECT tenant_id, CAST(week AS VARCHAR) AS week, skill, load FROM weekly")
def weekly_skill_loads(spark, sf_dir):
    return K.weekly_loads(_loads(spark, sf_dir), as_of()).withColumn("week", F.col("week").cast("string"))


_SNAPS = f""", weekly AS (SELECT tenant_id, CAST(date_trunc('week', ts) AS DATE) AS week, skill, count(*) AS load FROM loads
  WHERE ts >= {_AS_OF} - INTERVAL 280 DAY GROUP BY ALL),
have AS (SELECT tenant_id, week, skill, load + 1000 AS load, false AS backfilled FROM weekly WHERE week < DATE '2001-07-02'),
snaps AS (SELECT * FROM (SELECT * FROM have UNION ALL SELECT *, true FROM weekly w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.tenant_id = w.tenant_id AND h.week = w.week))
  QUALIFY dense_rank() OVER (PARTITION BY tenant_id ORDER BY week DESC) <= 26)
"""
_HISTORY = ctes("loads") + _SNAPS


def _snapshots(spark, sf_dir):
    weekly = K.weekly_loads(_loads(spark, sf_dir), as_of(), weeks=40)
    have = weekly.where("week < DATE '2001-07-02'").select(
        "tenant_id", "week", "skill", (F.col("load") + 1000).cast("int").alias("load"), *[F.lit(0).alias(c) for c in ("self_err", "reload", "edits")],
        F.lit(False).alias("disabled"), F.lit(False).alias("backfilled"))
    return K.backfill_snapshots(have, weekly)


@query(_HISTORY + "SELECT tenant_id, CAST(week AS VARCHAR) AS week, skill, load, backfilled FROM snaps")
def snapshot_backfill(spark, sf_dir):
    return _snapshots(spark, sf_dir).select("tenant_id", F.col("week").cast("string").alias("week"), "skill", "load", "backfilled")


@query(_HISTORY + """, r AS (SELECT DISTINCT tenant_id, week FROM snaps WHERE week < DATE '2001-11-02' QUALIFY dense_rank() OVER (PARTITION BY tenant_id ORDER BY week DESC) <= 3)
SELECT DISTINCT s.tenant_id, s.skill AS skill_key FROM snaps s JOIN r USING (tenant_id, week) WHERE s.load > 0
AND s.tenant_id IN (SELECT tenant_id FROM r GROUP BY 1 HAVING count(DISTINCT week) >= 3)""")
def baseline_used_skills(spark, sf_dir):
    ready, used = K.baseline(_snapshots(spark, sf_dir), as_of())
    return used.join(ready, "tenant_id", "left_semi")


@query(_METRICS + """SELECT tenant_id, '2001-11-05' AS week, count(*) AS skills, CAST(sum(load_sessions) AS BIGINT) AS loads FROM facts GROUP BY 1""")
def snapshot_of_day(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    snaps = K.add_snapshot(K.add_snapshot(_snapshots(spark, sf_dir), facts, "2001-11-05"), facts, "2001-11-05")
    return snaps.where("week = DATE '2001-11-05'").groupBy("tenant_id", F.col("week").cast("string").alias("week")).agg(
        F.count("*").alias("skills"), F.sum("load").alias("loads"))


_BASE = _METRICS + _SNAPS + """,
r AS (SELECT DISTINCT tenant_id, week FROM snaps WHERE week < DATE '2001-11-02' QUALIFY dense_rank() OVER (PARTITION BY tenant_id ORDER BY week DESC) <= 3),
ready AS (SELECT tenant_id FROM r GROUP BY 1 HAVING count(DISTINCT week) >= 3),
usedw AS (SELECT DISTINCT s.tenant_id, s.skill FROM snaps s JOIN r USING (tenant_id, week) WHERE s.load > 0)
"""


@query(_BASE + """SELECT tenant_id, 'retire' AS kind, name AS target, size_bytes, age_days, row_number() OVER (PARTITION BY tenant_id ORDER BY size_bytes DESC, name) AS position
FROM facts f WHERE installed AND NOT disabled AND load_sessions = 0 AND age_days >= 90 AND vault_mentions_90d = 0 AND NOT regexp_matches(name, '^(user|auto-skill-save)')
AND tenant_id IN (SELECT tenant_id FROM ready) AND NOT EXISTS (SELECT 1 FROM usedw u WHERE u.tenant_id = f.tenant_id AND u.skill = lower(f.name)) QUALIFY position <= 5""")
def retire_candidates(spark, sf_dir):
    ready, used = K.baseline(_snapshots(spark, sf_dir), as_of())
    return K.retire_candidates(_facts(spark, sf_dir), ready, used)


@query(_METRICS + """SELECT tenant_id, CASE WHEN installed THEN 'repair' ELSE 'fix_reference' END AS kind, name AS target, self_errors, recent_self_errors
FROM facts WHERE recent_self_errors > 0 AND (installed OR NOT archived)""")
def repair_candidates(spark, sf_dir):
    return K.repair_candidates(_facts(spark, sf_dir))


_CAP = _METRICS + """, act AS (SELECT *, load_sessions = 0 AND age_days >= 90 AND NOT regexp_matches(name, '^user') AS idle FROM facts WHERE installed AND NOT disabled),
o AS (SELECT tenant_id, count(*) AS active_before, greatest(count(*) - 120, 0) AS over FROM act GROUP BY 1),
v AS (SELECT a.tenant_id, name, size_bytes, age_days, over, row_number() OVER (PARTITION BY a.tenant_id ORDER BY size_bytes DESC, name) AS p
  FROM act a JOIN o USING (tenant_id) WHERE over > 0 AND idle AND vault_mentions_90d = 0 QUALIFY p <= o.over)
"""


@query(_CAP + """SELECT tenant_id, name, size_bytes, age_days, 'disable' AS action FROM v UNION ALL
SELECT tenant_id, name, size_bytes, age_days, 'conflict' FROM act JOIN o USING (tenant_id) WHERE over > 0 AND idle AND vault_mentions_90d > 0""")
def cap_actions(spark, sf_dir):
    return K.cap_plan(_facts(spark, sf_dir))[0]


@query(_CAP + """SELECT o.tenant_id, 120 AS cap, active_before, active_before - count(v.name) AS active_after, o.over - count(v.name) AS skipped, 'measured' AS usage_quality
FROM o LEFT JOIN v USING (tenant_id) GROUP BY o.tenant_id, active_before, o.over""")
def cap_totals(spark, sf_dir):
    return K.cap_plan(_facts(spark, sf_dir))[1]


@query(ctes("catalog") + "SELECT tenant_id, count(*) AS skills, count(*) FILTER (WHERE archived) AS archived, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM catalog GROUP BY 1")
def skill_catalog(spark, sf_dir):
    return shape(spark, sf_dir, "catalog").groupBy("tenant_id").agg(F.count("*").alias("skills"), F.count_if("archived").alias("archived"), F.sum("size_bytes").alias("bytes"))


_CALLS = ctes("agent_messages") + """,
calls AS (SELECT tenant_id, session_id, msg_id, ts, concat('demo', CAST((msg_id % 1000) % 4 AS VARCHAR)) AS skill, concat('c', CAST(msg_id AS VARCHAR)) AS call_id
  FROM agent_messages WHERE role = 'assistant'),
tools AS (SELECT session_id, msg_id, tool_call_id, contains(content, '"success": false') AS f FROM agent_messages WHERE role = 'tool'),
j AS (SELECT c.*, d.f AS own, (SELECT arg_min(t.f, t.msg_id) FROM tools t WHERE t.session_id = c.session_id AND t.msg_id > c.msg_id) AS nxt
  FROM calls c LEFT JOIN tools d ON d.tool_call_id = c.call_id)
"""


@query(_CALLS + "SELECT msg_id, skill, call_id FROM calls")
def skill_calls(spark, sf_dir):
    return K.skill_calls(shape(spark, sf_dir, "agent_messages")).select("msg_id", "skill", "call_id")


@query(_CALLS + "SELECT msg_id, skill, coalesce(own, nxt, false) AS failed, own IS NULL AS approximate FROM j")
def skill_call_outcomes(spark, sf_dir):
    m = shape(spark, sf_dir, "agent_messages")
    return K.call_outcomes(K.skill_calls(m), m).select("msg_id", "skill", "failed", "approximate")


@query(_CALLS + "SELECT tenant_id, concat('demo', CAST(session_id % 3 AS VARCHAR)) AS skill, count(*) AS edits FROM agent_messages WHERE role = 'assistant' GROUP BY ALL")
def skill_edits(spark, sf_dir):
    return K.skill_edits(shape(spark, sf_dir, "agent_messages"))
