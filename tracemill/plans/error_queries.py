"""Queries over error events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import keys as K
from tracemill.operators import errors as E
from tracemill.plans.adapters import ctes, given, shape
from tracemill.plans.registry import query

DAY = "2024-01-15"


def as_of():
    return F.lit("2024-01-31").cast("timestamp")


# The placeholder rules again, in RE2 syntax, innermost first.
_RULES = [
    (r"\"[^\"]{8,}\"", '"STR"'), ("''[^'']{8,}''", "''STR''"), ("`[^`]{4,}`", "`CODE`"),
    (r"(?:/[\w.\-]+){2,}/?", "/PATH"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "DATETIME"),
    (r"\d{4}-\d{2}-\d{2}", "DATE"), (r"\d{2}:\d{2}(:\d{2})?", "TIME"), ("0x[0-9a-fA-F]+", "HEX"),
    (r"\b[0-9a-fA-F]{8,}\b", "HEX"), (r"\b(?:pid|PID)\s*[=:]?\s*\d+", "pid=NUM"),
    (r"\b\d{1,3}(\.\d{1,3}){3}(:\d+)?\b", "IP"), (r":\d{2,5}\b", ":PORT"), (r"\bv?\d+(\.\d+){1,3}\b", "VER"),
    (r"\b\d{2,}\b", "NUM"),
]
_STOP = "['the','a','an','is','are','was','were','to','of','in','on','at','for','with','by','and','or','not','no','it','this','that','be','been','has','have','had','from','as','but']"


def sql_key(text: str) -> str:
    """DuckDB expression for the fingerprint of a Latin-script text."""
    t = text
    for pattern, mark in _RULES:
        t = f"regexp_replace({t}, '{pattern}', '{mark}', 'g')"
    return (
        f"array_to_string(list_filter(regexp_extract_all(lower({t}), '[a-z_][a-z0-9_]*'), "
        f"lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))[1:8], ' ')"
    )


@query(ctes("errors") + f""",
keyed AS (SELECT *, {sql_key('error_text')} AS cluster_key FROM errors),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, cluster_key ORDER BY event_id) AS rn FROM keyed)
SELECT tenant_id, cluster_key, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(min(first_seen) AS VARCHAR) AS first_seen,
       CAST(max(last_seen) AS VARCHAR) AS last_seen, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
       arg_min(substring(error_text, 1, 120), length(error_text) * 1000000000 + event_id) AS title,
       string_agg(CASE WHEN rn <= 2 THEN error_text END, ' | ' ORDER BY event_id) AS examples
FROM ranked GROUP BY tenant_id, cluster_key""")
def error_clusters(spark, sf_dir):
    c = E.cluster_errors(shape(spark, sf_dir, "errors"))
    return c.select(
        "tenant_id", "cluster_key", "cnt", F.col("first_seen").cast("string").alias("first_seen"),
        F.col("last_seen").cast("string").alias("last_seen"), F.array_join("sources", ",").alias("sources"), "title",
        F.array_join("examples", " | ").alias("examples"),
    )


@query(ctes("errors") + f"SELECT event_id, {sql_key('error_text')} AS cluster_key FROM errors")
def error_fingerprints(spark, sf_dir):
    return shape(spark, sf_dir, "errors").select("event_id", K.normalize_key("error_text").alias("cluster_key"))


@query(ctes("errors") + """
SELECT tenant_id, category, n, today, week, CAST(n * 100 // sum(n) OVER (PARTITION BY tenant_id) AS BIGINT) AS percent
FROM (SELECT tenant_id, category, count(*) AS n, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-15') AS today,
             count(*) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-08') AS week
      FROM errors GROUP BY ALL)""")
def error_category_report(spark, sf_dir):
    return E.error_report(shape(spark, sf_dir, "errors"), F.lit(DAY).cast("timestamp"))


@query(ctes("errors") + """
SELECT tenant_id, event_id, category FROM errors
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id DESC) <= 10""")
def error_last_ten(spark, sf_dir):
    return E.keep_last(shape(spark, sf_dir, "errors"), 10).select("tenant_id", "event_id", "category")


@query(ctes("errors") + """
SELECT tenant_id, event_id FROM errors
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id DESC) <= 100""")
def error_log_last_hundred(spark, sf_dir):
    return E.keep_last(shape(spark, sf_dir, "errors"), 100).select("tenant_id", "event_id")


@query(ctes("errors") + """
SELECT tenant_id, message, n, row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, f) AS position
FROM (SELECT tenant_id, message, count(*) AS n, min(event_id) AS f FROM errors GROUP BY ALL) QUALIFY position <= 5""")
def error_top_messages(spark, sf_dir):
    return E.top_messages(shape(spark, sf_dir, "errors"), 5)


@query(ctes("errors") + """,
m AS (SELECT tenant_id, message AS value, count(*) AS n, min(event_id) AS f FROM errors GROUP BY ALL),
t AS (SELECT tenant_id, tool AS value, count(*) AS n, min(event_id) AS f FROM errors GROUP BY ALL),
s AS (SELECT *, 'frequent' AS section FROM m WHERE n >= 3 UNION ALL SELECT *, 'top' FROM m UNION ALL SELECT *, 'tool' FROM t)
SELECT tenant_id, section, value, n, row_number() OVER (PARTITION BY tenant_id, section ORDER BY n DESC, f) AS position
FROM s QUALIFY position <= CASE section WHEN 'top' THEN 15 ELSE 10 END""")
def error_learning_report(spark, sf_dir):
    return E.learning_report(shape(spark, sf_dir, "errors"))


_EXECUTIONS = """, executions AS (
  SELECT event_id, user_id % 8 AS tenant_id, concat('job-', CAST(user_id % 20 AS VARCHAR)) AS job_id, ts AS claimed_at,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
         concat(' value ', CAST(event_id AS VARCHAR), chr(10), props) AS error FROM events),
jobs AS (SELECT concat('job-', CAST(s_suppkey AS VARCHAR)) AS job_id, s_name AS name FROM supplier)"""


def _executions(spark, sf_dir):
    ev = given(spark, sf_dir, "events")
    runs = ev.select(
        "event_id", (F.col("user_id") % 8).alias("tenant_id"), F.concat(F.lit("job-"), F.col("user_id") % 20).alias("job_id"),
        F.col("ts").cast("timestamp").alias("claimed_at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.concat(F.lit(" value "), "event_id", F.lit("\n"), "props").alias("error"),
    )
    jobs = given(spark, sf_dir, "supplier").select(
        F.concat(F.lit("job-"), "s_suppkey").alias("job_id"), F.col("s_name").alias("name"))
    return runs, jobs


@query("WITH d AS (SELECT 1)" + _EXECUTIONS + """
SELECT e.tenant_id, e.job_id, coalesce(j.name, substring(e.job_id, 1, 8)) AS name, strftime(claimed_at, '%H:%M') AS at,
       substring(split_part(trim(error), chr(10), 1), 1, 140) AS err, 'cron' AS source
FROM executions e LEFT JOIN jobs j USING (job_id)
WHERE status = 'failed' AND claimed_at >= DATE '2024-01-15' AND claimed_at < DATE '2024-01-16'""")
def job_failures_of_day(spark, sf_dir):
    runs, jobs = _executions(spark, sf_dir)
    return E.job_failures(runs, jobs, DAY)


@query(ctes("alerts") + """
SELECT tenant_id, status, note, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (
  SELECT user_id % 8 AS tenant_id, channel AS status, message AS note, ts FROM alerts
  QUALIFY row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts DESC, channel DESC) = 1)
WHERE CAST(ts AS DATE) = DATE '2024-01-30'""")
def run_status_of_day(spark, sf_dir):
    a = shape(spark, sf_dir, "alerts").select(
        (F.col("user_id") % 8).alias("tenant_id"), F.col("channel").alias("status"), F.col("message").alias("note"), "ts")
    return E.run_status(a, "2024-01-30").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("WITH d AS (SELECT 1)" + _EXECUTIONS + """,
f AS (SELECT e.tenant_id, coalesce(j.name, e.job_id) AS name, substring(split_part(trim(error), chr(10), 1), 1, 140) AS err
      FROM executions e LEFT JOIN jobs j USING (job_id)
      WHERE status = 'failed' AND claimed_at >= DATE '2024-01-15' AND claimed_at < DATE '2024-01-16'),
g AS (SELECT tenant_id, concat('2024-01-15|cron|', name, '|', substring(err, 1, 60)) AS error_key, name AS job, err AS what FROM f)
SELECT tenant_id, error_key, job, what, count(*) * 2 AS cnt, 'r1,r2' AS runs FROM g GROUP BY ALL""")
def error_ledger_upsert(spark, sf_dir):
    """Two runs of the same day, the second one repeated: the repeat adds nothing."""
    runs, jobs = _executions(spark, sf_dir)
    failed = E.job_failures(runs, jobs, DAY)
    none = failed.select("tenant_id", F.col("job_id").alias("status"), F.lit("").alias("note")).where("false")
    today = E.daily_errors(DAY, failed, failed.where("false"), none)
    ledger = spark.createDataFrame([], "tenant_id long, error_key string, source string, job string, severity string, what string, cnt long, first_seen date, last_seen date, run_ids array<string>")
    for run in ("r1", "r2", "r2"):
        ledger = E.upsert_errors(ledger, today, DAY, run)
    return ledger.select("tenant_id", "error_key", "job", "what", "cnt", F.array_join("run_ids", ",").alias("runs"))


@query(ctes("sessions", "errors") + """,
f AS (SELECT DISTINCT tenant_id, substring(concat('Tool t', CAST(user_id % 7 AS VARCHAR)), 1, 10) AS p FROM errors),
j AS (SELECT tenant_id, session_id, concat('Tool t', CAST(session_id % 11 AS VARCHAR), ' nightly') AS name FROM sessions)
SELECT j.tenant_id, j.session_id, j.name,
       CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.tenant_id = j.tenant_id AND starts_with(j.name, f.p)) THEN 'failed' ELSE 'ok' END AS mark
FROM j""")
def job_marks(spark, sf_dir):
    jobs = shape(spark, sf_dir, "sessions").select(
        "tenant_id", "session_id", F.concat(F.lit("Tool t"), F.col("session_id") % 11, F.lit(" nightly · run")).alias("title"))
    failures = shape(spark, sf_dir, "errors").select("tenant_id", F.concat(F.lit("Tool t"), F.col("user_id") % 7).alias("name"))
    return E.mark_jobs(jobs, failures).select("tenant_id", "session_id", "name", "mark")


@query(ctes("errors") + """,
g AS (SELECT DISTINCT user_id FROM errors), o AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM errors)
SELECT g.user_id, CAST(d.day AS VARCHAR) AS day
FROM g CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-08', DATE '2024-01-14', INTERVAL 1 DAY)) AS DATE) AS day) d
ANTI JOIN o ON o.user_id = g.user_id AND o.day = d.day""")
def missing_daily_outputs(spark, sf_dir):
    e = shape(spark, sf_dir, "errors").select("user_id", F.to_date("ts").alias("day"))
    return E.missing_days(e, e.select("user_id").distinct(), DAY, 7).withColumn("day", F.col("day").cast("string"))


@query(ctes("errors") + """
SELECT tenant_id, event_id, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, event_id) AS position FROM errors""")
def error_timeline(spark, sf_dir):
    return E.number_errors(shape(spark, sf_dir, "errors")).select("tenant_id", "event_id", "position")


@query(ctes("errors") + """, al AS (SELECT event_id, ts, channel AS error_text FROM (""" + "SELECT event_id, ts, event_type AS channel FROM events WHERE event_type = 'signup'" + """))
SELECT event_id, error_text, origin FROM (
  SELECT event_id, error_text, 'log' AS origin FROM errors UNION ALL SELECT event_id, error_text, 'feed' FROM al)""")
def error_sources_union(spark, sf_dir):
    e = shape(spark, sf_dir, "errors").select("event_id", "error_text", F.lit("log").alias("origin"))
    feed = shape(spark, sf_dir, "alerts").where("channel = 'signup'").select("event_id", F.col("channel").alias("error_text"), F.lit("feed").alias("origin"))
    return e.unionByName(feed)


@query(ctes("errors") + """
SELECT event_id, CAST(date_trunc('week', ts) AS DATE)::VARCHAR AS week, regexp_extract(error_text, '\\d{4}-\\d{2}-\\d{2}') AS said,
       date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') // 86400 AS age
FROM errors""")
def error_dates(spark, sf_dir):
    return shape(spark, sf_dir, "errors").select(
        "event_id", K.week_of("ts").cast("string").alias("week"), K.date_in("error_text").cast("string").alias("said"),
        K.age_days(F.col("ts").cast("timestamp"), as_of()).cast("long").alias("age"),
    )
