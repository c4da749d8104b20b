"""Shapes the given tables into the package's tables. The SQL runs unchanged in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SHAPES = {
    # conversations as messages and sessions; every conversation starts an hour after the one before
    "messages": """
        SELECT conv_id % 8 AS tenant_id, conv_id AS session_id, conv_id * 1000 + turn AS msg_id, turn AS ordinal, role,
               text AS content,
               TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS ts
        FROM {conversations}""",
    "sessions": """
        SELECT conv_id % 8 AS tenant_id, conv_id AS session_id,
               CASE conv_id % 10 WHEN 0 THEN 'cron' WHEN 1 THEN 'tool' ELSE 'cli' END AS source,
               substring(min(CASE WHEN turn = 0 THEN text END), 1, 40) AS title,
               CASE WHEN conv_id % 11 = 0 THEN 'parent' END AS parent_session_id,
               CASE WHEN conv_id % 13 = 0 THEN 1 ELSE 0 END AS archived,
               count(*) AS message_count, conv_id % 5 AS tool_call_count,
               TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR AS started_at
        FROM {conversations} GROUP BY conv_id""",
    # line items as skill loads: the first four lines load a known skill, the others one that is gone
    "loads": """
        SELECT l_suppkey * 3 % 4 AS tenant_id, l_orderkey % 50 AS session_id,
               CASE WHEN l_linenumber <= 4 THEN concat('skill-', CAST(l_suppkey * 3 AS VARCHAR(20)))
                    ELSE concat('gone-', CAST(l_suppkey % 7 AS VARCHAR(9))) END AS skill,
               l_linenumber, l_shipdate AS ts, l_returnflag = 'R' AS failed
        FROM {lineitem}""",
    # parts as the skill catalog; small ones are archived, and of every seventh an archived copy is left in other case
    "catalog": """
        SELECT p_partkey % 4 AS tenant_id, concat('sKILL-', CAST(p_partkey AS VARCHAR(20))) AS name, 900 AS age_days,
               CAST(1 AS BIGINT) AS size_bytes, false AS installed, true AS archived, true AS disabled, 0 AS vault_mentions_90d,
               'measured' AS usage_quality
        FROM {part} WHERE p_partkey % 7 = 0
        UNION ALL
        SELECT p_partkey % 4 AS tenant_id, concat('Skill-', CAST(p_partkey AS VARCHAR(20))) AS name, p_size * 5 AS age_days,
               CAST(round(p_retailprice) AS BIGINT) AS size_bytes, p_size > 5 AS installed, p_size <= 5 AS archived,
               p_brand = 'Brand#1' AS disabled, CASE WHEN p_brand = 'Brand#2' THEN 1 ELSE 0 END AS vault_mentions_90d,
               'measured' AS usage_quality
        FROM {part}""",
    # conversations as agent messages: assistant turns load a skill, user turns stand for tool results
    "agent_messages": """
        SELECT conv_id % 8 AS tenant_id, conv_id AS session_id, conv_id * 1000 + turn AS msg_id,
               CASE role WHEN 'user' THEN 'tool' ELSE role END AS role,
               CASE WHEN role = 'assistant' THEN concat('[{"id":"c', CAST(conv_id * 1000 + turn AS VARCHAR(20)),
                   '","function":{"name":"skill_view","arguments":"{\\"name\\":\\"plug:demo', CAST(turn % 4 AS VARCHAR(9)),
                   '\\"}"}},{"call_id":"x","function":{"name":"skill_manage","arguments":"{\\"operations\\":[{\\"name\\":\\"demo',
                   CAST(conv_id % 3 AS VARCHAR(9)), '\\"}]}"}}]') END AS tool_calls,
               CASE WHEN role = 'user' AND conv_id % 3 <> 0 THEN concat('c', CAST(conv_id * 1000 + turn - 1 AS VARCHAR(20))) END AS tool_call_id,
               CASE WHEN role = 'user' AND length(text) % 2 = 0 THEN concat(text, ' {"success": false}') ELSE text END AS content,
               TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS ts
        FROM {conversations}""",
    "notes": """
        SELECT doc_id, source AS directory, lang, doc_id % 90 AS day_no,
               DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS day,
               concat(source, '/', CAST(doc_id AS VARCHAR(20)), '.md') AS path, text AS body
        FROM {documents}""",
    "errors": """
        SELECT event_id, user_id % 8 AS tenant_id, user_id, ts,
               concat('Tool t', CAST(user_id % 7 AS VARCHAR(9)), ' timeout error at 2024-01-0',
                      CAST(1 + user_id % 9 AS VARCHAR(9)), ' 10:00 pid=', CAST(event_id AS VARCHAR(20)),
                      ' id ', CAST(1000 + user_id AS VARCHAR(20))) AS error_text,
               concat('s', CAST(user_id % 3 AS VARCHAR(9))) AS source, 1 AS cnt,
               CAST(ts AS DATE) AS first_seen, CAST(ts AS DATE) AS last_seen,
               concat('c', CAST(user_id % 4 AS VARCHAR(9))) AS category,
               concat('t', CAST(user_id % 7 AS VARCHAR(9))) AS tool,
               concat('t', CAST(user_id % 7 AS VARCHAR(9)), ': code ', CAST(user_id AS VARCHAR(20))) AS message
        FROM {events} WHERE event_type = 'error'""",
    # documents as session summaries; lists are built from the text parts
    "summaries": """
        SELECT doc_id % 4 AS tenant_id, doc_id AS session_id, DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS date,
               TIMESTAMP '2024-01-01 00:00:00' + doc_id % 90 * INTERVAL '1' DAY AS updated, source AS project,
               CASE doc_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'blocked' ELSE 'in_progress' END AS status,
               substring(text, 1, 60) AS title, substring(text, 61, 100) AS goal_text, text AS claim_text,
               substring(text, 161, 100) AS verified_text, substring(text, 261, 100) AS open_text,
               substring(text, 361, 100) AS decision_text, substring(text, 461, 100) AS correction_text
        FROM {documents}""",
    "vectors": """
        SELECT vec_id AS unit_id, vec_id % 50 AS source_id, label AS kind, embedding FROM {embeddings}""",
    # every document quotes itself, except those ending in 1, which quote their successor
    "refs": """
        SELECT d.doc_id AS memory_id, d.doc_id AS path,
               CASE WHEN d.doc_id % 10 = 1 THEN substring(n.text, 5, 40) ELSE substring(d.text, 5, 40) END AS quote
        FROM {documents} d LEFT JOIN {documents} n ON n.doc_id = d.doc_id + 1""",
    "alerts": """
        SELECT event_id, event_type AS channel, concat('m', CAST(user_id % 3 AS VARCHAR(3))) AS message, user_id, ts,
               event_id % 4 <> 0 AS delivered
        FROM {events}""",
    "versions": """
        SELECT o_custkey AS memory_id,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision,
               CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'candidate' ELSE 'superseded' END AS status
        FROM {orders}""",
    "receipts": """
        SELECT o_orderkey AS receipt_id, o_custkey AS task_id, o_orderdate AS created_at FROM {orders}""",
    "retrievals": """
        SELECT DISTINCT l_orderkey AS receipt_id, l_partkey AS memory_id FROM {lineitem}""",
    # one report per order: the outcome of its smallest line
    "feedback": """
        SELECT l_orderkey AS receipt_id, min(l_linenumber) AS seq,
               CASE min(concat(CAST(l_linenumber AS VARCHAR(9)), l_returnflag))
                    WHEN '1R' THEN 'failed' WHEN '1A' THEN 'verified_success' WHEN '2A' THEN 'user_accepted'
                    ELSE 'unknown' END AS outcome
        FROM {lineitem} GROUP BY l_orderkey""",
}


def _filled(sql: str, **tables: str) -> str:
    for t, value in tables.items():
        sql = sql.replace("{" + t + "}", value)
    return sql


TEXT_TABLES = ("documents", "pages", "conversations")


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table. Text tables that come as fewer splits than there are cores are spread over the cores, because their
    queries are bound by work per row; a table of many files is read as it is."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in TEXT_TABLES and df.rdd.getNumPartitions() < cores else df


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SHAPES[name]
    tables = {t: given(spark, sf_dir, t) for t in _tables(sql)}
    for t, df in tables.items():
        df.createOrReplaceTempView(f"given_{t}")
    body = _filled(sql, **{t: f"given_{t}" for t in tables})
    for n in ("3", "9", "20"):
        body = body.replace(f"VARCHAR({n})", "STRING")
    return spark.sql(body.replace("\\\"", "\\\\\""))


def ctes(*names: str) -> str:
    """WITH list of the named shapes for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({_filled(SHAPES[n], **{t: t for t in _tables(SHAPES[n])})})" for n in names)


def _tables(sql: str) -> set[str]:
    return set(re.findall(r"\{([a-z]+)\}", sql))
