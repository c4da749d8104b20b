"""Queries that parse logs and files. The lines are derived from the given tables, so the work grows with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import keys as K
from tracemill.functions import text as T
from tracemill.operators import errors as E
from tracemill.operators import experience as X
from tracemill.operators import retrieval as R
from tracemill.plans.adapters import ctes, given, shape
from tracemill.plans.registry import query
from tracemill.sources import index as I
from tracemill.sources import rollouts as L
from tracemill.sources import tables as B


def as_of():
    return F.lit("2024-03-15").cast("timestamp")


def rollout_lines(spark, sf_dir):
    """Conversations as session logs: a file per conversation, every third one also as an active copy without its first turn.

    Line 0 names the session, then one record per turn; assistant turns of odd conversations are tool outputs. One line in
    each file is not JSON.
    """
    c = given(spark, sf_dir, "conversations").withColumnRenamed("text", "body")
    sid, ident = F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tool = (F.col("role") == "assistant") & (F.col("conv_id") % 2 == 1)
    said = F.to_json(F.struct(
        stamp.alias("timestamp"), F.lit("response_item").alias("type"),
        F.struct(F.lit("message").alias("type"), ident.alias("id"), F.col("role").alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), F.col("body").alias("text"))).alias("content"), F.concat(F.lit("t"), "turn").alias("turn_id")).alias("payload")))
    output = F.to_json(F.struct(
        stamp.alias("timestamp"), F.lit("response_item").alias("type"),
        F.struct(F.lit("function_call_output").alias("type"), ident.alias("call_id"), F.concat(F.when(F.col("turn") % 4 == 1, "exit_code: 0\n").otherwise("exit_code: 1\n"), "body").alias("output")).alias("payload")))
    done = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.when(F.col("conv_id") % 3 == 0, "task_complete").when(F.col("conv_id") % 3 == 1, "turn_aborted").otherwise("note").alias("type")).alias("payload")))
    meta = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(sid.alias("id"), F.concat(F.lit("/w/p"), (F.col("conv_id") % 7).cast("string"), F.lit("/")).alias("cwd"), F.lit("cli").alias("source")).alias("payload")))
    path = F.concat(F.lit("archive/rollout-"), sid, F.lit(".jsonl"))
    tenant = (F.col("conv_id") % 8).cast("long").alias("tenant_id")
    body = c.select(tenant, "conv_id", F.lit(0).alias("root_order"), path.alias("path"), (F.col("turn") + 2).cast("long").alias("ordinal"), F.when(tool, output).otherwise(said).alias("line"))
    first = c.where("turn = 0")
    head = first.select(tenant, "conv_id", F.lit(0).alias("root_order"), path.alias("path"), F.lit(0).cast("long").alias("ordinal"), meta.alias("line"))
    junk = first.select(tenant, "conv_id", F.lit(0).alias("root_order"), path.alias("path"), F.lit(1).cast("long").alias("ordinal"), F.lit("{broken").alias("line"))
    tail = first.select(tenant, "conv_id", F.lit(0).alias("root_order"), path.alias("path"), F.lit(1000).cast("long").alias("ordinal"), done.alias("line"))
    every = head.unionByName(junk).unionByName(body).unionByName(tail)
    again = every.where("conv_id % 3 = 0 AND ordinal <> 2").withColumn("root_order", F.lit(1)).withColumn("path", F.replace("path", F.lit("archive/"), F.lit("active/")))
    return every.unionByName(again).drop("conv_id")


_ROLL = """WITH c AS (SELECT *, conv_id % 8 AS tenant_id, concat('s', CAST(conv_id AS VARCHAR)) AS sid, role = 'assistant' AND conv_id % 2 = 1 AS tool FROM conversations),
cl AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' -') AS t FROM c)
"""


@query(_ROLL + """SELECT sid AS session_id, 'root0' AS root, count(*) + 2 AS records FROM c GROUP BY sid UNION ALL SELECT sid, 'root1', count(*) + 1 FROM c WHERE conv_id % 3 = 0 GROUP BY sid""")
def rollout_records(spark, sf_dir):
    r = L.parse_rollouts(rollout_lines(spark, sf_dir))
    return r.groupBy("session_id", F.concat(F.lit("root"), "root_order").alias("root")).agg(F.count("*").alias("records"))


@query(_ROLL + """SELECT sid AS session_id, turn, role, md5(CASE WHEN length(t) <= 640 THEN t ELSE concat(rtrim(substring(t, 1, 639)), '…') END) AS digest FROM cl
WHERE NOT tool AND role IN ('user', 'assistant') AND length(t) >= 2""")
def rollout_messages(spark, sf_dir):
    t = L.session_tables(L.parse_rollouts(rollout_lines(spark, sf_dir)))
    return t.messages.select("session_id", F.regexp_extract("message_id", "-(.*)$", 1).cast("long").alias("turn"), "role", F.md5("text").alias("digest"))


@query("""SELECT conv_id, turn, md5(CASE turn % 4 WHEN 1 THEN concat(text, chr(10), CAST(turn AS VARCHAR)) WHEN 2 THEN concat(text, chr(10), role, chr(10), 'True') ELSE text END) AS digest FROM conversations""")
def nested_payload_texts(spark, sf_dir):
    """Payloads whose deciding field lies three levels deep or more, behind fields without a text."""
    c = given(spark, sf_dir, "conversations")
    text = F.col("text")
    deep = F.struct(F.struct(F.array(F.struct(F.struct(text.alias("value")).alias("message"))).alias("summary")).alias("content"))
    mixed = F.concat(F.lit('{"content":[{"output":{"result":['), F.to_json(F.array("text")), F.lit(","), F.col("turn").cast("string"), F.lit("]}}]}"))
    later = F.concat(F.lit('{"content":{"x":1},"output":['), F.to_json(F.array("text", "role")), F.lit(",true]}"))
    last = F.struct(F.lit("").alias("content"), F.struct(F.lit("").alias("text"), F.struct(text.alias("output")).alias("summary")).alias("item"))
    payload = F.when(F.col("turn") % 4 == 0, F.to_json(deep)).when(F.col("turn") % 4 == 1, mixed)
    payload = payload.when(F.col("turn") % 4 == 2, later).otherwise(F.to_json(last))
    return c.select("conv_id", "turn", F.md5(T.visible_text(payload)).alias("digest"))


@query("SELECT conv_id, turn, md5(CASE turn % 3 WHEN 2 THEN concat('no envelope ', text) ELSE text END) AS digest FROM conversations")
def opened_envelopes(spark, sf_dir):
    """Tool outputs in one or two JSON envelopes, some behind a short note."""
    c = given(spark, sf_dir, "conversations")
    inner = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("result")))
    outer = F.concat(F.lit("note: "), F.to_json(F.struct(inner.alias("output"))), F.lit(" done"))
    text = F.when(F.col("turn") % 3 == 0, inner).when(F.col("turn") % 3 == 1, outer).otherwise(F.concat(F.lit("no envelope "), "text"))
    return c.select("conv_id", "turn", F.md5(T.open_envelopes(text)).alias("digest"))


@query(_ROLL + """SELECT sid AS session_id, turn, NOT regexp_matches(lower(text), 'not allowed|unavailable|permission denied|traceback|command failed') AND turn % 4 = 1 AS verified FROM c WHERE tool""")
def rollout_evidence(spark, sf_dir):
    t = L.session_tables(L.parse_rollouts(rollout_lines(spark, sf_dir)))
    return t.evidence.select("session_id", F.regexp_extract("message_id", "-(.*)$", 1).cast("long").alias("turn"), "verified")


@query(_ROLL + """SELECT sid AS session_id, CASE conv_id % 3 WHEN 0 THEN 'task_complete' WHEN 1 THEN 'turn_aborted' ELSE 'note' END AS event_type FROM c WHERE turn = 0""")
def rollout_events(spark, sf_dir):
    return L.session_tables(L.parse_rollouts(rollout_lines(spark, sf_dir))).events.select("session_id", "event_type")


@query(_ROLL + """, ev AS (SELECT sid, text, row_number() OVER (PARTITION BY sid ORDER BY turn DESC) AS n FROM c WHERE tool),
f AS (SELECT sid, bool_or(contains(CASE WHEN length(x) <= 640 THEN x ELSE substring(x, 1, 639) END, 'error')) AS failing FROM (SELECT *, lower(concat('exit_code: 0 ', trim(regexp_replace(text, '\\s+', ' ', 'g'), ' -'))) AS x FROM ev) WHERE n <= 4 GROUP BY 1)
SELECT DISTINCT c.sid AS session_id, c.tenant_id, concat('p', CAST(conv_id % 7 AS VARCHAR)) AS project, CASE conv_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'blocked' ELSE CASE WHEN coalesce(failing, false) THEN 'blocked' ELSE 'in_progress' END END AS status,
strftime(TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + INTERVAL 8 HOUR, '%Y-%m-%d') AS date,
count(*) FILTER (WHERE NOT tool AND role IN ('user', 'assistant') AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' -')) >= 2) OVER w AS message_count,
count(*) FILTER (WHERE tool AND turn % 4 = 1 AND NOT regexp_matches(lower(text), 'not allowed|unavailable|permission denied|traceback|command failed')) OVER w AS evidence_count,
CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS source_count FROM c LEFT JOIN f USING (sid) WINDOW w AS (PARTITION BY c.sid)""")
def session_summaries(spark, sf_dir):
    from tracemill.operators import sessions as S
    from tracemill.plans.session_queries import WORDS

    t = L.session_tables(L.parse_rollouts(rollout_lines(spark, sf_dir)), store=True)
    titles = t.records.select("tenant_id", "session_id", F.lit("").alias("title")).where("false")
    s = S.session_summaries(t, titles, vocab=WORDS)
    return s.select("session_id", "tenant_id", "project", "status", F.col("date").cast("string").alias("date"), *[F.col(c).cast("long").alias(c) for c in ("message_count", "evidence_count", "source_count")])


@query("SELECT conv_id % 4 AS tenant_id, concat('s', CAST(conv_id AS VARCHAR)) AS session_id, concat('title ', CAST(max(turn) AS VARCHAR)) AS title FROM conversations GROUP BY conv_id")
def rollout_titles(spark, sf_dir):
    c = given(spark, sf_dir, "conversations")
    sid = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    title = F.concat(F.lit("title "), F.col("turn").cast("string"))
    line = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(sid.alias("id"), title.alias("thread_name")))).otherwise(F.to_json(F.struct(sid.alias("thread_id"), title.alias("name"))))
    lines = c.select((F.col("conv_id") % 4).alias("tenant_id"), F.lit("index.jsonl").alias("path"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), line.alias("line"))
    return L.parse_titles(lines)


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, concat('T', CAST(user_id % 7 AS VARCHAR)) AS tool, concat('T', CAST(user_id % 7 AS VARCHAR), ': ', CASE WHEN user_id % 2 = 0 THEN concat('boom ', CAST(event_id AS VARCHAR)) ELSE props END) AS message
FROM events WHERE event_type = 'error'""")
def tool_error_log(spark, sf_dir):
    e = given(spark, sf_dir, "events")
    payload = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"error": "boom '), F.col("event_id").cast("string"), F.lit('"}'))).otherwise(F.col("props"))
    line = F.when(F.col("event_type") == "error", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",599 WARNING x agent.tool_executor: Tool T"), F.col("user_id") % 7, F.lit(" returned error (1s): "), payload)).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO fine")))
    t = E.tool_errors(e.select(F.lit("errors.log").alias("path"), F.col("event_id").alias("ordinal"), line.alias("line")))
    return t.select(F.col("ordinal").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "tool", "message")


@query("""WITH l AS (SELECT event_id, user_id, ts, event_type, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id DESC) AS n FROM events)
SELECT concat('job', CAST(user_id % 5 AS VARCHAR)) AS name, event_id AS ordinal, concat('step FAIL rc=', CAST(user_id AS VARCHAR)) AS err FROM l WHERE n <= 400 AND event_type = 'error' AND CAST(ts AS DATE) = DATE '2024-01-29'""")
def scheduler_failures(spark, sf_dir):
    e = given(spark, sf_dir, "events")
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.when(F.col("event_type") == "error", F.concat(F.lit("step FAIL rc="), F.col("user_id").cast("string"))).otherwise("fine"))
    lines = e.select(F.concat(F.lit("/logs/job"), F.col("user_id") % 5, F.lit(".log")).alias("path"), F.col("event_id").alias("ordinal"), line.alias("line"))
    return E.scheduler_failures(lines, "2024-01-29")


@query("""SELECT concat('e', CAST(event_id AS VARCHAR)) AS event_key, concat('timeout of ', CAST(user_id AS VARCHAR)) AS error_text, strftime(ts, '%Y-%m-%d') AS last_seen, user_id % 3 + 1 AS cnt FROM events WHERE event_type <> 'view'""")
def failure_events(spark, sf_dir):
    e = given(spark, sf_dir, "events")
    what = F.when(F.col("event_type") == "view", "all is well").otherwise(F.concat(F.lit("timeout of "), F.col("user_id").cast("string")))
    rec = F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), what.alias("what"), F.lit("cron").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("user_id") % 3 + 1).alias("count")))
    lines = e.select(F.lit("errors.jsonl").alias("path"), F.col("event_id").alias("ordinal"), rec.alias("line"))
    lines = lines.unionByName(lines.withColumn("ordinal", F.col("ordinal") + 100_000_000)).unionByName(lines.withColumn("line", F.lit("{not json")))
    return E.failure_events(B.parse_error_lines(lines)).select("event_key", "error_text", F.col("last_seen").cast("string").alias("last_seen"), F.col("cnt").cast("long").alias("cnt"))


@query("""SELECT concat('incident:', CAST(DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS VARCHAR), '-', CASE doc_id % 2 WHEN 0 THEN 'timeout' ELSE 'fix' END, CAST(doc_id AS VARCHAR), '.md') AS event_id,
CASE doc_id % 3 WHEN 0 THEN concat('Broken ', lang) ELSE concat(CASE doc_id % 2 WHEN 0 THEN 'timeout' ELSE 'fix' END, CAST(doc_id AS VARCHAR)) END AS error_text FROM documents""")
def incident_notes(spark, sf_dir):
    n = shape(spark, sf_dir, "notes")
    name = F.concat(F.col("day").cast("string"), F.lit("-"), F.when(F.col("doc_id") % 2 == 0, "timeout").otherwise("fix"), F.col("doc_id").cast("string"), F.lit(".md"))
    body = F.concat(F.lit("# 摘要\n"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Broken "), "lang", F.lit("\n"))).otherwise(""), "body")
    return E.incident_notes(n.select(F.concat(F.lit("incidents/"), name).alias("path"), body.alias("body"))).select("event_id", "error_text")


@query("SELECT p_partkey % 4 AS tenant_id, concat('skill ', CAST(p_partkey AS VARCHAR)) AS name, p_size <= 5 AS archived, p_brand = 'Brand#1' AS disabled FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey % 4, concat('d', CAST(p_partkey AS VARCHAR)), p_size <= 5, false FROM part WHERE p_partkey % 2 = 1")
def skill_files(spark, sf_dir):
    p = given(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("/skills/"), F.when(F.col("p_size") <= 5, ".archive/").otherwise(""), F.lit("d"), k, F.lit("/SKILL.md"))
    body = F.concat(F.lit("---\n"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('name: "skill '), k, F.lit('"\n'))).otherwise(""), F.lit("---\ntext\n"), "p_name")
    files = p.select((F.col("p_partkey") % 4).alias("tenant_id"), path.alias("path"), body.alias("body"), F.length(body).alias("size_bytes"), as_of().alias("modified"))
    off = p.where("p_brand = 'Brand#1'").select((F.col("p_partkey") % 4).alias("tenant_id"), F.concat(F.lit("skill "), k).alias("name"))
    return B.parse_skill_files(files, off, as_of()).select("tenant_id", "name", "archived", "disabled")


@query("SELECT doc_id AS session_id, 'missing_field' AS violation FROM documents WHERE length(text) % 7 = 0 UNION ALL SELECT doc_id, 'duplicate_session' FROM documents WHERE lang = 'en'")
def index_violations(spark, sf_dir):
    d = given(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    s = d.select(F.lit(1).alias("tenant_id"), F.col("doc_id").alias("session_id"), F.lit("2024-01-01").cast("date").alias("date"), F.when(F.length("text") % 7 != 0, "t").alias("title"), F.lit("p").alias("project"), F.lit("done").alias("status"),
                 F.lit(1).alias("evidence_count"), *[none.alias(c) for c in ("claims", "verified", "open_items", "decisions", "corrections")], "lang")
    v = I.violations(s.unionByName(s.where("lang = 'en'").withColumn("title", F.lit("t"))).drop("lang"))
    return v


@query("""SELECT doc_id AS session_id, concat('sessions/2024-01-01/', CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE concat('a-', CAST(doc_id AS VARCHAR), '-', substring(sha256(concat('a/', CAST(doc_id AS VARCHAR))), 1, 10)) END, '/memory.md') AS card_path FROM documents""")
def session_cards(spark, sf_dir):
    d = given(spark, sf_dir, "documents")
    sid = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("a/"), F.col("doc_id").cast("string")))
    c = I.session_cards(d.select("doc_id", sid.alias("session_id"), F.lit("2024-01-01").cast("date").alias("date")))
    return c.select(F.col("doc_id").alias("session_id"), "card_path")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source ELSE lang END AS project, CASE doc_id % 3 WHEN 0 THEN strftime(to_timestamp(1700000000 + doc_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') WHEN 1 THEN '2024-01-01 00:00:00' END AS ts,
coalesce(nullif(substring(trim(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}_\\-.]+', '-', 'g'), '-.'), 1, 80), ''), '未识别项目') AS slug, source = concat('src', CAST(doc_id % 20 AS VARCHAR)) AS same FROM documents""")
def scalar_labels(spark, sf_dir):
    d = given(spark, sf_dir, "documents")
    k = F.col("doc_id")
    cwd = F.when(k % 4 == 0, F.concat(F.lit("/home/x/"), "source", F.lit("/"))).otherwise(F.col("lang"))
    raw = F.when(k % 3 == 0, (k + 1700000000).cast("string")).when(k % 3 == 1, "2024-01-01T08:00:00+08:00").otherwise("soon")
    return d.select("doc_id", T.project_name(cwd).alias("project"), F.date_format(K.parse_ts(raw), "yyyy-MM-dd HH:mm:ss").alias("ts"), T.slug(F.col("text")).alias("slug"),
                    K.path_matches(F.concat(F.lit("/a/"), "source"), F.concat(F.lit("src"), (k % 20).cast("string"))).alias("same"))


def _experiences(spark, sf_dir):
    refs = shape(spark, sf_dir, "refs")
    return refs.select(
        F.lit(1).alias("tenant_id"), F.col("memory_id").cast("string").alias("memory_id"), F.lit(1).alias("revision"), F.lit("active").alias("status"), F.lit("fam").alias("task_family"),
        F.when(F.col("memory_id") % 2 == 0, "global").otherwise("/w/p1").alias("scope"), F.lit("when needed").alias("conditions"), F.concat(F.lit("do "), F.col("memory_id").cast("string")).alias("recommended_action"),
        F.lit("haste").alias("avoid"), F.lit("user_explicit").alias("evidence_level"), F.array(F.struct(F.col("path").cast("string").alias("path"), F.col("quote").alias("quote"))).alias("evidence_refs"), as_of().alias("updated_at"))


_EXP = ctes("refs") + ", chk AS (SELECT r.memory_id, coalesce(contains(d.text, r.quote) AND trim(r.quote, E' \\n\\t\\r') <> '', false) AS holds FROM refs r LEFT JOIN documents d ON d.doc_id = r.path)"


@query(_EXP + """ SELECT concat('experience:', CAST(memory_id AS VARCHAR), '@1') AS unit_id, concat('do ', CAST(memory_id AS VARCHAR), chr(10), 'Conditions: when needed', chr(10), 'Avoid: haste') AS text FROM chk WHERE holds""")
def experience_units(spark, sf_dir):
    docs = given(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    kept, _lost = X.checked_heads(_experiences(spark, sf_dir), docs)
    return R.experience_units(kept).select("unit_id", "text")


@query(_EXP + " SELECT CAST(memory_id AS VARCHAR) AS memory_id, 'quotation_lost' AS reason FROM chk WHERE NOT holds")
def evidence_warnings(spark, sf_dir):
    docs = given(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return X.checked_heads(_experiences(spark, sf_dir), docs)[1].select("memory_id", "reason")


@query(_EXP + """ SELECT concat('experience:', CAST(memory_id AS VARCHAR), '@1') AS unit_id FROM chk WHERE holds AND memory_id % 2 = 0 UNION ALL SELECT CAST(session_id AS VARCHAR) FROM (SELECT doc_id AS session_id, source FROM documents) WHERE source = 'src3'""")
def units_in_scope(spark, sf_dir):
    docs = given(spark, sf_dir, "documents")
    kept, _lost = X.checked_heads(_experiences(spark, sf_dir), docs.select(F.col("doc_id").cast("string").alias("path"), "text"))
    lessons = R.experience_units(kept)
    said = docs.select(F.col("doc_id").cast("string").alias("unit_id"), F.lit("session").alias("source_type"), F.concat(F.lit("/deep/"), "source").alias("cwd"), F.lit("").alias("project"), F.lit(None).cast("string").alias("scope"), F.lit("fam").alias("task_family"))
    every = lessons.select(*said.columns).unionByName(said)
    return every.where(R.in_scope("src3", "fam")).select("unit_id")
