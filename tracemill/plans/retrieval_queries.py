"""Queries over summaries, units, vectors and experience."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import keys as K
from tracemill.operators import experience as X
from tracemill.operators import recall as C
from tracemill.operators import retrieval as R
from tracemill.operators import sessions as S
from tracemill.plans.adapters import ctes, given, shape
from tracemill.plans.registry import query


def as_of():
    return F.lit("2024-03-15").cast("timestamp")


_LISTS = (("goal", "goal_text"), ("claims", "claim_text"), ("verified", "verified_text"), ("open_items", "open_text"), ("decisions", "decision_text"), ("corrections", "correction_text"))


def _summaries(spark, sf_dir):
    s = shape(spark, sf_dir, "summaries")
    return s.select("tenant_id", "session_id", "date", "updated", "project", "status", "title", F.lit("").alias("cwd"), *[
        F.filter(F.array(c), lambda t: t != "").alias(n) for n, c in _LISTS])


def _questions(spark, sf_dir):
    b = given(spark, sf_dir, "benchmark")
    return b.select((F.col("item_id") % 4).alias("tenant_id"), F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_RECALL = ctes("summaries") + """, q AS (SELECT item_id % 4 AS tenant_id, item_id AS query_id, lower(trim(text, E' \n\t\r')) AS query FROM benchmark),
f AS (SELECT tenant_id, session_id, status, date, updated, lower(project) AS p, lower(title) AS t, lower(goal_text) AS g, lower(claim_text) AS c, lower(verified_text) AS v, lower(open_text) AS o,
  lower(decision_text) AS d, lower(correction_text) AS r FROM summaries),
s AS (SELECT q.tenant_id, q.query_id, f.session_id, date, updated, status,
  4 * list_sum(list_transform(string_split_regex(query, '\\s+'), lambda w: CASE WHEN contains(concat_ws(' ', p, t, g, c, v, o, d, r), w) THEN 1 ELSE 0 END)) AS words,
  40 * contains(p, query)::INT + 24 * contains(t, query)::INT + 18 * contains(g, query)::INT + 4 * contains(c, query)::INT + 20 * contains(v, query)::INT + 12 * contains(o, query)::INT
  + 24 * contains(d, query)::INT + 32 * contains(r, query)::INT AS fields FROM q JOIN f USING (tenant_id)),
z AS (SELECT tenant_id, query_id, session_id, date, updated, CAST(words + fields + CASE WHEN status <> 'done' THEN 8 ELSE 0 END + greatest(0, 10 - least(date_diff('day', date, DATE '2024-03-15'), 10)) AS BIGINT) AS score
  FROM s WHERE words > 0)
SELECT * EXCLUDE (date, updated), row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY score DESC, date DESC, updated DESC, session_id DESC) AS position FROM z QUALIFY position <= 5"""


_CLEAN = "trim(regexp_replace(raw, '\\s+', ' ', 'g'), ' -')"


@query(_RECALL)
def recall_by_words(spark, sf_dir):
    return C.recall(_summaries(spark, sf_dir), _questions(spark, sf_dir), as_of=as_of())


def _clip(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) <= {n} THEN {text} ELSE concat(rtrim(substring({text}, 1, {n - 1})), '…') END"


def _shown(raw: str, n: int) -> str:
    return _clip(f"({_CLEAN.replace('raw', raw)})", n)


def _line(raw: str, label: str, n: int, only: str = "true") -> str:
    return f"CASE WHEN {raw} <> '' AND {only} THEN [concat('{label}', {_clip('(' + _shown(raw, 200) + ')', n)})] ELSE [] END"


# at most five hits a question: the lines that fit are a prefix, and what is left goes from hit to hit
_TEXTS = f"""WITH RECURSIVE hits AS ({_RECALL}), {ctes('summaries').removeprefix('WITH ')},
b AS (SELECT h.tenant_id, h.query_id, h.position, concat('  卡片：sessions/', CAST(s.date AS VARCHAR), '/', CAST(s.session_id AS VARCHAR), '/memory.md') AS card,
  list_concat([concat('- [', status, '] ', {_shown('s.title', 90)}, ' · ', {_shown('s.project', 70)}, ' · ', CAST(s.date AS VARCHAR), ' · score=', CAST(score AS VARCHAR))],
    {_line('correction_text', '  用户纠正候选：', 180)}, {_line('decision_text', '  决策摘录（需核对来源）：', 160)}, {_line('verified_text', '  工具证据信号（非任务验收）：', 200)},
    {_line('claim_text', '  未验证助手声明（仅供定位）：', 140, "verified_text = ''")}, {_line('open_text', '  待办：', 140)}) AS lines
  FROM hits h JOIN summaries s USING (tenant_id, session_id)),
l AS (SELECT *, list_transform(range(1, len(lines) + 1), lambda i: list_sum(list_transform(lines[1:i], lambda x: length(x) + 1))) AS used FROM b),
f AS (
  SELECT tenant_id, query_id, 0::BIGINT AS position, 4800::BIGINT AS room, ''::VARCHAR AS text FROM (SELECT DISTINCT tenant_id, query_id FROM l)
  UNION ALL
  SELECT tenant_id, query_id, position, room - length(block) - 1, concat(text, CASE WHEN text = '' THEN '' ELSE chr(10) END, block) FROM (
    SELECT f.tenant_id, f.query_id, l.position, f.room, f.text, array_to_string(list_append(lines[1:n], card), chr(10)) AS block
    FROM (SELECT * FROM f) f JOIN (SELECT * FROM l) l ON l.tenant_id = f.tenant_id AND l.query_id = f.query_id AND l.position = f.position + 1,
    LATERAL (SELECT len(list_filter(used, lambda u: u <= least(1000, f.room) - length(card) - 1)) AS n) WHERE n > 0))
SELECT tenant_id, query_id, arg_max(text, position) AS text FROM f GROUP BY ALL"""


@query(_TEXTS)
def recall_texts(spark, sf_dir):
    s = _summaries(spark, sf_dir)
    return R.recall_blocks(C.recall(s, _questions(spark, sf_dir), as_of=as_of()), s)


@query(ctes("summaries") + f""", i AS (SELECT session_id, unnest([1,2,3,4,5,6]) AS pos, unnest(['correction','decision','verified','goal','open_item','claim_unverified']) AS unit_kind,
  unnest([correction_text, decision_text, verified_text, goal_text, open_text, claim_text]) AS raw FROM summaries),
t AS (SELECT *, CASE WHEN length(c) <= 640 THEN c ELSE concat(rtrim(substring(c, 1, 639)), '…') END AS text FROM (SELECT *, {_CLEAN} AS c FROM i))
SELECT session_id, unit_kind, md5(text) AS digest FROM t WHERE text <> ''""")
def session_units(spark, sf_dir):
    s = _summaries(spark, sf_dir)
    u = R.session_units(s.select("tenant_id", "session_id", "date", "updated", "project", "title", "cwd", *[n for n, _ in _LISTS]))
    return u.where("unit_kind <> 'session_context'").select(F.col("source_session_id").cast("long").alias("session_id"), "unit_kind", F.md5("text").alias("digest"))


def _vectors(spark, sf_dir):
    v = shape(spark, sf_dir, "vectors")
    kind = F.when(F.col("kind") == 0, "correction").when(F.col("kind") == 1, "claim_unverified").when(F.col("kind") == 2, "decision").otherwise("goal")
    text = F.concat(F.lit("Kind "), F.col("kind").cast("string"), F.lit("  turn-"), (F.col("unit_id") % 7).cast("string"))
    return v.select("unit_id", kind.alias("unit_kind"), F.col("source_id").alias("source_session_id"), F.lit(None).cast("string").alias("memory_id"), text.alias("text"), "embedding")


# every vector whose id is divisible by 20 asks; units of source 13 are out of scope
_SEARCH = ctes("vectors") + """, u AS (SELECT *, concat('kind ', CAST(kind AS VARCHAR), ' turn-', CAST(unit_id % 7 AS VARCHAR)) AS t FROM vectors WHERE source_id <> 13),
q AS (SELECT unit_id AS query_id, embedding AS qe, [concat('turn-', CAST(unit_id // 20 % 7 AS VARCHAR)), 'kind', 'nowhere'] AS terms FROM vectors WHERE unit_id % 20 = 0),
s AS (SELECT q.query_id, u.unit_id, u.source_id, t, list_inner_product(CAST(u.embedding AS DOUBLE[]), CAST(q.qe AS DOUBLE[])) AS sim,
  0.08 * list_sum(list_transform(terms, lambda w: CASE WHEN contains(t, w) THEN 1 ELSE 0 END)) / 3 + CASE kind WHEN 0 THEN 0.035 WHEN 1 THEN -0.06 WHEN 2 THEN 0.015 ELSE 0.0 END AS bonus FROM q, u),
h AS (SELECT *, sim + bonus AS sc FROM s WHERE sim >= {limit}),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, source_id, t ORDER BY sc DESC, unit_id) = 1),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY sc DESC, unit_id) <= 2)
SELECT query_id, unit_id, round(sim, 6) AS similarity, round(sc, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, unit_id) AS position FROM f QUALIFY position <= 20"""


def _search(spark, sf_dir, limit):
    v = _vectors(spark, sf_dir)
    asked = v.where("unit_id % 20 = 0").select(F.col("unit_id").alias("query_id"), F.concat(F.lit("Turn-"), (F.floor(F.col("unit_id") / 20) % 7).cast("string"), F.lit(" kind NOWHERE")).alias("text"), "embedding")
    hits = R.vector_search(v, asked, min_similarity=limit, k=20, scope=F.col("source_session_id") != 13)
    return hits.select("query_id", "unit_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "position")


@query(_SEARCH.replace("{limit}", "0.15"))
def vector_search(spark, sf_dir):
    return _search(spark, sf_dir, 0.15)


@query(_SEARCH.replace("{limit}", "0.72"))
def vector_search_default_limit(spark, sf_dir):
    return _search(spark, sf_dir, 0.72)


def _fingerprint():
    return K.model_fingerprint(2, "memory-units-v1", "r1")


def _text_units(spark, sf_dir):
    d = given(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", F.lit("claim_unverified").alias("unit_kind"), F.lit("x").alias("evidence_level"), "text", F.lit("").alias("project"), F.lit("").alias("title"))


def _cache(spark, sf_dir):
    docs = R.unit_documents(_text_units(spark, sf_dir), _fingerprint())
    good = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: i.cast("float"))
    return docs.where("lang = 'en'").select("content_hash", F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(float("nan")).cast("float"))).otherwise(good).alias("embedding"), _fingerprint().alias("fingerprint"))


@query("""WITH c AS (SELECT text, bool_or(doc_id % 5 <> 0) AS ok FROM documents WHERE lang = 'en' GROUP BY 1)
SELECT count(*) AS missing, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT DISTINCT text FROM documents) d ANTI JOIN c ON c.text = d.text AND c.ok""")
def vectors_to_encode(spark, sf_dir):
    known = R.valid_cache(_cache(spark, sf_dir), _fingerprint())
    skip = len("passage: claim_unverified [x]\n") + len("\nProject: ") + len("\nTask: ")
    missing = R.missing_documents(R.unit_documents(_text_units(spark, sf_dir), _fingerprint()), known)
    return missing.agg(F.count("*").alias("missing"), F.sum(F.length("document") - skip).alias("chars"))


@query("SELECT doc_id, 256 AS dim FROM documents")
def embedded_units(spark, sf_dir):
    none = _cache(spark, sf_dir).where("false")
    units, _new = R.embed(_text_units(spark, sf_dir), R.hashing_encoder(256), none, _fingerprint())
    return units.select("doc_id", F.size("embedding").alias("dim"))


@query(ctes("vectors") + "SELECT unit_id, len(embedding) AS dim FROM vectors WHERE list_bool_and(list_transform(embedding, lambda x: isfinite(x)))")
def valid_cached_vectors(spark, sf_dir):
    v = shape(spark, sf_dir, "vectors").withColumn("fingerprint", F.lit("f"))
    return R.valid_cache(v, F.lit("f")).select("unit_id", F.size("embedding").alias("dim"))


# ---- experience -----------------------------------------------------------------------------------------------------
@query(ctes("versions") + "SELECT memory_id, max(revision) AS revision, arg_max(status, revision) AS status FROM versions GROUP BY 1")
def experience_heads(spark, sf_dir):
    return X.heads(shape(spark, sf_dir, "versions")).select("memory_id", F.col("revision").cast("long").alias("revision"), "status")


@query(ctes("versions") + "SELECT memory_id, status FROM (SELECT memory_id, arg_max(status, revision) AS status FROM versions GROUP BY 1) WHERE status IN ('active', 'candidate')")
def loaded_experiences(spark, sf_dir):
    return X.load_experiences(shape(spark, sf_dir, "versions"), include_candidates=True).select("memory_id", "status")


@query(ctes("versions") + """SELECT memory_id, revision, lag(revision) OVER (PARTITION BY memory_id ORDER BY revision) AS parent_revision,
lead(revision) OVER (PARTITION BY memory_id ORDER BY revision) IS NOT NULL AS closed FROM versions""")
def version_history(spark, sf_dir):
    h = X.version_history(shape(spark, sf_dir, "versions"))
    return h.select("memory_id", F.col("revision").cast("long").alias("revision"), F.col("parent_revision").cast("long").alias("parent_revision"), "closed")


def _docs(spark, sf_dir):
    return given(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")


_REFS = ctes("refs") + ", chk AS (SELECT r.memory_id, r.path, coalesce(contains(d.text, r.quote) AND trim(r.quote, E' \\n\\t\\r') <> '', false) AS holds FROM refs r LEFT JOIN documents d ON d.doc_id = r.path)"


@query(_REFS + " SELECT * FROM chk")
def checked_evidence(spark, sf_dir):
    return X.checked_refs(shape(spark, sf_dir, "refs"), _docs(spark, sf_dir)).select("memory_id", "path", "holds")


@query(_REFS + " SELECT memory_id, count(*) AS lost FROM chk WHERE NOT holds GROUP BY 1")
def lost_evidence(spark, sf_dir):
    return X.lost_evidence(X.checked_refs(shape(spark, sf_dir, "refs"), _docs(spark, sf_dir)))


_A9 = ctes("receipts", "retrievals", "feedback", "versions") + """,
ret AS (SELECT r.task_id, v.memory_id FROM retrievals v JOIN receipts r USING (receipt_id)),
fb AS (SELECT r.task_id, f.outcome, f.receipt_id AS seq FROM feedback f JOIN receipts r USING (receipt_id)),
app AS (SELECT r.task_id, l_partkey AS memory_id FROM lineitem JOIN receipts r ON r.receipt_id = l_orderkey WHERE l_returnflag = 'R'),
pt AS (SELECT task_id, count(*) AS n, arg_max(outcome, seq) AS latest, bool_or(outcome = 'failed') AS fa, bool_or(outcome = 'unknown') AS un, bool_or(outcome = 'user_accepted') AS ua, bool_or(outcome = 'verified_success') AS vs FROM fb GROUP BY 1)
"""


def _ledger(spark, sf_dir):
    r = shape(spark, sf_dir, "receipts")
    ret = shape(spark, sf_dir, "retrievals").join(r, "receipt_id").select("task_id", "memory_id")
    fb = shape(spark, sf_dir, "feedback").join(r, "receipt_id").select("task_id", "outcome", F.col("receipt_id").alias("seq"))
    line = given(spark, sf_dir, "lineitem")
    app = line.where("l_returnflag = 'R'").join(r, F.col("receipt_id") == F.col("l_orderkey")).select("task_id", F.col("l_partkey").alias("memory_id"))
    return r, ret, fb, app


@query(_A9 + """SELECT (SELECT count(*) FROM (SELECT arg_max(status, revision) AS s FROM versions GROUP BY memory_id) WHERE s = 'active') AS active_memories,
(SELECT count(*) FROM (SELECT arg_max(status, revision) AS s FROM versions GROUP BY memory_id) WHERE s = 'candidate') AS candidate_memories,
(SELECT count(*) FROM receipts) AS retrieval_receipts, (SELECT count(DISTINCT task_id) FROM receipts) AS retrieval_tasks,
(SELECT count(*) FROM (SELECT DISTINCT * FROM ret)) AS retrieved_memory_uses, (SELECT count(*) FROM (SELECT DISTINCT * FROM app)) AS applied_memory_uses,
(SELECT count(DISTINCT task_id) FROM app) AS applied_tasks, (SELECT count(*) FROM fb) AS feedback_observations,
count(*) FILTER (WHERE fa) AS tasks_failed, count(*) FILTER (WHERE un) AS tasks_unknown, count(*) FILTER (WHERE ua) AS tasks_user_accepted, count(*) FILTER (WHERE vs) AS tasks_verified_success,
count(*) FILTER (WHERE vs OR ua) AS ever_accepted_tasks, count(*) FILTER (WHERE latest IN ('verified_success', 'user_accepted')) AS latest_accepted_tasks,
(SELECT count(DISTINCT task_id) FROM receipts WHERE task_id NOT IN (SELECT task_id FROM fb)) AS tasks_without_feedback FROM pt""")
def experience_stats(spark, sf_dir):
    r, ret, fb, app = _ledger(spark, sf_dir)
    return X.experience_stats(shape(spark, sf_dir, "versions"), r, ret, fb, app)


@query(_A9 + "SELECT task_id, latest AS outcome FROM pt")
def latest_feedback(spark, sf_dir):
    return X.latest_feedback(_ledger(spark, sf_dir)[2])


@query(_A9 + "SELECT DISTINCT task_id FROM receipts WHERE task_id NOT IN (SELECT task_id FROM fb WHERE outcome = 'user_accepted')")
def tasks_without_acceptance(spark, sf_dir):
    r, _ret, fb, _app = _ledger(spark, sf_dir)
    fb = fb.where("outcome = 'user_accepted'")
    return r.select("task_id").distinct().join(fb.select("task_id"), "task_id", "left_anti")


_APPLIED = ctes("receipts", "feedback") + """, app AS (SELECT l_partkey AS memory_id, 1 AS revision, r.task_id, coalesce(f.outcome, 'unknown') AS outcome, l_orderkey AS seq, concat('fix ', CAST(l_suppkey % 10 AS VARCHAR)) AS c
  FROM lineitem JOIN receipts r ON r.receipt_id = l_orderkey LEFT JOIN feedback f ON f.receipt_id = l_orderkey WHERE l_returnflag = 'R'),
n AS (SELECT memory_id, c, max(seq) AS newest FROM app GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY newest DESC, c) AS nth FROM n QUALIFY nth <= 3)
SELECT a.memory_id, count(DISTINCT task_id) AS applied_tasks, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'unknown') AS unknown,
count(*) FILTER (WHERE outcome = 'user_accepted') AS user_accepted, count(*) FILTER (WHERE outcome = 'verified_success') AS verified_success,
(SELECT string_agg(c, '|' ORDER BY nth) FROM k WHERE k.memory_id = a.memory_id) AS recent FROM app a GROUP BY 1"""


@query(_APPLIED)
def memory_observations(spark, sf_dir):
    r = shape(spark, sf_dir, "receipts")
    line = given(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(r, F.col("receipt_id") == F.col("l_orderkey"))
    app = line.join(shape(spark, sf_dir, "feedback").select("receipt_id", "outcome"), "receipt_id", "left").select(
        F.col("l_partkey").alias("memory_id"), F.lit(1).alias("revision"), "task_id", F.coalesce("outcome", F.lit("unknown")).alias("outcome"), F.col("l_orderkey").alias("seq"),
        F.array(F.concat(F.lit("fix "), F.col("l_suppkey") % 10)).alias("corrections"))
    o = X.memory_observations(app)
    return o.select("memory_id", "applied_tasks", "failed", "unknown", "user_accepted", "verified_success", F.array_join("recent_corrections", "|").alias("recent"))


def _round(k: int) -> str:
    """The k-th item taken of each task: the next one in rank that still fits."""
    before = f"g{k - 1}" if k > 1 else "(SELECT DISTINCT task_id, 0::BIGINT AS n, 0::BIGINT AS used FROM r)"
    gap = 2 if k > 1 else 0
    return f"""
g{k} AS (SELECT b.task_id, r.n, r.memory_id, b.used + r.size + {gap} AS used, {k} AS position FROM {before} b JOIN r ON r.task_id = b.task_id AND r.n > b.n AND b.used + r.size + {gap} <= 2400
  QUALIFY row_number() OVER (PARTITION BY b.task_id ORDER BY r.n) = 1)"""


_BRIEF = """WITH t AS (SELECT item_id AS task_id, concat('src', CAST(item_id % 20 AS VARCHAR)) AS project, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_-]{2,}')) AS terms FROM benchmark),
tt AS (SELECT task_id, project, len(terms) AS n_terms, unnest(terms) AS term FROM t),
e AS (SELECT doc_id AS memory_id, CASE WHEN doc_id % 3 = 0 THEN 'global' ELSE source END AS scope, length(text) AS size, list_distinct(regexp_extract_all(lower(concat_ws(' ', substring(text, 1, 60), text, lang)), '[a-z0-9_-]{2,}')) AS terms FROM documents),
et AS (SELECT memory_id, scope, size, unnest(terms) AS term FROM e),
p AS (SELECT task_id, memory_id, any_value(size) AS size, count(*) / any_value(n_terms) + CASE WHEN any_value(scope) = any_value(project) THEN 0.1 ELSE 0.0 END AS score FROM (
  SELECT * FROM tt JOIN et ON et.term = tt.term AND et.scope = tt.project UNION ALL SELECT * FROM tt JOIN et ON et.term = tt.term AND et.scope = 'global') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, memory_id) AS n FROM p),""" + ",".join(map(_round, range(1, 6))) + """
SELECT task_id, memory_id, position FROM (""" + " UNION ALL ".join(f"SELECT task_id, memory_id, position FROM g{k}" for k in range(1, 6)) + ")"


@query(_BRIEF)
def task_briefs(spark, sf_dir):
    tasks = given(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("task_id"), F.col("text").alias("query"), F.lit("").alias("family"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("project"))
    d = given(spark, sf_dir, "documents")
    e = d.select(
        F.col("doc_id").alias("memory_id"), F.lit(1).alias("revision"), F.when(F.col("doc_id") % 3 == 0, "global").otherwise(F.col("source")).alias("scope"), F.lit("").alias("task_family"),
        F.substring("text", 1, 60).alias("conditions"), F.col("text").alias("recommended_action"), F.col("lang").alias("avoid"), F.col("text").alias("chunk"))
    return X.brief(tasks, e)[0].select("task_id", "memory_id", "position")


def _requests(spark, sf_dir, revision):
    d = given(spark, sf_dir, "documents")
    k = F.col("doc_id")
    level = F.when(k % 4 == 0, "unverified").when(k % 4 == 1, "bad").otherwise("user_explicit")
    quote = F.when(k % 10 == 7, F.lit("no such quote")).otherwise(F.substring("text", 5, 40))
    return d.select(
        k.alias("pos"), F.concat(F.lit("m"), k.cast("string")).alias("memory_id"), F.lit("f").alias("task_family"), F.col("source").alias("scope"), F.lit("").alias("conditions"),
        F.concat(F.lit("do "), F.lit(str(revision))).alias("recommended_action"), F.lit("").alias("avoid"), level.alias("evidence_level"),
        F.when(k % 8 == 4, "active").alias("status"), F.array(F.struct(k.cast("string").alias("path"), quote.alias("quote"))).alias("evidence_refs"),
        F.when(k % 6 == 0, F.lit(None)).otherwise(F.lit(revision - 1)).cast("int").alias("expected_revision"), F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("int").alias("supersedes_revision"))


EXPERIENCE = ("memory_id string, revision int, parent_revision int, task_family string, scope string, conditions string, recommended_action string, avoid string, "
              "evidence_level string, status string, superseded_by string, evidence_refs array<struct<path:string,quote:string>>, source_count int, updated_at timestamp")


@query("""WITH b AS (SELECT doc_id AS k, text, CASE WHEN doc_id % 4 = 1 OR doc_id % 8 = 4 THEN 1 WHEN doc_id % 10 = 7 OR trim(substring(text, 5, 40), E' \\n\\t\\r') = '' THEN 2 ELSE 0 END AS bad FROM documents)
SELECT concat('m', CAST(k AS VARCHAR)) AS memory_id, rev AS revision, CASE WHEN k % 4 = 0 THEN 'candidate' ELSE 'active' END AS verdict FROM b, (SELECT unnest([1, 2]) AS rev) WHERE bad = 0 AND (rev = 1 OR k % 6 <> 0)
UNION ALL SELECT concat('m', CAST(k AS VARCHAR)), rev, CASE WHEN k % 4 = 1 THEN 'unsupported_level_or_status' WHEN k % 8 = 4 THEN 'unverified_must_be_candidate' WHEN bad = 2 THEN 'quotation_not_found' ELSE 'stale_revision' END
FROM b, (SELECT unnest([1, 2]) AS rev) WHERE bad > 0 OR (rev = 2 AND k % 6 = 0)""")
def remembered_experience(spark, sf_dir):
    """Two rounds of writes; the second one changes every memory and is refused where it does not name the revision."""
    docs = _docs(spark, sf_dir).withColumn("path", F.col("path").cast("string"))
    versions = spark.createDataFrame([], EXPERIENCE)
    parts = []
    for rev in (1, 2):
        new, refused = X.remember(versions, _requests(spark, sf_dir, rev), docs, as_of())
        parts += [new.select("memory_id", "revision", F.col("status").alias("verdict")), refused.select("memory_id", F.lit(rev).alias("revision"), F.col("reason").alias("verdict"))]
        versions = versions.unionByName(new)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 7 = 0 THEN 'unsupported_outcome' WHEN o_orderkey % 5 = 0 THEN 'no_observed_actions' WHEN o_orderkey % 3 = 0 THEN 'no_receipt_for_task'
 WHEN o_orderkey % 2 = 0 THEN 'applied_not_retrieved' ELSE 'accepted' END AS verdict FROM orders""")
def recorded_feedback(spark, sf_dir):
    o = given(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    receipts = o.select(
        F.concat(F.lit("t"), "o_custkey").alias("task_id"), F.concat(F.lit("r"), k).alias("receipt_id"), F.array(F.lit("a"), F.lit("b")).alias("retrieved_ids"),
        F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)).alias("revisions"), F.col("o_orderdate").alias("created_at"))
    batch = o.select(
        k.alias("pos"), F.when(k % 3 == 0, F.lit("other")).otherwise(F.concat(F.lit("t"), "o_custkey")).alias("task_id"), F.concat(F.lit("r"), k).alias("receipt_id"),
        F.when(k % 7 == 0, "great").alias("outcome_status"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("a"))).alias("applied_memory_ids"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("ran"))).alias("observed_actions"), F.array().cast("array<string>").alias("user_corrections"),
        F.array().cast("array<struct<path:string,quote:string>>").alias("evidence_refs"))
    known = spark.createDataFrame([], "feedback_id string")
    docs = spark.createDataFrame([], "path string, text string")
    new, refused = X.record_feedback(receipts, known, batch, docs, as_of())
    return new.select("pos", F.lit("accepted").alias("verdict")).unionByName(refused.select("pos", F.col("reason").alias("verdict")))


# ---- summaries index ------------------------------------------------------------------------------------------------
@query(ctes("summaries") + """SELECT tenant_id, CAST(date AS VARCHAR) AS date, count(*) AS sessions, CAST(sum(session_id % 4) AS BIGINT) AS evidence, count(*) FILTER (WHERE status <> 'done') AS unfinished FROM summaries GROUP BY ALL""")
def rollup_by_day(spark, sf_dir):
    s = _summaries(spark, sf_dir).withColumn("evidence_count", F.col("session_id") % 4)
    return S.rollup_by_day(s).select("tenant_id", F.col("date").cast("string").alias("date"), "sessions", "evidence", "unfinished")


@query(ctes("summaries") + """SELECT tenant_id, project, count(*) AS sessions, CAST(max(date) AS VARCHAR) AS latest_date, CAST(sum(session_id % 4) AS BIGINT) AS evidence FROM summaries GROUP BY ALL""")
def rollup_by_project(spark, sf_dir):
    s = _summaries(spark, sf_dir).withColumn("evidence_count", F.col("session_id") % 4)
    return S.rollup_by_project(s).withColumn("latest_date", F.col("latest_date").cast("string"))


@query(ctes("summaries") + """SELECT tenant_id, project, session_id, row_number() OVER (PARTITION BY tenant_id, project ORDER BY updated DESC, session_id DESC) AS position FROM summaries QUALIFY position <= 12""")
def project_recent_sessions(spark, sf_dir):
    s = _summaries(spark, sf_dir).withColumn("evidence_count", F.lit(0))
    return S.project_recent(s).select("tenant_id", "project", "session_id", "position")


@query(ctes("summaries") + """SELECT session_id, 'decision' AS kind, decision_text AS item FROM summaries WHERE decision_text <> '' UNION ALL SELECT session_id, 'correction', correction_text FROM summaries WHERE correction_text <> ''
UNION ALL SELECT session_id, 'open', CASE WHEN open_text <> '' THEN open_text ELSE '状态仍未终结，请查看验证证据。' END FROM summaries WHERE status <> 'done'""")
def rollup_items(spark, sf_dir):
    s = _summaries(spark, sf_dir)
    parts = [S.rollup_items(s, f).select("session_id", F.lit(k).alias("kind"), "item") for k, f in (("decision", "decisions"), ("correction", "corrections"), ("open", "open_items"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(ctes("summaries") + """SELECT tenant_id, count(*) AS sessions, count(DISTINCT project) AS projects, count(*) FILTER (WHERE status <> 'done') AS unfinished, count(*) FILTER (WHERE verified_text <> '') AS with_evidence FROM summaries GROUP BY 1""")
def index_totals(spark, sf_dir):
    return S.index_totals(_summaries(spark, sf_dir))


def _rebuild(spark, sf_dir):
    """The index and a rebuild of it: every tenth session lost, every seventh new, others older, shorter or changed."""
    k = F.col("session_id")
    s = _summaries(spark, sf_dir).withColumn("artifacts", F.array().cast("array<string>")).withColumn("evidence_count", F.lit(1)).withColumn("source_count", F.lit(1)).withColumn("count_quality", F.lit("exact"))
    old = s.where(k % 7 != 0).withColumn("message_count", F.lit(10))
    new = s.where(k % 10 != 0).withColumn("message_count", F.when(k % 4 == 1, 3).otherwise(12)).withColumn(
        "updated", F.col("updated") + F.make_dt_interval(F.when(k % 3 == 0, -1).when(k % 3 == 1, 0).otherwise(1))).withColumn("claims", F.array(F.lit("new claim")))
    return old, new


_MERGE = ctes("summaries") + """, m AS (SELECT session_id AS k, claim_text, CASE WHEN session_id % 10 = 0 AND session_id % 7 = 0 THEN NULL WHEN session_id % 7 = 0 THEN 'new' WHEN session_id % 10 = 0 THEN 'missing_source'
  WHEN session_id % 3 = 0 THEN 'kept' WHEN session_id % 4 = 1 AND session_id % 3 = 1 THEN 'kept' WHEN session_id % 4 = 1 THEN 'appended' ELSE 'replaced' END AS action FROM summaries)
"""


@query(_MERGE + """SELECT k AS session_id, action, CASE WHEN action IN ('missing_source', 'kept', 'appended') THEN 10 WHEN k % 4 = 1 THEN 3 ELSE 12 END AS message_count,
CASE action WHEN 'appended' THEN 'lower_bound_partial_source' ELSE 'exact' END AS count_quality,
md5(CASE WHEN action IN ('missing_source', 'kept') THEN claim_text WHEN action = 'appended' THEN concat(claim_text, '|new claim') ELSE 'new claim' END) AS claims FROM m WHERE action IS NOT NULL""")
def merged_summaries(spark, sf_dir):
    old, new = _rebuild(spark, sf_dir)
    return S.merge_summaries(old, new).select("session_id", "action", "message_count", "count_quality", F.md5(F.array_join("claims", "|")).alias("claims"))


@query(_MERGE + """SELECT k AS session_id, t AS turn_id FROM m, (VALUES ('a', 1), ('b', 3), ('c', 2)) v(t, side) WHERE action IS NOT NULL AND (action = 'appended' OR side = 3
  OR side = CASE WHEN action IN ('kept', 'missing_source') THEN 1 ELSE 2 END)""")
def merged_session_turns(spark, sf_dir):
    old, new = _rebuild(spark, sf_dir)
    turns = lambda s, *ids: s.select("tenant_id", "session_id", F.explode(F.array(*map(F.lit, ids))).alias("turn_id"))
    return S.merge_session_rows(turns(old, "a", "b"), turns(new, "b", "c"), S.merge_summaries(old, new)).select("session_id", "turn_id")


@query(_MERGE + """SELECT count(*) AS indexed_sessions, count(*) FILTER (WHERE action <> 'missing_source') AS source_sessions, count(*) FILTER (WHERE action = 'missing_source') AS retained_missing_source,
count(*) FILTER (WHERE action IN ('kept', 'appended')) AS retained_partial_source FROM m WHERE action IS NOT NULL""")
def index_health(spark, sf_dir):
    return S.index_health(S.merge_summaries(*_rebuild(spark, sf_dir)), as_of()).drop("checked_at")
