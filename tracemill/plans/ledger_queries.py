"""Queries over the proposal ledger and reviews. Orders stand for proposals, line items for references to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import proposals as P
from tracemill.operators import reviews as V
from tracemill.plans.adapters import ctes, given, shape
from tracemill.plans.registry import query


def as_of():
    return F.lit("2024-03-15").cast("timestamp")


_PROPOSALS = """SELECT o_custkey % 16 AS tenant_id, o_orderkey AS pos, concat('P', CASE WHEN o_orderkey // 2 % 9000 < 1000 THEN lpad(CAST(o_orderkey // 2 % 9000 AS VARCHAR), 3, '0') ELSE CAST(o_orderkey // 2 % 9000 AS VARCHAR) END) AS id, concat('u', CAST(o_orderkey AS VARCHAR)) AS uid,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'retire' WHEN o_orderpriority LIKE '2%' THEN 'fix_reference' ELSE 'enhance' END AS kind,
  concat(CASE o_orderkey % 3 WHEN 0 THEN 'hermes-agent' WHEN 1 THEN 'zh-copy-preflight' ELSE 'skill-' END, CAST(o_custkey AS VARCHAR)) AS target,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'approved' END AS status FROM orders"""
_P = f"WITH props AS ({_PROPOSALS})"


def _props(spark, sf_dir):
    o = given(spark, sf_dir, "orders")
    k, pri = F.col("o_orderkey"), F.col("o_orderpriority")
    number = (F.floor(k / 2) % 9000).cast("string")
    stem = F.when(k % 3 == 0, "hermes-agent").when(k % 3 == 1, "zh-copy-preflight").otherwise("skill-")
    return o.select(
        (F.col("o_custkey") % 16).alias("tenant_id"), k.alias("pos"), F.concat(F.lit("P"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("id"),
        F.concat(F.lit("u"), k.cast("string")).alias("uid"), F.lit(None).cast("string").alias("legacy_id"),
        F.when(pri.startswith("1"), "retire").when(pri.startswith("2"), "fix_reference").otherwise("enhance").alias("kind"), F.concat(stem, F.col("o_custkey").cast("string")).alias("target"),
        F.lit("because").alias("reason"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"),
        F.to_date("o_orderdate").alias("created"), F.lit(None).cast("date").alias("resolved"), F.array().cast(P._HISTORY).alias("status_history"))


_REPAIRED = _P + """, fl AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, id ORDER BY pos) > 1 AS bad FROM props),
mx AS (SELECT tenant_id, max(CAST(substring(id, 2) AS BIGINT)) AS m FROM props GROUP BY 1),
nb AS (SELECT f.tenant_id, pos, m + row_number() OVER (PARTITION BY f.tenant_id ORDER BY pos) AS n FROM fl f JOIN mx USING (tenant_id) WHERE bad),
rep AS (SELECT f.tenant_id, f.pos, CASE WHEN n IS NULL THEN f.id WHEN n < 1000 THEN concat('P', lpad(CAST(n AS VARCHAR), 3, '0')) ELSE concat('P', CAST(n AS VARCHAR)) END AS id,
  CASE WHEN n IS NOT NULL THEN f.id END AS legacy_id, uid, kind, target, status FROM fl f LEFT JOIN nb ON nb.tenant_id = f.tenant_id AND nb.pos = f.pos)
"""


@query(_REPAIRED + "SELECT tenant_id, pos, id, legacy_id FROM rep")
def repaired_identities(spark, sf_dir):
    return P.repair_identities(_props(spark, sf_dir)).select("tenant_id", "pos", "id", "legacy_id")


_FU = """, fu AS (SELECT o_custkey % 16 AS tenant_id, o_orderkey AS follow_up_id, concat('P', CASE WHEN o_orderkey // 2 % 9000 < 1000 THEN lpad(CAST(o_orderkey // 2 % 9000 AS VARCHAR), 3, '0') ELSE CAST(o_orderkey // 2 % 9000 AS VARCHAR) END) AS proposal_id,
  concat(CASE o_orderkey % 3 WHEN 0 THEN 'hermes-agent' WHEN 1 THEN 'zh-copy-preflight' ELSE 'skill-' END, CAST(o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS target,
  CASE WHEN o_orderkey % 4 = 0 THEN 'worse' END AS result FROM orders)
"""


def _follow_ups(spark, sf_dir):
    p = _props(spark, sf_dir)
    o = given(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    stem = F.when(k % 3 == 0, "hermes-agent").when(k % 3 == 1, "zh-copy-preflight").otherwise("skill-")
    t = o.select(k.alias("pos"), F.concat(stem, (F.col("o_custkey") + F.when(k % 5 == 0, 1).otherwise(0)).cast("string")).alias("ft"))
    return p.join(t, "pos").select("tenant_id", F.col("pos").alias("follow_up_id"), F.col("id").alias("proposal_id"), F.col("ft").alias("target"), F.when(F.col("pos") % 4 == 0, "worse").alias("result"))


@query(_REPAIRED + _FU + """, c AS (SELECT f.tenant_id, f.follow_up_id, count(*) AS n, min(r.id) AS id, min(r.uid) AS uid FROM fu f JOIN rep r ON r.tenant_id = f.tenant_id AND coalesce(r.legacy_id, r.id) = f.proposal_id
  AND r.target = f.target AND r.status = 'done' GROUP BY ALL HAVING count(*) = 1)
SELECT f.follow_up_id, coalesce(c.id, f.proposal_id) AS proposal_id, c.uid AS proposal_uid, CASE WHEN c.n IS NULL THEN 'unresolved' ELSE 'verified' END AS link_status,
CASE WHEN c.n IS NULL THEN 'inconclusive' ELSE f.result END AS result FROM fu f LEFT JOIN c ON c.tenant_id = f.tenant_id AND c.follow_up_id = f.follow_up_id""")
def linked_follow_ups(spark, sf_dir):
    return P.link_follow_ups(_follow_ups(spark, sf_dir), P.repair_identities(_props(spark, sf_dir))).select("follow_up_id", "proposal_id", "proposal_uid", "link_status", "result")


@query(_P + """SELECT tenant_id, 'duplicate_id' AS violation, id AS value FROM props GROUP BY tenant_id, id HAVING count(*) > 1
UNION ALL SELECT p.tenant_id, 'uid_mismatch', p.id FROM props p JOIN (SELECT tenant_id, id, min(struct_pack(t := target, u := uid)) AS m FROM props GROUP BY ALL) q ON q.tenant_id = p.tenant_id AND q.id = p.id
WHERE m.t = p.target AND m.u <> p.uid UNION ALL SELECT p.tenant_id, 'target_mismatch', p.id FROM props p JOIN (SELECT tenant_id, id, min(struct_pack(t := target, u := uid)) AS m FROM props GROUP BY ALL) q ON q.tenant_id = p.tenant_id AND q.id = p.id WHERE m.t <> p.target""")
def ledger_violations(spark, sf_dir):
    p = _props(spark, sf_dir)
    fu = p.select("tenant_id", F.col("id").alias("proposal_id"), F.col("uid").alias("proposal_uid"), "target", F.lit("verified").alias("link_status"))
    return P.ledger_violations(p, fu)


@query(_P + """, ledger AS (SELECT * FROM props WHERE status <> 'pending'), batch AS (SELECT o_custkey % 16 AS tenant_id, o_orderkey AS pos, 'enhance' AS kind, concat('skill-', CAST(o_custkey * 7 % 900 AS VARCHAR)) AS target FROM orders),
b1 AS (SELECT tenant_id, target, kind, min(pos) AS pos FROM batch GROUP BY ALL),
ne AS (SELECT * FROM b1 WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.tenant_id = b1.tenant_id AND l.target = b1.target AND l.kind = b1.kind)),
rk AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY pos) AS n FROM ne),
mx AS (SELECT tenant_id, max(CAST(substring(id, 2) AS BIGINT)) AS m FROM ledger GROUP BY 1),
ad AS (SELECT tenant_id, pos, CASE WHEN m + n < 1000 THEN concat('P', lpad(CAST(m + n AS VARCHAR), 3, '0')) ELSE concat('P', CAST(m + n AS VARCHAR)) END AS verdict FROM rk JOIN mx USING (tenant_id) WHERE n <= 13)
SELECT tenant_id, pos, verdict FROM ad UNION ALL SELECT b.tenant_id, b.pos, CASE WHEN EXISTS (SELECT 1 FROM ledger l WHERE l.tenant_id = b.tenant_id AND l.target = b.target AND l.kind = b.kind) THEN 'already_on_ledger'
WHEN b1.pos = b.pos THEN 'queue_full' ELSE 'repeated_in_batch' END FROM batch b JOIN b1 ON b1.tenant_id = b.tenant_id AND b1.target = b.target AND b1.kind = b.kind WHERE NOT EXISTS (SELECT 1 FROM ad WHERE ad.tenant_id = b.tenant_id AND ad.pos = b.pos)""")
def admitted_proposals(spark, sf_dir):
    ledger = _props(spark, sf_dir).where("status <> 'pending'")
    o = given(spark, sf_dir, "orders")
    batch = o.select((F.col("o_custkey") % 16).alias("tenant_id"), F.col("o_orderkey").alias("pos"), F.lit("enhance").alias("kind"),
                     F.concat(F.lit("skill-"), (F.col("o_custkey") * 7 % 900).cast("string")).alias("target"), F.lit("").alias("reason"))
    new, refused = P.admit_proposals(ledger, batch, as_of())
    where = batch.select("tenant_id", "pos", "target", "kind").groupBy("tenant_id", "target", "kind").agg(F.min("pos").alias("pos"))
    named = new.join(where, ["tenant_id", "target", "kind"]).select("tenant_id", "pos", F.col("id").alias("verdict"))
    return named.unionByName(refused.select("tenant_id", "pos", F.col("reason").alias("verdict")))


def _one_per_id(spark, sf_dir):
    return P.repair_identities(_props(spark, sf_dir))


_LINES = _REPAIRED + """, ticks AS (SELECT *, CASE pos % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'x' WHEN 2 THEN '-' ELSE 'X' END AS m, pos % 11 = 0 AS wrong, pos % 13 = 0 AS nouid, (status = 'approved') <> (pos % 17 = 0) AS in_approved FROM rep),
de AS (SELECT tenant_id, id, lower(m) AS mark, kind, target, status, CASE WHEN wrong THEN 'stale_target' WHEN nouid THEN 'no_identity' WHEN in_approved <> (status = 'approved') THEN 'stale_stage' WHEN status = 'done' THEN 'already_resolved' END AS reason
  FROM ticks WHERE m <> ' ')
"""


def _approval_texts(p):
    k = F.col("pos")
    mark = F.when(k % 4 == 0, " ").when(k % 4 == 1, "x").when(k % 4 == 2, "-").otherwise("X")
    target = F.concat("target", F.when(k % 11 == 0, "-wrong").otherwise(""))
    uid = F.when(k % 13 == 0, "").otherwise(F.concat(F.lit(" <!-- uid:"), "uid", F.lit(" -->")))
    line = F.concat(F.lit("- ["), mark, F.lit("] "), "id", F.lit(" | "), "kind", F.lit(" | "), target, F.lit(" | why"), uid)
    head = F.when((F.col("status") == "approved") != (k % 17 == 0), "已批准待执行").otherwise("待审批提案")
    return p.select("tenant_id", k.alias("doc_id"), F.concat(F.lit("# queue\n\n## "), head, F.lit("\n\n"), line, F.lit("\n- [x] note without id\n")).alias("text"))


@query(_LINES + "SELECT tenant_id, id, coalesce(reason, mark) AS verdict FROM de")
def matched_decisions(spark, sf_dir):
    p = _one_per_id(spark, sf_dir)
    valid, stale = P.match_decisions(P.decision_lines(_approval_texts(p)), p)
    return valid.select("tenant_id", "id", F.col("mark").alias("verdict")).unionByName(stale.select("tenant_id", "id", F.col("reason").alias("verdict")))


_APPLIED = _LINES + """, ap AS (SELECT tenant_id, id, CASE WHEN mark = 'x' AND status = 'approved' THEN 'done' WHEN mark = 'x' AND kind = 'retire' AND NOT (target = 'hermes-agent' OR regexp_matches(target, '^(user|auto-skill-save)')) THEN 'done'
  WHEN mark = 'x' AND kind <> 'retire' THEN 'approved' WHEN mark = '-' AND status = 'pending' THEN 'rejected' END AS nxt, mark FROM de WHERE reason IS NULL)
"""


@query(_APPLIED + "SELECT r.tenant_id, coalesce(nxt, r.status) AS status, count(*) AS n FROM rep r LEFT JOIN ap USING (tenant_id, id) GROUP BY ALL")
def applied_decisions(spark, sf_dir):
    p = _one_per_id(spark, sf_dir)
    valid, _stale = P.match_decisions(P.decision_lines(_approval_texts(p)), p)
    after, _done, _refused = P.apply_decisions(p, valid, as_of())
    return after.groupBy("tenant_id", "status").agg(F.count("*").alias("n"))


_CLUSTERS = """, cl AS (SELECT user_id % 16 AS tenant_id, concat(event_type, ' env typo ', CAST(user_id % 3 AS VARCHAR)) AS title, count(*) AS cnt FROM events GROUP BY ALL),
fa AS (SELECT s_suppkey % 16 AS tenant_id, concat('skill-', CAST(s_suppkey AS VARCHAR)) AS name, s_suppkey % 5 AS load_sessions FROM supplier)
"""


def _clusters(spark, sf_dir):
    e = given(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 16).alias("tenant_id"), F.concat("event_type", F.lit(" env typo "), (F.col("user_id") % 3).cast("string")).alias("title")).agg(
        F.count("*").alias("cnt")).withColumn("cluster_key", F.lit("key"))


def _facts(spark, sf_dir):
    s = given(spark, sf_dir, "supplier")
    return s.select((F.col("s_suppkey") % 16).alias("tenant_id"), F.concat(F.lit("skill-"), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_suppkey") % 5).alias("load_sessions"),
                    (F.col("s_suppkey") % 2 == 0).alias("archived"), (F.col("s_suppkey") % 3).alias("recent_self_errors"))


_NEWFU = _REPAIRED + _CLUSTERS + """, nf AS (SELECT r.tenant_id, r.id AS proposal_id, CASE WHEN kind IN ('retire', 'fix_reference') THEN concat('ref_loads:', target) WHEN starts_with(target, 'zh-copy-preflight') THEN 'cluster:typo'
  WHEN starts_with(target, 'hermes-agent') THEN 'cluster:env' ELSE 'manual_review' END AS metric, target FROM rep r WHERE status = 'done'),
mc AS (SELECT tenant_id, max(cnt) AS c FROM cl GROUP BY 1),
bf AS (SELECT n.*, CASE WHEN starts_with(metric, 'ref_loads') THEN coalesce(f.load_sessions, 0) WHEN starts_with(metric, 'cluster') THEN coalesce(mc.c, 0) END AS baseline
  FROM nf n LEFT JOIN fa f ON f.tenant_id = n.tenant_id AND f.name = n.target LEFT JOIN mc ON mc.tenant_id = n.tenant_id)
"""


def _created(spark, sf_dir):
    done = _one_per_id(spark, sf_dir).where("status = 'done'")
    none = spark.createDataFrame([], "tenant_id long, proposal_id string, proposal_uid string, target string")
    return P.create_follow_ups(done, none, _facts(spark, sf_dir), _clusters(spark, sf_dir), as_of())


@query(_NEWFU + "SELECT tenant_id, proposal_id, metric, baseline FROM bf")
def created_follow_ups(spark, sf_dir):
    return _created(spark, sf_dir).select("tenant_id", "proposal_id", "metric", "baseline")


_DUE = _NEWFU + """, shifted AS (SELECT bf.*, baseline + CASE WHEN baseline IS NULL THEN NULL ELSE length(proposal_id) % 3 - 1 END AS base FROM bf),
du AS (SELECT n.*, f.load_sessions AS now_loads, coalesce(mc.c, 0) AS now_c FROM shifted n LEFT JOIN fa f ON f.tenant_id = n.tenant_id AND f.name = n.target LEFT JOIN mc ON mc.tenant_id = n.tenant_id),
ck AS (SELECT tenant_id, proposal_id, metric, CASE WHEN starts_with(metric, 'ref_loads') THEN CASE WHEN now_loads IS NULL OR now_loads < base THEN 'inconclusive' WHEN now_loads = base THEN 'no_change' ELSE 'worse' END
  WHEN starts_with(metric, 'cluster') AND now_c = base THEN 'no_change' ELSE 'inconclusive' END AS result, CASE WHEN starts_with(metric, 'cluster') THEN now_c > base END AS recurrence_detected FROM du)
"""


def _due(spark, sf_dir):
    fu = _created(spark, sf_dir).withColumn("baseline", F.col("baseline") + (F.length("proposal_id") % 3 - 1))
    return P.check_due(fu, _facts(spark, sf_dir), _clusters(spark, sf_dir), F.lit("2024-03-22").cast("timestamp"))


@query(_DUE + "SELECT * FROM ck")
def checked_follow_ups(spark, sf_dir):
    return _due(spark, sf_dir).select("tenant_id", "proposal_id", "metric", "result", "recurrence_detected")


@query(_DUE + """SELECT tenant_id, count(*) AS total, 0 AS improved, count(*) FILTER (WHERE result = 'no_change') AS no_change, count(*) FILTER (WHERE result = 'worse') AS worse,
count(*) FILTER (WHERE result = 'inconclusive') AS inconclusive, 0 AS pending, count(*) FILTER (WHERE recurrence_detected) AS review_items FROM ck GROUP BY 1""")
def follow_up_summary(spark, sf_dir):
    return V.followup_summary(_due(spark, sf_dir))


@query(_REPAIRED + """, fa AS (SELECT s_suppkey % 16 AS tenant_id, concat('skill-', CAST(s_suppkey AS VARCHAR)) AS name, s_suppkey % 2 = 0 AS archived, s_suppkey % 3 AS errs FROM supplier)
SELECT r.tenant_id, CASE WHEN status IN ('pending', 'approved') AND kind = 'fix_reference' AND (coalesce(archived, false) OR coalesce(errs, 0) = 0) THEN 'superseded' ELSE status END AS status, count(*) AS n
FROM rep r LEFT JOIN fa f ON f.tenant_id = r.tenant_id AND f.name = lower(r.target) GROUP BY ALL""")
def reconciled_proposals(spark, sf_dir):
    return P.reconcile(_one_per_id(spark, sf_dir), _facts(spark, sf_dir), as_of()).groupBy("tenant_id", "status").agg(F.count("*").alias("n"))


@query(_REPAIRED + """SELECT r.tenant_id, CASE WHEN status = 'pending' AND kind = 'retire' AND EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey % 16 = r.tenant_id AND concat('skill-', CAST(c.c_custkey AS VARCHAR)) = r.target) THEN 'done' ELSE status END AS status, count(*) AS n FROM rep r GROUP BY ALL""")
def closed_by_cap(spark, sf_dir):
    return _capped(spark, sf_dir)[0].groupBy("tenant_id", "status").agg(F.count("*").alias("n"))


def _capped(spark, sf_dir):
    c = given(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") % 16).alias("tenant_id"), F.concat(F.lit("skill-"), F.col("c_custkey").cast("string")).alias("name"))
    return P.close_capped(_one_per_id(spark, sf_dir), c, as_of())


@query(_NEWFU + """SELECT r.tenant_id, r.id AS proposal_id, concat('ref_loads:', target) AS metric, coalesce(f.load_sessions, 0) AS baseline FROM rep r LEFT JOIN fa f ON f.tenant_id = r.tenant_id AND f.name = r.target
WHERE status = 'pending' AND kind = 'retire' AND EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey % 16 = r.tenant_id AND concat('skill-', CAST(c.c_custkey AS VARCHAR)) = r.target)""")
def capped_follow_ups(spark, sf_dir):
    none = spark.createDataFrame([], "tenant_id long, proposal_id string, proposal_uid string, target string")
    return P.create_follow_ups(_capped(spark, sf_dir)[1], none, _facts(spark, sf_dir), _clusters(spark, sf_dir), as_of()).select("tenant_id", "proposal_id", "metric", "baseline")


_PREFS = """, pb AS (SELECT c_custkey % 16 AS tenant_id, c_custkey AS pos, concat(c_mktsegment, ' ', CAST(c_nationkey AS VARCHAR)) AS title FROM customer),
have AS (SELECT DISTINCT tenant_id, title FROM pb WHERE title LIKE 'BUILDING%'),
one AS (SELECT tenant_id, title, min(pos) AS pos FROM pb GROUP BY ALL),
nw AS (SELECT o.tenant_id, o.title, coalesce(h.n, 0) + row_number() OVER (PARTITION BY o.tenant_id ORDER BY o.pos) AS k FROM one o LEFT JOIN (SELECT tenant_id, count(*) AS n FROM have GROUP BY 1) h USING (tenant_id)
  WHERE NOT EXISTS (SELECT 1 FROM have x WHERE x.tenant_id = o.tenant_id AND x.title = o.title)),
pr AS (SELECT tenant_id, concat('UP', lpad(CAST(k AS VARCHAR), 3, '0')) AS id, title FROM nw)
"""


def _prefs(spark, sf_dir):
    c = given(spark, sf_dir, "customer")
    b = c.select((F.col("c_custkey") % 16).alias("tenant_id"), F.col("c_custkey").alias("pos"), F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string")).alias("title"),
                 *[F.lit("r").alias(x) for x in ("category", "rule", "evidence", "why")])
    have = b.where("title LIKE 'BUILDING%'").select("tenant_id", "title").distinct()
    return P.admit_preferences(have, b, as_of())


@query("WITH z AS (SELECT 1)" + _PREFS + "SELECT * FROM pr")
def admitted_preferences(spark, sf_dir):
    return _prefs(spark, sf_dir).select("tenant_id", "id", "title")


@query("WITH z AS (SELECT 1)" + _PREFS + "SELECT tenant_id, id, CASE CAST(substring(id, 3) AS INTEGER) % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM pr")
def decided_preferences(spark, sf_dir):
    p = _prefs(spark, sf_dir)
    n = F.substring("id", 3, 9).cast("int")
    mark = F.when(n % 3 == 0, "x").when(n % 3 == 1, "-").otherwise(" ")
    text = p.select("tenant_id", n.cast("long").alias("doc_id"), F.concat(F.lit("## prefs\n- ["), mark, F.lit("] "), "id", F.lit(" | t | r")).alias("text"))
    return P.decide_preferences(p, P.decision_lines(text), as_of()).select("tenant_id", "id", "status")


@query(_REPAIRED + _PREFS + """SELECT tenant_id, CASE status WHEN 'pending' THEN 'proposal' ELSE 'to_execute' END AS queue, id, concat(kind, ' | ', target) AS subject FROM rep WHERE status IN ('pending', 'approved')
UNION ALL SELECT tenant_id, 'preference', id, title FROM pr""")
def open_queue(spark, sf_dir):
    return P.open_queue(_one_per_id(spark, sf_dir), _prefs(spark, sf_dir)).drop("note")


_KIND = "CASE doc_id % 4 WHEN 0 THEN 'enhance' WHEN 1 THEN 'repair' WHEN 2 THEN 'unknown_kind' ELSE 'new_skill' END"


@query(f"""SELECT doc_id AS reply_id, CASE b WHEN 1 THEN 0 ELSE 1 END AS block_no, {_KIND} AS kind, concat('skill ', CAST(doc_id AS VARCHAR), '-', CAST(b AS VARCHAR)) AS target,
substring(trim(regexp_replace(replace(lang || ' ' || source, '*', ''), '\\s+', ' ', 'g')), 1, 180) AS reason FROM documents, (SELECT unnest([1, 2]) AS b) WHERE doc_id % 4 <> 2 AND NOT (b = 2 AND doc_id % 3 = 0)""")
def reply_proposals(spark, sf_dir):
    d = given(spark, sf_dir, "documents")
    k = F.col("doc_id")
    kind = F.when(k % 4 == 0, "enhance").when(k % 4 == 1, "repair").when(k % 4 == 2, "unknown_kind").otherwise("new_skill")

    def block(n, sep, action):
        return F.concat(F.lit(f"### [L{n}] "), kind, F.lit(": skill "), k.cast("string"), F.lit(f"-{n}\n**理由**：  "), "lang", F.lit("  "), "source", F.lit(f"{sep}**证据**：C1{sep}"), action, F.lit("\n"))

    text = F.concat(F.lit("## 📊\nfine\n## 技能提案\n"), block(1, "\n", F.lit("**动作**: go")), block(2, " ", F.when(k % 3 == 0, "").otherwise("**动作**：go")), F.lit("## 证据覆盖\n"), "text")
    return P.reply_proposals(d.select(k.alias("reply_id"), text.alias("text"))).select("reply_id", "block_no", "kind", "target", "reason")


@query(_P + """, st AS (SELECT DISTINCT tenant_id, target FROM props WHERE status IN ('rejected', 'done', 'pending')),
bt AS (SELECT c_custkey % 16 AS tenant_id, c_custkey AS pos, concat(CASE c_custkey % 3 WHEN 0 THEN 'hermes-agent' WHEN 1 THEN 'zh-copy-preflight' ELSE 'skill-' END, CAST(c_custkey AS VARCHAR)) AS target FROM customer)
SELECT tenant_id, pos, target FROM bt ANTI JOIN st USING (tenant_id, target)""")
def unsettled_proposals(spark, sf_dir):
    c, k = given(spark, sf_dir, "customer"), F.col("c_custkey")
    stem = F.when(k % 3 == 0, "hermes-agent").when(k % 3 == 1, "zh-copy-preflight").otherwise("skill-")
    batch = c.select((k % 16).alias("tenant_id"), k.alias("pos"), F.concat(stem, k.cast("string")).alias("target"))
    return P.skip_settled(batch, _props(spark, sf_dir))


@query("""SELECT doc_id AS reply_id, 'quality' AS category, concat('title ', CAST(doc_id AS VARCHAR)) AS title, source AS rule, lang AS evidence, 'because so' AS why FROM documents""")
def reply_preferences(spark, sf_dir):
    d = given(spark, sf_dir, "documents")
    text = F.concat(F.lit("## c\n### [U1] quality : title "), F.col("doc_id").cast("string"), F.lit("\n**规则**： "), "source", F.lit("\n**证据**："), "lang", F.lit("\n**为什么**：because  so\n### next\n"), "text")
    return P.reply_preferences(d.select(F.col("doc_id").alias("reply_id"), text.alias("text"))).drop("block_no")


# ---- reviews --------------------------------------------------------------------------------------------------------
_PACKET = ctes("errors") + """, cl AS (SELECT tenant_id, message AS cluster_key, count(*) AS cnt FROM errors GROUP BY ALL),
fs AS (SELECT c_custkey % 8 AS tenant_id, c_custkey AS session_id, DATE '2024-01-01' + CAST(c_custkey % 50 AS INTEGER) AS started_at, CASE WHEN c_acctbal > 4000 THEN 'high' ELSE 'medium' END AS confidence FROM customer),
fu AS (SELECT s_suppkey % 8 AS tenant_id, concat('P', CAST(s_suppkey AS VARCHAR)) AS proposal_id, s_name AS target, DATE '2024-01-01' + CAST(s_suppkey % 30 AS INTEGER) AS check_after, s_acctbal > 5000 AS rec FROM supplier),
pk AS (SELECT tenant_id, concat('C', CAST(n AS VARCHAR)) AS item_id, cluster_key AS subject, cnt >= 3 AS required FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY cnt DESC, cluster_key) AS n FROM cl) WHERE n <= 10
 UNION ALL SELECT tenant_id, concat('F', CAST(n AS VARCHAR)), CAST(session_id AS VARCHAR), confidence = 'high' FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY started_at DESC, session_id) AS n FROM fs) WHERE n <= 10
 UNION ALL SELECT tenant_id, concat('W', CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY check_after, proposal_id, target) AS VARCHAR)), concat(proposal_id, ':', target), true FROM fu WHERE rec)
"""


def _packet(spark, sf_dir):
    e = shape(spark, sf_dir, "errors").groupBy("tenant_id", F.col("message").alias("cluster_key")).agg(F.count("*").alias("cnt"))
    c = given(spark, sf_dir, "customer").select((F.col("c_custkey") % 8).alias("tenant_id"), F.col("c_custkey").alias("session_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 50).cast("int")).alias("started_at"), F.when(F.col("c_acctbal") > 4000, "high").otherwise("medium").alias("confidence"))
    s = given(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 8).alias("tenant_id"), F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("proposal_id"), F.col("s_name").alias("target"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 30).cast("int")).alias("check_after"), F.lit("cluster:x").alias("metric"), F.lit("inconclusive").alias("result"), F.lit("verified").alias("link_status"), (F.col("s_acctbal") > 5000).alias("recurrence_detected"))
    return V.evidence_packet(e, c, s)


@query(_PACKET + "SELECT * FROM pk")
def evidence_packet(spark, sf_dir):
    return _packet(spark, sf_dir)


@query(_PACKET + """, rp AS (SELECT n_nationkey % 8 AS tenant_id, n_nationkey AS reply_id, n_nationkey % 3 AS drop_mod, n_nationkey % 5 = 0 AS short FROM nation),
ms AS (SELECT r.reply_id, count(*) FILTER (WHERE required AND (short OR (drop_mod > 0 AND CAST(substring(item_id, 2) AS INTEGER) % 4 = drop_mod))) AS missing FROM rp r JOIN pk USING (tenant_id) GROUP BY 1)
SELECT tenant_id, reply_id, missing, CASE WHEN short THEN 'empty_or_invalid_output' WHEN missing > 0 THEN 'missing_coverage' ELSE 'accepted' END AS verdict FROM rp JOIN ms USING (reply_id)""")
def review_coverage(spark, sf_dir):
    pk = _packet(spark, sf_dir)
    n = given(spark, sf_dir, "nation").select((F.col("n_nationkey") % 8).cast("long").alias("tenant_id"), F.col("n_nationkey").alias("reply_id"))
    drop = F.col("reply_id") % 3
    keep = ~((drop > 0) & (F.substring("item_id", 2, 9).cast("int") % 4 == drop))
    body = n.join(pk, "tenant_id").groupBy("tenant_id", "reply_id").agg(F.concat_ws(", ", F.collect_list(F.when(keep, F.col("item_id")))).alias("ids"))
    text = F.when(F.col("reply_id") % 5 == 0, "short").otherwise(F.concat(F.lit("## 技能提案\n" + "x" * 100 + "\n"), "ids"))
    return V.review_coverage(pk, body.select("tenant_id", "reply_id", text.alias("text")))


@query(ctes("summaries") + _REPAIRED.replace("WITH props", ", props", 1) + """, su AS (SELECT tenant_id, count(*) AS indexed_sessions, count(*) FILTER (WHERE updated >= TIMESTAMP '2024-03-08 00:00:00') AS recent_sessions,
  count(*) FILTER (WHERE status = 'blocked') AS missing_cards FROM summaries GROUP BY 1), pp AS (SELECT tenant_id % 4 AS tenant_id, id, uid, target, status FROM props),
pd AS (SELECT tenant_id, count(*) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (WHERE status = 'pending') AS pending FROM pp GROUP BY 1),
fo AS (SELECT l.tenant_id, count(*) FILTER (WHERE l.status <> 'approved' AND (l.target <> m.t OR l.uid <> m.u)) AS mismatched_links, count(*) FILTER (WHERE l.status = 'approved') AS unresolved_links FROM pp l
  JOIN (SELECT tenant_id, id, s.t AS t, s.u AS u FROM (SELECT tenant_id, id, max(struct_pack(t := target, u := uid)) AS s FROM pp GROUP BY tenant_id, id)) m ON m.tenant_id = l.tenant_id AND m.id = l.id GROUP BY 1)
SELECT * FROM su JOIN pd USING (tenant_id) JOIN fo USING (tenant_id)""")
def review_packet(spark, sf_dir):
    s = shape(spark, sf_dir, "summaries")
    p = _props(spark, sf_dir).withColumn("tenant_id", F.col("tenant_id") % 4)
    fu = p.select("tenant_id", F.col("id").alias("proposal_id"), F.col("uid").alias("proposal_uid"), "target", F.when(F.col("status") == "approved", "unresolved").otherwise("verified").alias("link_status"))
    return V.review_packet(s, s.where("status <> 'blocked'"), p, fu, as_of())


@query("""SELECT k AS tenant_id, CASE WHEN k % 5 = 4 THEN 'refused_wrong_packet' WHEN k % 5 = 3 THEN 'refused_coverage' WHEN k % 5 = 2 THEN 'refused_unexplained' WHEN k % 5 = 1 THEN 'reviewed_with_findings' ELSE 'ok' END AS status
FROM (SELECT DISTINCT c_custkey % 40 AS k FROM customer)""")
def completed_reviews(spark, sf_dir):
    packet = given(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("tenant_id"), F.col("c_name").alias("subject"), "c_acctbal")
    sealed = V.seal_packet(packet)
    again = V.seal_packet(packet.repartition(5, "subject"))
    from tracemill.vocab import REVIEW_CHECKS

    k = F.col("tenant_id")
    rows = again.withColumn("check_id", F.explode(F.array(*[F.lit(c) for c in REVIEW_CHECKS]))).where(~((k % 5 == 3) & (F.col("check_id") == "E1")))
    first = F.col("check_id") == "A1"
    checks = rows.select(
        "tenant_id", F.when(k % 5 == 4, "other").otherwise(F.col("packet_id")).alias("packet_id"), "check_id", F.when((k % 5 == 1) & first, "finding").otherwise("pass").alias("status"),
        F.when((k % 5 == 2) & first, "short").otherwise("looked at every row of it").alias("detail"))
    return V.complete_reviews(sealed, checks).select("tenant_id", "status")


@query(ctes("alerts") + """, nw AS (SELECT user_id % 8 AS tenant_id, channel, max(ts) AS ts, arg_max(message, ts) AS m FROM alerts GROUP BY ALL)
SELECT tenant_id, channel, CASE WHEN date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') > CASE channel WHEN 'error' THEN 7200 ELSE 777600 END THEN 'stale' WHEN m = 'm1' THEN 'findings' ELSE 'degraded' END AS problem
FROM nw WHERE date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') > CASE channel WHEN 'error' THEN 7200 ELSE 777600 END OR m <> 'm0'""")
def stale_channels(spark, sf_dir):
    a = shape(spark, sf_dir, "alerts")
    st = a.select((F.col("user_id") % 8).alias("tenant_id"), "channel", "ts", F.when(F.col("message") == "m2", "failed").otherwise("ok").alias("status"), F.when(F.col("message") == "m1", 1).otherwise(0).alias("findings"))
    limits = {c: (7200 if c == "error" else 777600) for c in ("error", "view", "click", "signup", "purchase")}
    return V.staleness(st, F.lit("2024-01-31").cast("timestamp"), limits)
