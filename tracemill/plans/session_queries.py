"""Queries over conversations: labels, summaries, signals, outcomes, daily evidence."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.operators import daily as D
from tracemill.operators import sessions as S
from tracemill.operators import signals as G
from tracemill.plans.adapters import ctes, given, shape
from tracemill.plans.registry import query
from tracemill.vocab import DEFAULT

DAY = "2024-01-03"


def as_of():
    return F.lit("2024-02-01").cast("timestamp")


# Words that occur in the given texts; the defaults are for another language.
WORDS = replace(
    DEFAULT, correction=("the ", "der ", "le ", "en"), approval=("de", "in", "er"), habit_patterns=("un[a-z]", "h.{0,3}s"),
    closing_success=("tion", "ung"), closing_strong=("eau",), closing_fail=("the", "que"), reaction_approve=("an",),
    reaction_approve_any_case=("is",), reaction_complain=("ou",), reaction_complain_any_case=("sch",), tail_success=("tion",),
    tail_fail=("THE", "que"), conclusion=("eau", "tion", "und"), ad_strong=("quere",), ad_weak=("nav", "the"), probes=("schund",),
    correction_markers=("que", "the", "und"), open_markers=("ver", "eau"), decision_patterns=("men?t", "ing"),
    result_patterns=("tion", "er"), plan_words="(?:onan|aux)", plan_start="^(?:La|In)", process_prefixes=("Le", "The"),
    sentence_break="[.!?]",
)
_PLAN = "(regexp_matches(s, '^(Le|The)') OR regexp_matches(s, '^(La|In)') OR (regexp_matches(s, '(onan|aux)') AND NOT regexp_matches(s, '(?is)tion|er')))"
_EDGE = " -•*，,、；;。.!?！？"


def _sentences(src: str, cols: str) -> str:
    return (
        f"SELECT {cols}, i, trim(regexp_replace(part, '\\s+', ' ', 'g'), '{_EDGE}') AS s FROM (SELECT {cols}, "
        f"unnest(string_split_regex(text, '[.!?]')) AS part, generate_subscripts(string_split_regex(text, '[.!?]'), 1) AS i FROM {src})"
    )


def _messages(spark, sf_dir):
    return shape(spark, sf_dir, "messages")


def _spoken(spark, sf_dir, **kw):
    return G.session_messages(_messages(spark, sf_dir), shape(spark, sf_dir, "sessions"), **kw)


def _session_rows(spark, sf_dir):
    return _messages(spark, sf_dir).select("tenant_id", "session_id", F.col("ordinal").alias("pos"), "role", F.col("content").alias("text"), "ts")


_SPOKEN = """,
spoken AS (SELECT m.*, s.title, s.source FROM messages m JOIN sessions s USING (tenant_id, session_id)
  WHERE s.archived = 0 AND s.source NOT IN ('cron', 'daily-polish', 'skill-evolution-librarian', 'preference-miner', 'tool')
    AND coalesce(s.parent_session_id, '') = ''),
users AS (SELECT *, trim(content, E' \\n\\t\\r') AS t FROM spoken WHERE role = 'user'),
real AS (SELECT * FROM users WHERE t <> '' AND length(t) <= 300
  AND NOT regexp_matches(t, '^(\\[System:|\\[OUT-OF-BAND|@image)') AND length(t) - length(replace(t, chr(10), '')) <= 6),
labelled AS (SELECT *,
  CASE WHEN contains(t, 'the ') THEN 'the ' WHEN contains(t, 'der ') THEN 'der ' WHEN contains(t, 'le ') THEN 'le ' WHEN contains(t, 'en') THEN 'en' END AS corr,
  CASE WHEN length(t) <= 12 THEN CASE WHEN contains(t, 'de') THEN 'de' WHEN contains(t, 'in') THEN 'in' WHEN contains(t, 'er') THEN 'er' END END AS appr,
  coalesce(nullif(regexp_extract(t, 'un[a-z]'), ''), nullif(regexp_extract(t, 'h.{0,3}s'), '')) AS habit FROM real),
signals AS (SELECT *, CASE WHEN corr IS NOT NULL THEN 'correction' WHEN appr IS NOT NULL THEN 'approval' ELSE 'habit' END AS kind,
  coalesce(corr, appr, habit) AS signal FROM labelled WHERE coalesce(corr, appr, habit) IS NOT NULL)
"""
_BASE = ctes("messages", "sessions") + _SPOKEN


@query(_BASE + "SELECT tenant_id, session_id, msg_id, title FROM spoken")
def spoken_messages(spark, sf_dir):
    return _spoken(spark, sf_dir).select("tenant_id", "session_id", "msg_id", "title")


@query(_BASE + """SELECT m.msg_id, coalesce(r.msg_id IS NOT NULL, false) AS real FROM messages m LEFT JOIN (
SELECT msg_id FROM (SELECT *, trim(content, E' \\n\\t\\r') AS t FROM messages) WHERE t <> '' AND length(t) <= 300
 AND NOT regexp_matches(t, '^(\\[System:|\\[OUT-OF-BAND|@image)') AND length(t) - length(replace(t, chr(10), '')) <= 6) r USING (msg_id)""")
def real_user_text(spark, sf_dir):
    return _messages(spark, sf_dir).select("msg_id", T.is_real_user_text("content").alias("real"))


@query(_BASE + "SELECT msg_id, kind, signal FROM signals")
def user_signals(spark, sf_dir):
    return G.user_signals(_spoken(spark, sf_dir), vocab=WORDS).select("msg_id", "kind", "signal")


@query(_BASE + """SELECT tenant_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE kind = 'correction') AS corrections,
count(*) FILTER (WHERE kind = 'approval') AS approvals, count(*) FILTER (WHERE kind = 'habit') AS habits FROM signals GROUP BY ALL""")
def signal_counts_by_day(spark, sf_dir):
    return G.signal_counts(G.user_signals(_spoken(spark, sf_dir), vocab=WORDS)).withColumn("day", F.col("day").cast("string"))


_ANY = _BASE.replace("AND coalesce(s.parent_session_id, '') = ''", "")


@query(_ANY + """, grid AS (SELECT tenant_id, CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-01-03', INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT DISTINCT tenant_id FROM sessions))
SELECT g.tenant_id, CAST(g.day AS VARCHAR) AS day, count(s.msg_id) AS corrections FROM grid g
LEFT JOIN (SELECT * FROM signals WHERE kind = 'correction') s ON s.tenant_id = g.tenant_id AND CAST(s.ts AS DATE) = g.day GROUP BY ALL""")
def correction_trend_week(spark, sf_dir):
    sig = G.user_signals(_spoken(spark, sf_dir, root_only=False), vocab=WORDS)
    return G.correction_trend(sig, shape(spark, sf_dir, "sessions"), DAY).withColumn("day", F.col("day").cast("string"))


@query(_BASE + """SELECT tenant_id, signal, count(*) AS n FROM signals WHERE kind = 'correction'
AND CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-03' GROUP BY ALL HAVING count(*) >= 2""")
def recurring_corrections(spark, sf_dir):
    return G.recurring_signals(G.user_signals(_spoken(spark, sf_dir), vocab=WORDS), DAY)


@query(_BASE + """, c AS (SELECT tenant_id, CAST(ts AS DATE) AS day, count(*) AS n FROM signals GROUP BY ALL)
SELECT tenant_id, 'day' AS grain, CAST(day AS VARCHAR) AS day, n + CASE WHEN day = DATE '2024-01-02' THEN 100 ELSE 0 END AS n FROM c
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY c.day DESC) <= 26""")
def signal_trend_history(spark, sf_dir):
    sig = G.user_signals(_spoken(spark, sf_dir), vocab=WORDS)
    points = sig.groupBy("tenant_id", F.lit("day").alias("grain"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    again = points.where("day = DATE '2024-01-02'").withColumn("n", F.col("n") + 100)
    return G.append_trend(points, again).withColumn("day", F.col("day").cast("string"))


_PAIRS = _BASE + """,
pairs AS (SELECT c.tenant_id, c.session_id, c.msg_id, c.ts, c.title, c.corr AS signal, c.t AS text, coalesce((
   SELECT arg_max(substring(a.content, 1, 400), a.msg_id) FROM messages a WHERE a.session_id = c.session_id AND a.role = 'assistant'
     AND length(a.content) > 20 AND NOT starts_with(a.content, '[System:') AND a.ts < c.ts), '') AS prior_reply
   FROM labelled c WHERE c.corr IS NOT NULL)
"""


@query(_PAIRS + "SELECT msg_id, signal, text, prior_reply FROM pairs")
def corrections_with_reply(spark, sf_dir):
    return G.corrections_with_reply(_spoken(spark, sf_dir), vocab=WORDS).select("msg_id", "signal", "text", "prior_reply")


@query(_PAIRS + """, r AS (SELECT *, substring(text, 1, 150) AS tx, substring(prior_reply, 1, 200) AS reply,
  row_number() OVER (PARTITION BY tenant_id ORDER BY ts, msg_id) AS n FROM pairs),
w AS (SELECT *, sum(length(tx) + length(reply) + length(coalesce(title, '')) + 1) OVER (PARTITION BY tenant_id ORDER BY n) AS used FROM r)
SELECT tenant_id, msg_id, concat('E', CAST(n AS VARCHAR)) AS pair_id, tx AS text, reply FROM w WHERE used <= 9000""")
def correction_pairs(spark, sf_dir):
    pairs = G.corrections_with_reply(_spoken(spark, sf_dir), vocab=WORDS)
    return G.correction_pairs(pairs, as_of(), days=3650).select("tenant_id", "msg_id", "pair_id", "text", "reply")


@query(_PAIRS + """, p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, msg_id) AS position FROM pairs WHERE CAST(ts AS DATE) = DATE '2024-01-03'),
h AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, msg_id) AS position FROM signals WHERE kind = 'habit' AND CAST(ts AS DATE) = DATE '2024-01-03')
SELECT tenant_id, 'correction' AS part, position, signal, substring(text, 1, 100) AS text, substring(prior_reply, 1, 150) AS did FROM p WHERE position <= 8
UNION ALL SELECT tenant_id, 'habit', position, NULL, substring(t, 1, 80), NULL FROM h WHERE position <= 5""")
def growth_facts_of_day(spark, sf_dir):
    spoken = _spoken(spark, sf_dir)
    c, h = G.growth_facts(G.corrections_with_reply(spoken, vocab=WORDS), G.user_signals(spoken, vocab=WORDS), DAY)
    return c.withColumn("part", F.lit("correction")).unionByName(h.withColumn("part", F.lit("habit")), allowMissingColumns=True)


@query(_ANY + """, g AS (SELECT tenant_id, CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-01-03', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT tenant_id FROM sessions)),
t AS (SELECT g.tenant_id, g.day, count(s.msg_id) AS n FROM g LEFT JOIN (SELECT * FROM signals WHERE kind = 'correction') s ON s.tenant_id = g.tenant_id AND CAST(s.ts AS DATE) = g.day GROUP BY ALL),
d AS (SELECT tenant_id, count(*) FILTER (WHERE kind = 'correction') AS corrections, count(*) FILTER (WHERE kind = 'approval') AS approvals, count(*) FILTER (WHERE kind = 'habit') AS habits
  FROM signals WHERE CAST(ts AS DATE) = DATE '2024-01-03' GROUP BY 1)
SELECT tenant_id, coalesce(any_value(corrections), 0) AS corrections, coalesce(any_value(approvals), 0) AS approvals, coalesce(any_value(habits), 0) AS habits, string_agg(CAST(n AS VARCHAR), ',' ORDER BY day) AS trend
FROM t LEFT JOIN d USING (tenant_id) GROUP BY tenant_id""")
def growth_counts_of_day(spark, sf_dir):
    sig = G.user_signals(_spoken(spark, sf_dir, root_only=False), vocab=WORDS)
    return G.growth_counts(sig, shape(spark, sf_dir, "sessions"), DAY).withColumn("trend", F.array_join(F.col("trend").cast("array<string>"), ","))


_CLOSING = ctes("messages", "sessions") + """,
c AS (SELECT session_id, ts AS closed_at, text, msg_id FROM (SELECT *, trim(content, E' \\n\\t\\r') AS text,
        row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, msg_id DESC) AS rn FROM messages WHERE role = 'assistant')
      WHERE rn <= 30 AND NOT regexp_matches(text, '^(\\[System:|\\[OUT-OF-BAND)') AND length(text) >= 10
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, msg_id DESC) = 1),
l AS (SELECT *, contains(lower(text), 'eau') AS st, regexp_matches(lower(right(text, 500)), 'tion|ung') AS g,
        regexp_matches(lower(right(text, 500)), 'the|que') AS b FROM c),
lab AS (SELECT session_id, closed_at, CASE WHEN st AND b AND NOT g THEN 'success_strong' WHEN g AND NOT b THEN 'success' WHEN b AND NOT g THEN 'fail'
        WHEN g AND b THEN 'conflict' ELSE 'none' END AS label FROM l),
five AS (SELECT m.session_id, trim(m.content, E' \\n\\t\\r') AS t, m.ts, m.msg_id FROM messages m JOIN c USING (session_id) WHERE m.role = 'user' AND m.ts >= c.closed_at
      QUALIFY row_number() OVER (PARTITION BY m.session_id ORDER BY m.ts, m.msg_id) <= 5),
rea AS (SELECT session_id, CASE WHEN contains(t, 'ou') OR contains(lower(t), 'sch') THEN 'complain' WHEN contains(t, 'an') OR contains(lower(t), 'is') THEN 'approve' END AS reaction, ts, msg_id
      FROM five WHERE t <> '' AND length(t) <= 60),
first AS (SELECT session_id, reaction FROM rea WHERE reaction IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, msg_id) = 1),
scores AS (SELECT s.*, lab.label, f.reaction,
  CASE WHEN label IS NULL THEN 'uncertain' WHEN reaction = 'complain' THEN 'fail' WHEN reaction = 'approve' AND label = 'fail' THEN 'uncertain'
       WHEN reaction = 'approve' OR label IN ('success', 'success_strong') THEN 'success' WHEN label = 'fail' THEN 'fail' ELSE 'uncertain' END AS outcome,
  CASE WHEN label IS NULL THEN 'low' WHEN reaction = 'complain' THEN 'high' WHEN reaction = 'approve' AND label = 'fail' THEN 'medium'
       WHEN reaction = 'approve' OR label IN ('success', 'fail') THEN 'high' WHEN label IN ('success_strong', 'conflict') THEN 'medium' ELSE 'low' END AS confidence
  FROM sessions s LEFT JOIN lab USING (session_id) LEFT JOIN first f USING (session_id))
"""


@query(_CLOSING + "SELECT session_id, strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS closed_at, md5(text) AS digest FROM c")
def closing_messages(spark, sf_dir):
    c = G.closing_messages(_messages(spark, sf_dir))
    return c.select("session_id", F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss").alias("closed_at"), F.md5("text").alias("digest"))


@query(_CLOSING + "SELECT session_id, label FROM lab")
def closing_labels(spark, sf_dir):
    return G.closing_messages(_messages(spark, sf_dir)).select("session_id", T.closing_label("text", WORDS).alias("label"))


@query(_CLOSING + "SELECT session_id, reaction FROM first")
def user_reactions(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return G.first_reactions(m, G.closing_messages(m), vocab=WORDS).select("session_id", "reaction")


@query(_CLOSING + "SELECT session_id, label, reaction, outcome, confidence FROM scores")
def session_scores(spark, sf_dir):
    return G.score_sessions(_messages(spark, sf_dir), shape(spark, sf_dir, "sessions"), vocab=WORDS).select("session_id", "label", "reaction", "outcome", "confidence")


_WINDOW = """, win AS (SELECT * FROM scores WHERE source NOT IN ('cron', 'daily-polish', 'skill-evolution-librarian', 'preference-miner', 'tool')
  AND coalesce(parent_session_id, '') = '' AND message_count >= 4 AND started_at >= TIMESTAMP '2023-12-31 00:00:00')
"""


def _window(spark, sf_dir):
    s = G.scored_window(shape(spark, sf_dir, "sessions"), F.lit("2024-01-07").cast("timestamp"), days=7)
    return G.score_sessions(_messages(spark, sf_dir), s, vocab=WORDS), s


@query(_CLOSING + _WINDOW + """SELECT tenant_id, count(*) FILTER (WHERE outcome = 'success') AS success, count(*) FILTER (WHERE outcome = 'fail') AS fail,
count(*) FILTER (WHERE outcome = 'uncertain') AS uncertain, round(count(*) FILTER (WHERE outcome = 'success') / nullif(count(*) FILTER (WHERE outcome <> 'uncertain'), 0), 4) AS success_rate
FROM win GROUP BY tenant_id""")
def outcome_rates(spark, sf_dir):
    return G.outcome_window(_window(spark, sf_dir)[0])


@query(_CLOSING + _WINDOW + "SELECT session_id, title, confidence, label, reaction FROM win WHERE outcome = 'fail'")
def failed_sessions(spark, sf_dir):
    scores, s = _window(spark, sf_dir)
    return G.failed_sessions(scores, s).select("session_id", "title", "confidence", "label", "reaction")


@query(ctes("messages") + """SELECT session_id, CASE WHEN contains(t, 'tion') THEN 'success' WHEN regexp_matches(lower(t), 'the|que') THEN 'fail' ELSE 'uncertain' END AS outcome
FROM (SELECT session_id, right(content, 400) AS t FROM messages WHERE role = 'assistant' AND length(trim(content, E' \\n\\t\\r')) > 20
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY msg_id DESC) = 1)""")
def tail_outcomes(spark, sf_dir):
    return G.tail_outcomes(_messages(spark, sf_dir), vocab=WORDS).select("session_id", "outcome")


# ---- daily evidence -------------------------------------------------------------------------------------------------
_CLEAN = """array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, E' \\n\\t\\r')),
  lambda x: x <> '' AND NOT starts_with(x, '[System:') AND NOT starts_with(x, '[OUT-OF-BAND') AND NOT (starts_with(x, '<') AND ends_with(x, '>'))), ' ')"""
_DENOISE = """CASE WHEN length(text) >= 60 AND (contains(lower(text), 'quere') OR (regexp_matches(lower(text), 'nav|the')
  AND regexp_matches(text, '(?i)<(html|body|div|table|img|style)[^>]*>|\\.ql-align|background-color:|font-family:|margin:0') AND length(text) > 200))
  THEN concat('[广告/订阅邮件，已降噪] ', substring(regexp_replace(text, '\\s+', ' ', 'g'), 1, 120), '…') ELSE text END"""
_MAIL = "'(?i)(<(?:html|body|table|div|a\\s|img|br|/?p|span|font)[^>]*>|<!doctype|&nbsp;|href=|click here|this (?:e-?mail|message)|view in browser)'"
_EVIDENCE = ctes("messages", "sessions") + f""",
said AS (SELECT * FROM (SELECT tenant_id, session_id, role, ts, msg_id, {_CLEAN} AS text FROM messages) WHERE text <> ''),
u AS (SELECT session_id, string_agg(text, '¦' ORDER BY msg_id) AS requests, arg_min(text, msg_id) AS first FROM (SELECT session_id, msg_id, {_DENOISE} AS text FROM said WHERE role = 'user'
   QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY msg_id) <= 4) GROUP BY 1),
a AS (SELECT * FROM said WHERE role = 'assistant'),
con AS (SELECT session_id, string_agg(substring(text, 1, 260), '¦' ORDER BY msg_id) AS c FROM (SELECT * FROM a WHERE regexp_matches(text, 'eau|tion|und') AND length(text) > 30
   QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY msg_id DESC) <= 3) GROUP BY 1),
fb AS (SELECT session_id, (SELECT text FROM a x WHERE x.session_id = y.session_id ORDER BY length(text) DESC, msg_id LIMIT 1) AS lo,
   (SELECT text FROM a x WHERE x.session_id = y.session_id ORDER BY msg_id DESC LIMIT 1) AS ta FROM (SELECT DISTINCT session_id FROM a) y),
e AS (SELECT s.tenant_id, s.session_id, coalesce(nullif(s.title, ''), CAST(s.session_id AS VARCHAR)) AS title, s.message_count AS messages, s.tool_call_count AS tools, s.source,
   coalesce(u.requests, '') AS requests, coalesce(u.first, '') AS first, coalesce(con.c, CASE WHEN lo IS NULL THEN '' WHEN lo = ta THEN substring(lo, 1, 260) ELSE concat(substring(lo, 1, 260), '¦', substring(ta, 1, 260)) END, '') AS conclusions
   FROM sessions s LEFT JOIN u USING (session_id) LEFT JOIN con USING (session_id) LEFT JOIN fb USING (session_id)),
ev AS (SELECT *, lower(concat(title, ' ', first)) AS bt FROM e),
cl AS (SELECT *, CASE WHEN source = 'cron' THEN 'cron' WHEN source = 'tool' THEN 'drop'
   WHEN (tools = 0 AND messages <= 3) OR contains(bt, 'quere') OR (regexp_matches(bt, 'nav|the') AND (regexp_matches(first, {_MAIL}) OR regexp_matches(title, {_MAIL})))
     OR contains(first, '[广告/订阅邮件，已降噪]') OR contains(bt, 'schund') THEN 'drop' ELSE 'real' END AS class FROM ev)
"""


def _evidence(spark, sf_dir):
    return D.session_evidence(_messages(spark, sf_dir), shape(spark, sf_dir, "sessions"), vocab=WORDS)


@query(_EVIDENCE + "SELECT session_id, title, messages, tools, requests, conclusions, class FROM cl")
def session_evidence(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    return e.select("session_id", "title", "messages", "tools", F.array_join("requests", "¦").alias("requests"), F.array_join("conclusions", "¦").alias("conclusions"), "class")


@query(_EVIDENCE + """, r AS (SELECT *, string_split(requests, '¦') AS rl, string_split(conclusions, '¦') AS cn FROM cl WHERE class = 'real'),
z AS (SELECT tenant_id, count(*) AS n, sum(length(title) + length(array_to_string(rl[1:2], '')) + length(array_to_string(cn[1:2], ''))) AS chars FROM r GROUP BY 1),
k AS (SELECT tenant_id, CASE WHEN n <= 6 THEN 4 WHEN chars <= 14000 THEN 2 ELSE 1 END AS kept FROM z)
SELECT session_id, kept, array_to_string(rl[1:kept], '¦') AS requests, array_to_string(cn[1:kept], '¦') AS conclusions FROM r JOIN k USING (tenant_id)""")
def daily_evidence_budget(spark, sf_dir):
    e = D.fit_budget(_evidence(spark, sf_dir).where("class = 'real'"))
    return e.select("session_id", "kept", F.array_join("requests", "¦").alias("requests"), F.array_join("conclusions", "¦").alias("conclusions"))


@query(_EVIDENCE + """, r AS (SELECT cl.*, CAST(s.started_at AS DATE) AS day, string_split(requests, '¦') AS rl, string_split(conclusions, '¦') AS cn FROM cl JOIN sessions s USING (session_id) WHERE class = 'real'),
z AS (SELECT r.tenant_id, day, count(*) AS n, sum(length(r.title) + length(array_to_string(rl[1:2], '')) + length(array_to_string(cn[1:2], ''))) AS chars FROM r GROUP BY ALL),
k AS (SELECT tenant_id, day, CASE WHEN n <= 2 THEN 4 WHEN chars <= 1400 THEN 2 ELSE 1 END AS kept FROM z)
SELECT session_id, kept, array_to_string(rl[1:kept], '¦') AS requests, array_to_string(cn[1:kept], '¦') AS conclusions FROM r JOIN k USING (tenant_id, day)""")
def daily_evidence_budget_by_day(spark, sf_dir):
    e = _evidence(spark, sf_dir).where("class = 'real'").withColumn("day", F.to_date("started_at"))
    e = D.fit_budget(e, many=2, budget=1400, by=("tenant_id", "day"))
    return e.select("session_id", "kept", F.array_join("requests", "¦").alias("requests"), F.array_join("conclusions", "¦").alias("conclusions"))


@query(ctes("messages") + f"SELECT msg_id, md5({_CLEAN}) AS digest FROM messages")
def clean_lines(spark, sf_dir):
    return _messages(spark, sf_dir).select("msg_id", F.md5(T.clean_lines("content")).alias("digest"))


@query("""SELECT page_id, (contains(bt, 'quere') OR (regexp_matches(bt, 'nav|the') AND regexp_matches(html, """ + _MAIL + """))) AS ad
FROM (SELECT page_id, html, lower(concat(url, ' ', html)) AS bt FROM pages)""")
def mail_ads(spark, sf_dir):
    p = given(spark, sf_dir, "pages")
    return p.select("page_id", T.is_ad("url", "html", WORDS).alias("ad"))


@query(f"SELECT page_id, md5({_DENOISE}) AS digest FROM (SELECT page_id, html AS text FROM pages)")
def denoised_mail(spark, sf_dir):
    p = given(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(T.denoise("html", WORDS)).alias("digest"))


# ---- summaries ------------------------------------------------------------------------------------------------------
_ROWS = ctes("messages") + ", rows AS (SELECT tenant_id, session_id, ordinal AS pos, role, content AS text, ts FROM messages)"


@query(_ROWS + "SELECT session_id, text, min(pos) AS pos FROM rows WHERE role = 'user' AND length(text) >= 2 GROUP BY ALL")
def distinct_requests(spark, sf_dir):
    return S.distinct_requests(_session_rows(spark, sf_dir)).select("session_id", "text", "pos")


_CLAIMS = _ROWS + f""", said AS (SELECT session_id, pos, text, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS nth FROM rows WHERE role = 'assistant' AND length(text) >= 8),
sent AS ({_sentences('said', 'session_id, pos, nth')}),
sc AS (SELECT *, CAST(regexp_matches(s, '(?is)tion') AS INTEGER) + CAST(regexp_matches(s, '(?is)er') AS INTEGER) + 2 + least(nth, 5) AS score FROM sent
  WHERE length(s) >= 6 AND NOT {_PLAN} AND regexp_matches(s, '(?is)tion|er')),
once AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY session_id, s ORDER BY score DESC, pos DESC, i) = 1),
claims AS (SELECT session_id, 8 - row_number() OVER (PARTITION BY session_id ORDER BY score DESC, pos DESC, i) AS idx, s AS text, score FROM once QUALIFY idx >= 0)
"""


@query(_CLAIMS + "SELECT session_id, idx, text, score FROM claims")
def session_claims(spark, sf_dir):
    return S.choose_claims(_session_rows(spark, sf_dir), vocab=WORDS).select("session_id", "idx", "text", "score")


_SNIPPETS = _CLAIMS + f""", req AS (SELECT session_id, text, min(pos) AS pos FROM rows WHERE role = 'user' AND length(text) >= 2 GROUP BY ALL),
items AS (SELECT session_id, 0 AS grp, NULL AS pos, idx, text FROM claims UNION ALL SELECT session_id, 1, pos, 0, text FROM req),
si AS (SELECT * FROM ({_sentences('items', 'session_id, grp, pos, idx')}) WHERE length(s) >= 6 AND NOT {_PLAN}),
ex AS (SELECT session_id, grp, pos, idx, i, CASE WHEN length(s) <= 360 THEN s ELSE concat(rtrim(substring(s, 1, 359)), '…') END AS text, s FROM si)
"""


def _snippet_sql(where: str, order: str, k: int, kind: str) -> str:
    return (
        f"SELECT session_id, '{kind}' AS kind, text, row_number() OVER (PARTITION BY session_id ORDER BY {order}) AS nth FROM ("
        f"SELECT * FROM ex WHERE {where} QUALIFY row_number() OVER (PARTITION BY session_id, text ORDER BY {order}) = 1) QUALIFY nth <= {k}"
    )


@query(_SNIPPETS + _snippet_sql("grp = 1 AND regexp_matches(s, 'que|the|und|Que|The|Und')", "pos, i", 6, "correction") + " UNION ALL "
       + _snippet_sql("regexp_matches(s, '(?i)men?t|ing')", "grp, pos, idx, i", 8, "decision") + " UNION ALL "
       + _snippet_sql("regexp_matches(s, '(?i)ver|eau')", "grp, pos DESC, idx DESC, i", 8, "open"))
def session_snippets(spark, sf_dir):
    rows = _session_rows(spark, sf_dir)
    req, claims = S.distinct_requests(rows), S.choose_claims(rows, vocab=WORDS)
    parts = [("correction", S.corrections(req, vocab=WORDS)), ("decision", S.decisions(req, claims, vocab=WORDS)), ("open", S.open_items(req, claims, vocab=WORDS))]
    out = [p.select("session_id", F.lit(k).alias("kind"), "text", "nth") for k, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(_ROWS + """SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, arg_max(role, pos) AS source FROM rows GROUP BY 1""")
def session_bounds(spark, sf_dir):
    r = _session_rows(spark, sf_dir).select("tenant_id", "session_id", "ts", F.col("role").alias("source"), F.lit(None).cast("string").alias("cwd"),
                                            F.lit(0).alias("root_order"), F.lit("f").alias("path"), F.col("pos").alias("ordinal"))
    b = S.session_bounds(r)
    return b.select("session_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_ts", "last_ts")], "source")


_TITLE_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'), ' -')"


@query(_ROWS + f""", f AS (SELECT session_id, arg_min({_TITLE_CLEAN}, pos) AS u FROM rows WHERE role = 'user' GROUP BY 1)
SELECT r.session_id, coalesce(CASE WHEN r.session_id % 3 = 0 THEN concat('Title ', CAST(r.session_id AS VARCHAR)) END,
  CASE WHEN length(u) <= 90 THEN u ELSE concat(rtrim(substring(u, 1, 89)), '…') END, CAST(r.session_id AS VARCHAR)) AS title
FROM (SELECT DISTINCT session_id FROM rows) r LEFT JOIN f USING (session_id)""")
def session_titles(spark, sf_dir):
    rows = _session_rows(spark, sf_dir)
    given = rows.select("tenant_id", "session_id").distinct().withColumn(
        "title", F.when(F.col("session_id") % 3 == 0, F.concat(F.lit("Title "), F.col("session_id").cast("string"))))
    return S.session_titles(rows, rows, given).select("session_id", "title")
