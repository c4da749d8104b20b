"""Queries over notes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tracemill.functions import keys as K
from tracemill.functions import text as T
from tracemill.operators import errors as E
from tracemill.operators import notes as N
from tracemill.plans.adapters import ctes, given, shape
from tracemill.plans.registry import query
from tracemill.vocab import DEFAULT

WORDS = replace(DEFAULT, preference_words="(?i)queaux|undsch", incident_words="(?i)tion|ung")
_TITLE = "trim(regexp_replace(trim(split_part(body, chr(10), 1), E' \\t\\r'), '^#\\s*', ''), E' \\t\\r')"
_NOTES = ctes("notes") + f", titled AS (SELECT * FROM (SELECT *, {_TITLE} AS title FROM notes) WHERE title <> '')"


def _notes(spark, sf_dir):
    return N.titled_notes(shape(spark, sf_dir, "notes"))


@query(_NOTES + "SELECT path, title, directory FROM titled")
def titled_notes(spark, sf_dir):
    return _notes(spark, sf_dir).select("path", "title", "directory")


@query(_NOTES + "SELECT path, directory, title, count(*) OVER (PARTITION BY directory) - 1 AS siblings, 'INDEX' AS index_link FROM titled")
def related_note_links(spark, sf_dir):
    return N.related_links(_notes(spark, sf_dir))


@query(_NOTES + """, newest AS (SELECT directory, path FROM titled QUALIFY row_number() OVER (PARTITION BY directory ORDER BY day DESC, path) = 1)
SELECT n.path AS from_path, t.path, t.title FROM newest n JOIN titled t USING (directory) WHERE t.path <> n.path""")
def sibling_links_of_newest(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    from tracemill.operators.grouping import top_rows

    newest = top_rows(notes.select("directory", "path", "day"), ["directory"], [F.desc("day"), F.col("path")], 1)
    return N.sibling_links(notes, newest)


_DATED = _NOTES + """, dated AS (SELECT doc_id, directory AS project, title, CASE WHEN doc_id % 7 = 0 THEN '未知日期' ELSE CAST(day AS VARCHAR) END AS day,
  concat(CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat(CAST(day AS VARCHAR), '-') END, CAST(doc_id AS VARCHAR)) AS name FROM titled)
"""


def _dated(spark, sf_dir):
    n = _notes(spark, sf_dir)
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.col("day").cast("string"), F.lit("-"))), F.col("doc_id").cast("string"))
    return n.withColumn("project", F.col("directory")).withColumn("path", F.concat("directory", F.lit("/"), name, F.lit(".md")))


@query(_DATED + """SELECT project, name, day, row_number() OVER (PARTITION BY project ORDER BY day, title, name) AS position,
min(day) OVER (PARTITION BY project) AS first_day, count(*) OVER (PARTITION BY project) AS notes FROM dated""")
def project_timeline(spark, sf_dir):
    return N.project_timeline(_dated(spark, sf_dir)).select("project", "name", "day", "position", "first_day", "notes")


@query(ctes("notes") + "SELECT directory, count(*) AS notes, CAST(sum(length(body)) AS BIGINT) AS chars FROM notes GROUP BY 1")
def note_stats(spark, sf_dir):
    return N.note_stats(shape(spark, sf_dir, "notes"))


@query(_NOTES + "SELECT path, title FROM titled ORDER BY day DESC, title DESC, path DESC LIMIT 5")
def recent_notes(spark, sf_dir):
    return N.recent_notes(_notes(spark, sf_dir).withColumn("modified", F.col("day"))).select("path", "title")


@query(_DATED + "SELECT name FROM dated WHERE starts_with(name, '2024-02-10') OR (NOT starts_with(name, '2024-02') AND doc_id % 90 = 40)")
def notes_of_day(spark, sf_dir):
    n = _dated(spark, sf_dir).withColumn("modified", F.col("day").cast("timestamp"))
    return N.notes_of_day(n, "2024-02-10").select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("name"))


@query(_DATED + "SELECT name FROM dated WHERE contains(name, '2024-02-10')")
def notes_of_day_loose(spark, sf_dir):
    return N.notes_of_day(_dated(spark, sf_dir), "2024-02-10", loose=True).select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("name"))


@query(_NOTES + """, body AS (SELECT path, directory, body, doc_id,
  trim(array_to_string(list_filter(string_split(body, chr(10)), lambda l, i: true), chr(10)), E' \\n\\t\\r') AS b FROM titled)
SELECT path, directory, CAST(doc_id AS VARCHAR) AS title, count(*) OVER (PARTITION BY directory) AS area_notes,
  md5(concat(substring(b, 1, 300), CASE WHEN length(b) > 300 THEN '...' ELSE '' END)) AS digest FROM body""")
def area_summaries(spark, sf_dir):
    n = _notes(spark, sf_dir)
    return N.area_summary(n).select("path", "directory", "title", "area_notes", F.md5("summary").alias("digest"))


@query(_NOTES + """, w AS (SELECT unnest(list_distinct(regexp_extract_all(title, '[A-Za-z]{2,}'))) AS word FROM titled)
SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 2""")
def repeated_themes(spark, sf_dir):
    return E.repeated_themes(_notes(spark, sf_dir))


_NAMES = """, bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9-]+') AS w FROM benchmark),
names AS (SELECT DISTINCT name FROM (SELECT unnest(w) AS name FROM bw UNION ALL SELECT concat(w[1], ' ', w[2]) FROM bw UNION ALL SELECT concat(w[2], ' ', w[3], ' ', w[4]) FROM bw) WHERE length(name) >= 6)
"""


def _names(spark, sf_dir):
    w = given(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9-]+"), 0).alias("w"))
    two = F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)))
    three = F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2)), F.get("w", F.lit(3)))
    return w.select(F.explode("w").alias("name")).unionByName(w.select(two.alias("name"))).unionByName(w.select(three.alias("name"))).distinct()


@query(ctes("notes") + _NAMES + """SELECT name, count(*) AS mentions FROM names JOIN notes ON contains(lower(body), name)
WHERE regexp_matches(lower(body), concat('(^|[^a-z0-9-])', name, '($|[^a-z0-9-])')) GROUP BY name""")
def skill_mentions_in_notes(spark, sf_dir):
    return N.skill_mentions(_names(spark, sf_dir), shape(spark, sf_dir, "notes"))


@query(ctes("notes") + """, cl AS (SELECT item_id AS cluster_key, text AS title FROM benchmark),
t AS (SELECT cluster_key, w, count(*) AS times FROM (SELECT cluster_key, unnest(regexp_split_to_array(lower(title), '[\\s/._-]+')) AS w FROM cl) WHERE length(w) >= 4 GROUP BY ALL),
s AS (SELECT cluster_key, path, sum(times) AS score FROM t JOIN notes ON contains(lower(body), w) GROUP BY ALL HAVING sum(times) >= 2)
SELECT cluster_key, path, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY cluster_key ORDER BY path) AS position FROM s QUALIFY position <= 3""")
def cluster_solutions(spark, sf_dir):
    b = given(spark, sf_dir, "benchmark")
    clusters = b.select(F.col("item_id").alias("cluster_key"), F.col("text").alias("title"))
    return N.cluster_solutions(clusters, shape(spark, sf_dir, "notes"))


def _dated_notes(spark, sf_dir):
    """Notes with their time of change; every ninth has a name that starts with `_`, every seventh lies in a directory of the system's own."""
    n = shape(spark, sf_dir, "notes").withColumnRenamed("day", "modified")
    name = F.concat(F.when(F.col("doc_id") % 9 == 0, "_").otherwise(""), F.col("doc_id").cast("string"), F.lit(".md"))
    area = F.element_at(F.array(*map(F.lit, ("daily", "projects", "drafts"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return n.withColumn("path", F.concat(area, F.lit("/"), F.when(F.col("doc_id") % 7 == 0, "skill-evolution/").otherwise(""), name))


_DATED = ctes("notes").replace("notes AS (", "given_notes AS (") + """, notes AS (SELECT doc_id, body, day AS modified, concat(['daily', 'projects', 'drafts'][doc_id % 3 + 1], '/', CASE WHEN doc_id % 7 = 0 THEN 'skill-evolution/' ELSE '' END,
  CASE WHEN doc_id % 9 = 0 THEN '_' ELSE '' END, CAST(doc_id AS VARCHAR), '.md') AS path FROM given_notes)"""


@query(_DATED + _NAMES + """SELECT name, count(*) AS mentions FROM names JOIN notes ON contains(lower(body), name)
WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0 AND modified BETWEEN DATE '2024-02-01' AND DATE '2024-05-01' AND regexp_matches(lower(body), concat('(^|[^a-z0-9-])', name, '($|[^a-z0-9-])')) GROUP BY name""")
def skill_mentions_90d(spark, sf_dir):
    notes = N.notes_in_window(_dated_notes(spark, sf_dir), F.lit("2024-05-01"), 90, skip=("skill-evolution",))
    return N.skill_mentions(_names(spark, sf_dir), notes)


@query(_DATED + """, cl AS (SELECT item_id AS cluster_key, text AS title FROM benchmark),
t AS (SELECT cluster_key, w, count(*) AS times FROM (SELECT cluster_key, unnest(regexp_split_to_array(lower(title), '[\\s/._-]+')) AS w FROM cl) WHERE length(w) >= 4 GROUP BY ALL),
s AS (SELECT cluster_key, path, sum(times) AS score FROM t JOIN notes ON contains(lower(body), w) WHERE doc_id % 9 <> 0 AND doc_id % 3 <> 2 AND modified BETWEEN DATE '2024-02-17' AND DATE '2024-08-15' GROUP BY ALL HAVING sum(times) >= 2)
SELECT cluster_key, path, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY cluster_key ORDER BY path) AS position FROM s QUALIFY position <= 3""")
def cluster_solutions_180d(spark, sf_dir):
    b = given(spark, sf_dir, "benchmark")
    notes = N.notes_in_window(_dated_notes(spark, sf_dir), F.lit("2024-08-15"), 180, areas=("preferences", "projects", "incidents", "daily"))
    return N.cluster_solutions(b.select(F.col("item_id").alias("cluster_key"), F.col("text").alias("title")), notes)


@query(_DATED + """, t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders WHERE o_orderdate < DATE '2024-12-01')
SELECT as_of::VARCHAR AS as_of, count(*) AS notes FROM t JOIN notes ON modified BETWEEN as_of - 30 AND as_of WHERE doc_id % 9 <> 0 GROUP BY 1""")
def notes_by_window(spark, sf_dir):
    """How many notes each day of the orders sees in the 30 days before it."""
    times = given(spark, sf_dir, "orders").where("o_orderdate < '2024-12-01'").select(F.to_date("o_orderdate").alias("as_of"))
    rows = N.notes_in_window(_dated_notes(spark, sf_dir), times, 30)
    return rows.groupBy(F.to_date("as_of").cast("string").alias("as_of")).agg(F.count("*").alias("notes"))


_ROUTE = ctes("notes") + """, inc AS (SELECT doc_id AS note_id, CASE doc_id % 5 WHEN 0 THEN 'incidents' WHEN 1 THEN '../x' WHEN 2 THEN concat('p ', CAST(doc_id % 3 AS VARCHAR)) ELSE '' END AS tag,
  concat(substring(body, 1, 40), ' ', body) AS t FROM notes),
pr AS (SELECT concat(substring(text, 1, 9), '-', CAST(item_id AS VARCHAR)) AS project FROM benchmark),
sh AS (SELECT substring(regexp_replace(project, '[:： ]', '', 'g'), 1, 4) AS short, min(project) AS project FROM pr GROUP BY 1),
f AS (SELECT note_id, min(sh.project) AS project FROM inc JOIN sh ON contains(t, short) WHERE tag IN ('', '../x') GROUP BY 1)
SELECT i.note_id, CASE WHEN tag = 'incidents' THEN 'incidents' WHEN tag NOT IN ('', '../x') THEN concat('projects/', replace(tag, ' ', ''))
  WHEN f.project IS NOT NULL THEN concat('projects/', f.project) WHEN regexp_matches(t, '(?i)queaux|undsch') THEN 'preferences'
  WHEN regexp_matches(t, '(?i)tion|ung') THEN 'incidents' ELSE 'daily' END AS area FROM inc i LEFT JOIN f USING (note_id)"""


def _incoming(spark, sf_dir):
    k = F.col("doc_id")
    tag = F.when(k % 5 == 0, "incidents").when(k % 5 == 1, "../x").when(k % 5 == 2, F.concat(F.lit("p "), (k % 3).cast("string"))).otherwise("")
    return shape(spark, sf_dir, "notes").select(k.alias("note_id"), tag.alias("tag"), F.substring("body", 1, 40).alias("title"), F.col("body").alias("content"), "day")


def _projects(spark, sf_dir):
    return given(spark, sf_dir, "benchmark").select(F.concat(F.substring("text", 1, 9), F.lit("-"), F.col("item_id").cast("string")).alias("project"))


@query(_ROUTE)
def routed_notes(spark, sf_dir):
    return N.route_notes(_incoming(spark, sf_dir), _projects(spark, sf_dir), vocab=WORDS).select("note_id", "area")


@query(ctes("notes") + """, b AS (SELECT doc_id, directory, concat(CAST(day AS VARCHAR), '-', coalesce(nullif(substring(trim(regexp_replace(replace(body, ' ', '-'), '[^\\p{L}\\p{M}\\p{N}_-]', '-', 'g'), '-'), 1, 50), ''), 'untitled')) AS base FROM notes)
SELECT doc_id AS note_id, concat(base, CASE WHEN n > 1 THEN concat('-', CAST(n AS VARCHAR)) ELSE '' END, '.md') AS file_name FROM (
  SELECT *, row_number() OVER (PARTITION BY directory, base ORDER BY doc_id) AS n FROM b)""")
def note_file_names(spark, sf_dir):
    n = shape(spark, sf_dir, "notes").select(F.col("doc_id").alias("note_id"), F.col("directory").alias("area"), F.col("body").alias("title"), "day")
    return N.unique_names(n, chunk=F.floor(F.col("note_id") / 100000)).select("note_id", "file_name")


@query(ctes("notes") + """, c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('## 摘要', chr(10), CASE doc_id % 2 WHEN 0 THEN concat(directory, ' ', lang) ELSE body END, chr(10), '## next') WHEN 1 THEN concat('## 摘要 x', chr(10), body) ELSE body END AS content FROM notes)
SELECT doc_id AS note_id, CASE WHEN doc_id % 3 = 2 THEN 'no_summary' WHEN length(regexp_replace(CASE doc_id % 3 WHEN 0 THEN substring(split_part(content, concat(chr(10), '## next'), 1), 7) ELSE
  regexp_replace(substring(content, 9), '(?s)\\n##.*$', '') END, '\\s', '', 'g')) < 10 THEN 'summary_too_short' ELSE 'accepted' END AS verdict FROM c""")
def gated_notes(spark, sf_dir):
    k = F.col("doc_id")
    body = F.when(k % 3 == 0, F.concat(F.lit("## 摘要\n"), F.when(k % 2 == 0, F.concat_ws(" ", "directory", "lang")).otherwise(F.col("body")), F.lit("\n## next"))).when(
        k % 3 == 1, F.concat(F.lit("## 摘要 x\n"), F.col("body"))).otherwise(F.col("body"))
    ok, bad = N.gate_notes(shape(spark, sf_dir, "notes").select(k.alias("note_id"), body.alias("content")))
    return ok.select("note_id", F.lit("accepted").alias("verdict")).unionByName(bad.select("note_id", F.col("reason").alias("verdict")))


_KEYWORD = "quer"


@query(_NOTES.replace(f", titled AS (SELECT * FROM (SELECT *, {_TITLE} AS title FROM notes) WHERE title <> '')", f""", l AS (
  SELECT path, {_TITLE} AS title, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM notes WHERE contains(lower(body), '{_KEYWORD}')),
c AS (SELECT *, contains(line, '{_KEYWORD}') OR coalesce(contains(lag(line) OVER w, '{_KEYWORD}'), false) OR coalesce(contains(lead(line) OVER w, '{_KEYWORD}'), false) AS keep FROM l WINDOW w AS (PARTITION BY path ORDER BY i)),
k AS (SELECT *, lag(i) OVER (PARTITION BY path ORDER BY i) AS before FROM c WHERE keep),
o AS (SELECT path, i * 2 AS pos, concat(CAST(i AS VARCHAR), ':', line) AS t FROM k UNION ALL SELECT path, i * 2 - 1, '--' FROM k WHERE before < i - 1),
r AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY path ORDER BY pos) <= 5)
SELECT p.path, p.title, md5(coalesce(string_agg(t, ' ' ORDER BY pos), '')) AS digest FROM (SELECT DISTINCT path, title FROM l) p LEFT JOIN r USING (path) GROUP BY ALL"""))
def keyword_lines(spark, sf_dir):
    return N.keyword_lines(shape(spark, sf_dir, "notes"), _KEYWORD).select("path", "title", F.md5("match").alias("digest"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_-]{2,}'))), ' ') AS terms FROM documents""")
def search_terms(spark, sf_dir):
    d = given(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(F.array_sort(K.terms("text")), " ").alias("terms"))


_PATHS = r"""WITH src AS (SELECT doc_id, concat('see 12:n/Users/', source, '/a.py:', CAST(doc_id AS VARCHAR), ', ./', source, '/run.sh and ./.git/HEAD /tmp/', lang, '/x', CAST(doc_id % 5 AS VARCHAR), '. ', text) AS t FROM documents),
m AS (SELECT doc_id, unnest(f) AS p, generate_subscripts(f, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t,
  '(?i)(?:(?:/Users|/Volumes|/tmp|/var/folders|~/|\.\.?/)[^\s`<>"''|)\],;]+|(?:[\w./-]+/)(?:[^\s`<>"''|)\],;]+\.(?:py|sh|md|jsonl?|db|png|html|toml|yaml|yml|log|txt)))') AS f FROM src)),
c AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '[.,:;，。；]+$', ''), ':\d+$', ''), '^\./', ''), '^n/Users/', '/Users/') AS p FROM m),
k AS (SELECT doc_id, p, min(i) AS i FROM c WHERE length(p) >= 4 AND NOT regexp_matches(p, '[/\\]$|(^|/)\.git(/|$)|^http|[${}]|GATE_|VAULT/|^(a/|b/|tmp/)|…|codex-clipboard') GROUP BY ALL)
SELECT doc_id, string_agg(p, ' ' ORDER BY i) AS paths FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 30) GROUP BY 1"""


@query(_PATHS)
def document_paths(spark, sf_dir):
    d = given(spark, sf_dir, "documents")
    t = F.concat(F.lit("see 12:n/Users/"), "source", F.lit("/a.py:"), F.col("doc_id").cast("string"), F.lit(", ./"), "source", F.lit("/run.sh and ./.git/HEAD /tmp/"),
                 "lang", F.lit("/x"), (F.col("doc_id") % 5).cast("string"), F.lit(". "), "text")
    return d.select("doc_id", F.array_join(T.artifacts(F.array(t)), " ").alias("paths")).where("paths <> ''")
