"""One structured summary per session: requests, claims, evidence, decisions, open items, paths, status.

Inputs carry `tenant_id, session_id, pos` where `pos` is any orderable column (a number or a struct). Lists are built from
rows already cut to the list's fixed length, never from a whole session.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import vocab as V
from tracemill.functions import keys as K
from tracemill.functions import text as T
from tracemill.operators.grouping import ordered_list, top_rows
from tracemill.vocab import DEFAULT, Vocabulary

KEYS = ("tenant_id", "session_id")
MERGED_LISTS = ("goal", "claims", "verified", "open_items", "decisions", "corrections", "artifacts")


def session_bounds(records: DataFrame) -> DataFrame:
    """First and last time, last non-empty working directory and source, number of files."""
    return records.groupBy(*KEYS).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.struct("root_order", "path", "ordinal"))).alias("cwd"),
        F.max_by("source", F.when(F.col("source").isNotNull(), F.struct("root_order", "path", "ordinal"))).alias("source"),
    )


def session_files(records: DataFrame) -> DataFrame:
    """All source files of every session, one row each."""
    return records.select(*KEYS, "path").distinct()


def session_turns(messages: DataFrame, evidence: DataFrame) -> DataFrame:
    """All turn ids of every session, one row each."""
    ids = [d.select(*KEYS, "turn_id") for d in (messages, evidence)]
    return ids[0].unionByName(ids[1]).where("turn_id <> ''").distinct()


def distinct_requests(messages: DataFrame) -> DataFrame:
    """User texts of two or more characters, each at its first position."""
    users = messages.where((F.col("role") == "user") & (F.length("text") >= 2))
    return users.groupBy(*KEYS, "text").agg(F.min("pos").alias("pos"))


def session_titles(messages: DataFrame, sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Title from the index, else the start of the first request, else the start of the id."""
    first = messages.where("role = 'user'").groupBy(*KEYS).agg(F.min_by("text", "pos").alias("first_user"))
    return (
        sessions.select(*KEYS).distinct().join(titles.select(*KEYS, "title"), list(KEYS), "left").join(first, list(KEYS), "left")
        .select(*KEYS, F.coalesce(
            F.nullif("title", F.lit("")), F.nullif(T.excerpt(F.coalesce("first_user", F.lit("")), 90), F.lit("")),
            F.substring(F.col("session_id").cast("string"), 1, 12),
        ).alias("title"))
    )


def choose_claims(messages: DataFrame, *, k: int = 8, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Best result sentences of the assistant. `idx` runs from the weakest kept one (0) to the best.

    The score grows with the message's position up to the sixth message, so only the first five need a number.
    """
    said = messages.where((F.col("role") == "assistant") & (F.length("text") >= 8)).select(*KEYS, "pos", "text")
    early = top_rows(said.select(*KEYS, "pos"), KEYS, [F.col("pos")], 5, rank="nth").withColumn("nth", F.col("nth") - 1)
    sentences = (
        said.select(*KEYS, "pos", F.posexplode(T.split_sentences("text", vocab)).alias("i", "sentence"))
        .where(~F.col("sentence").rlike("[？?]$") & ~T.is_plan("sentence", vocab) & T.has_result(F.col("sentence"), vocab))
        .withColumn("hits", T.result_hits(F.col("sentence"), vocab))
    )
    scored = sentences.join(early, [*KEYS, "pos"], "left").withColumn("score", F.col("hits") + 2 + F.coalesce("nth", F.lit(5)))
    best = [F.desc("score"), F.desc("pos"), F.col("i")]
    once = top_rows(scored, [*KEYS, "sentence"], best, 1)
    kept = top_rows(once, KEYS, best, k, rank="r")
    return kept.select(*KEYS, (F.lit(k) - F.col("r")).alias("idx"), F.col("sentence").alias("text"), "score")


def labelled_snippets(
    items: DataFrame, patterns: Sequence[str], k: int, order: Sequence[Column], *, drop_done: bool = False, vocab: Vocabulary = DEFAULT
) -> DataFrame:
    """First `k` distinct sentences that match a pattern, in item order, without plans and past states.

    `drop_done` also drops sentences that start by saying something is done, unless they name something still open.
    """
    still = F.col("sentence").rlike(V.STILL_OPEN)
    keep = ~T.is_plan("sentence", vocab) & (~F.col("sentence").rlike(V.PAST_START) | still)
    if drop_done:
        keep = keep & (~F.col("sentence").rlike(V.DONE_START) | still)
    rows = items.select("*", F.posexplode(T.split_sentences("text", vocab)).alias("i", "sentence")).where(
        keep & F.col("sentence").rlike(T.any_pattern(patterns, "(?iU)"))
    )
    full = [*order, F.col("i")]
    once = top_rows(rows.withColumn("sentence", T.excerpt("sentence", 360)), [*KEYS, "sentence"], full, 1)
    return top_rows(once, KEYS, full, k, rank="nth").select(*KEYS, "nth", F.col("sentence").alias("text"))


def _items(requests: DataFrame, claims: DataFrame, requests_first: bool) -> DataFrame:
    req = requests.select(*KEYS, F.lit(0 if requests_first else 1).alias("grp"), "pos", F.lit(0).alias("idx"), "text")
    cl = claims.select(*KEYS, F.lit(1 if requests_first else 0).alias("grp"), F.lit(None).cast(requests.schema["pos"].dataType).alias("pos"), "idx", "text")
    return req.unionByName(cl)


def corrections(requests: DataFrame, *, k: int = 6, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return labelled_snippets(requests, [T.any_of([w]) for w in vocab.correction_markers], k, [F.col("pos")], vocab=vocab)


def decisions(requests: DataFrame, claims: DataFrame, *, k: int = 8, vocab: Vocabulary = DEFAULT) -> DataFrame:
    order = [F.col("grp"), F.col("pos"), F.col("idx")]
    return labelled_snippets(_items(requests, claims, False), vocab.decision_patterns, k, order, vocab=vocab)


def open_items(requests: DataFrame, claims: DataFrame, *, k: int = 8, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Latest first: claims from the best down, then requests from the newest back."""
    order = [F.col("grp"), F.desc("pos"), F.desc("idx")]
    words = [T.any_of([w]) for w in vocab.open_markers]
    return labelled_snippets(_items(requests, claims, False), words, k, order, drop_done=True, vocab=vocab)


def session_artifacts(requests: DataFrame, claims: DataFrame, evidence: DataFrame, *, k: int = 30) -> DataFrame:
    """First `k` distinct paths over requests, claims and tool outputs."""
    items = _items(requests, claims, True).unionByName(
        evidence.select(*KEYS, F.lit(2).alias("grp"), "pos", F.lit(0).alias("idx"), "text")
    )
    paths = items.select(*KEYS, "grp", "pos", "idx", F.posexplode(T.path_candidates("text")).alias("i", "path"))
    order = [F.col(c) for c in ("grp", "pos", "idx", "i")]
    once = top_rows(paths, [*KEYS, "path"], order, 1)
    return top_rows(once, KEYS, order, k, rank="nth").select(*KEYS, "nth", F.col("path").alias("text"))


def session_status(sessions: DataFrame, events: DataFrame, evidence: DataFrame) -> DataFrame:
    """done, blocked or in_progress: the last lifecycle event decides, else failures among the last four tool outputs."""
    done, blocked = ["task_complete", "task_completed"], ["task_aborted", "turn_aborted", "error"]
    ends = F.when(F.col("event_type").isin(done), "done").when(F.col("event_type").isin(blocked), "blocked")
    last = events.groupBy(*KEYS).agg(
        F.max_by(ends, "pos").alias("last"), F.max_by(ends, F.when(ends.isNotNull(), F.col("pos"))).alias("last_end"),
    )
    newest = top_rows(evidence.select(*KEYS, "pos", "text"), KEYS, [F.desc("pos")], 4)
    failing = newest.groupBy(*KEYS).agg(
        F.bool_or(F.contains("text", F.lit(V.FAILURE_WORD)) | F.contains(F.lower("text"), F.lit("error"))).alias("failing")
    )
    joined = sessions.select(*KEYS).distinct().join(last, list(KEYS), "left").join(failing, list(KEYS), "left")
    return joined.select(*KEYS, F.when(F.col("last").isNotNull(), F.col("last")).when(
        F.coalesce("failing", F.lit(False)) & ~F.col("last_end").eqNullSafe("done"), "blocked").otherwise("in_progress").alias("status"))


def _listed(rows: DataFrame, name: str, order: str) -> DataFrame:
    return rows.groupBy(*KEYS).agg(ordered_list("text", order).alias(name))


def session_summaries(tables, titles: DataFrame, *, tz: str = "Asia/Shanghai", as_of: Column | None = None, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """All summaries. `tables` is the result of `session_tables`; sessions without messages and evidence are left out.

    Source files and turn ids, which have no fixed number, stay in `session_files` and `session_turns`.
    """
    messages, evidence = tables.messages, tables.evidence
    keys = list(KEYS)
    present = messages.select(*KEYS).unionByName(evidence.select(*KEYS)).distinct()
    requests = distinct_requests(messages)
    claims = choose_claims(messages, vocab=vocab)
    goal = requests.groupBy(*KEYS).agg(F.min_by("text", "pos").alias("first"), F.max_by("text", "pos").alias("latest"))
    goal = goal.select(*KEYS, F.when(F.col("first") == F.col("latest"), F.array("first")).otherwise(
        F.array(F.col("first"), F.concat(F.lit(V.LATEST_REQUEST_LABEL), "latest"))).alias("goal"))
    verified = top_rows(evidence.where("verified").select(*KEYS, "pos", "text"), KEYS, [F.desc("pos")], 8)
    parts = [
        session_bounds(tables.records), session_titles(messages, present, titles), session_status(present, tables.events, evidence), goal,
        _listed(claims.where("idx >= 3"), "claims", "idx"), _listed(verified, "verified", "pos"),
        _listed(corrections(requests, vocab=vocab), "corrections", "nth"), _listed(open_items(requests, claims, vocab=vocab), "open_items", "nth"),
        _listed(decisions(requests, claims, vocab=vocab), "decisions", "nth"),
        _listed(session_artifacts(requests, claims, evidence), "artifacts", "nth"),
        messages.groupBy(*KEYS).agg(F.count("*").cast("int").alias("message_count")),
        evidence.groupBy(*KEYS).agg(F.count_if("verified").cast("int").alias("evidence_count")),
        session_files(tables.records).groupBy(*KEYS).agg(F.count("*").cast("int").alias("source_count")),
    ]
    joined = reduce(lambda a, b: a.join(b, keys, "left"), parts, present)
    empty = F.array().cast("array<string>")
    day = F.coalesce(F.col("first_ts"), F.current_timestamp() if as_of is None else as_of)
    return joined.select(
        *KEYS, K.day_of(day, tz).alias("date"), F.col("last_ts").alias("updated"), T.project_name("cwd").alias("project"),
        F.coalesce("cwd", F.lit("")).alias("cwd"), F.coalesce("source", F.lit("")).alias("source"), "status", "title",
        *[F.coalesce(c, empty).alias(c) for c in MERGED_LISTS],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("message_count", "evidence_count", "source_count")],
        F.lit("exact").alias("count_quality"),
    )


def merge_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Kept index merged with a rebuild; history is never lost to a partial source.

    An older rebuild, or a shorter one that is not newer, leaves the kept row. A shorter but newer one appends to its lists and
    marks its counts as lower bounds. Anything else replaces the kept row.
    """
    keys = list(KEYS)
    fields = [c for c in new.columns if c not in KEYS]
    a = old.select(*KEYS, F.struct(*fields).alias("a"))
    b = new.select(*KEYS, F.struct(*fields).alias("b"))
    oldest = F.lit("0001-01-01").cast("timestamp")
    ua, ub = F.coalesce("a.updated", oldest), F.coalesce("b.updated", oldest)
    shorter = F.col("b.message_count") < F.col("a.message_count")
    action = (
        F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing_source").when(ub < ua, "kept")
        .when(shorter & (ub <= ua), "kept").when(shorter, "appended").otherwise("replaced")
    )

    def pick(c):
        kept = F.when(F.col("action").isin("missing_source", "kept"), F.col(f"a.{c}"))
        if c in MERGED_LISTS:
            return kept.when(F.col("action") == "appended", F.array_distinct(F.concat(f"a.{c}", f"b.{c}"))).otherwise(F.col(f"b.{c}")).alias(c)
        if c in ("message_count", "evidence_count", "source_count"):
            return kept.when(F.col("action") == "appended", F.greatest(f"a.{c}", f"b.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
        if c == "count_quality":
            return kept.when(F.col("action") == "appended", F.lit("lower_bound_partial_source")).otherwise(F.col(f"b.{c}")).alias(c)
        return kept.otherwise(F.col(f"b.{c}")).alias(c)

    return a.join(b, keys, "full").withColumn("action", action).select(*KEYS, *map(pick, fields), "action")


def merge_session_rows(old: DataFrame, new: DataFrame, merged: DataFrame) -> DataFrame:
    """Files or turn ids (a row each, with the session's keys) after `merge_summaries`, whose rows with their `action` are `merged`: the
    old ones where a session was kept or missing, the new ones where it is new or replaced, both where the rebuild was appended."""
    def of(rows: DataFrame, *actions: str) -> DataFrame:
        return rows.join(merged.where(F.col("action").isin(*actions)).select(*KEYS).distinct(), list(KEYS), "left_semi")

    return of(old, "kept", "missing_source", "appended").unionByName(of(new, "new", "replaced", "appended")).distinct()


def index_health(merged: DataFrame, checked_at: Column) -> DataFrame:
    """One row of counts about a merge."""
    return merged.agg(
        F.count("*").alias("indexed_sessions"), F.count_if(F.col("action") != "missing_source").alias("source_sessions"),
        F.count_if(F.col("action") == "missing_source").alias("retained_missing_source"),
        F.count_if(F.col("action").isin("kept", "appended")).alias("retained_partial_source"),
    ).withColumn("checked_at", checked_at)


# ---- rollups --------------------------------------------------------------------------------------------------------
_UNFINISHED = ("in_progress", "blocked")


def rollup_by_day(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("tenant_id", "date").agg(
        F.count("*").alias("sessions"), F.sum("evidence_count").alias("evidence"), F.count_if(F.col("status").isin(*_UNFINISHED)).alias("unfinished"),
        F.max("updated").alias("updated"),
    )


def rollup_by_project(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("tenant_id", "project").agg(
        F.count("*").alias("sessions"), F.max_by("date", F.struct("updated", "session_id")).alias("latest_date"),
        F.sum("evidence_count").alias("evidence"),
    )


def project_recent(summaries: DataFrame, k: int = 12) -> DataFrame:
    """Newest sessions per project with their last two claims, signals and open items."""
    recent = top_rows(summaries, ["tenant_id", "project"], [F.desc("updated"), F.desc("session_id")], k, rank="position")
    return recent.select("tenant_id", "project", "position", "session_id", "title", "status", "evidence_count", *[
        F.when(F.size(c) > 2, F.slice(c, -2, 2)).otherwise(F.col(c)).alias(c) for c in ("claims", "verified", "open_items")])


def rollup_items(summaries: DataFrame, field: str, k: int = 6) -> DataFrame:
    """First items of one list field per session; open items only of unfinished sessions, which get a notice if they have none."""
    src, items = summaries, F.slice(field, 1, k)
    if field == "open_items":
        src = src.where(F.col("status").isin(*_UNFINISHED))
        items = F.when(F.size(field) > 0, items).otherwise(F.array(F.lit("状态仍未终结，请查看验证证据。")))
    return src.select("tenant_id", "session_id", "project", "date", "status", F.posexplode(items).alias("position", "item"))


def index_totals(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("tenant_id").agg(
        F.count("*").alias("sessions"), F.count_distinct("project").alias("projects"),
        F.count_if(F.col("status").isin(*_UNFINISHED)).alias("unfinished"), F.count_if(F.size("verified") > 0).alias("with_evidence"),
    )
