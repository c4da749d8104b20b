"""Versioned experience with quoted evidence: current state, checks, briefs, feedback and statistics.

`versions` is append-only; the current row of a memory is derived from the highest revision. Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import vocab as V
from tracemill.functions import keys as K
from tracemill.functions import text as T
from tracemill.operators.grouping import ordered_list, top_rows
from tracemill.session import materialize

CONTENT = ("task_family", "scope", "conditions", "recommended_action", "avoid")
_REF = "array<struct<path:string,quote:string>>"


def heads(versions: DataFrame) -> DataFrame:
    """Current version of every memory."""
    return top_rows(versions, ["memory_id"], [F.desc("revision")], 1)


def load_experiences(versions: DataFrame, *, include_candidates: bool = False) -> DataFrame:
    allowed = ("active", "candidate") if include_candidates else ("active",)
    return heads(versions).where(F.col("status").isin(*allowed))


def version_history(versions: DataFrame) -> DataFrame:
    """Every version with its parent and whether a later one closed it. Revisions of a memory run 1, 2, 3, ..."""
    last = versions.groupBy("memory_id").agg(F.max("revision").alias("_last"))
    return versions.join(last, "memory_id").withColumn("parent_revision", F.when(F.col("revision") > 1, F.col("revision") - 1)).withColumn(
        "closed", F.col("revision") < F.col("_last")).drop("_last")


def checked_refs(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """References with `holds`: the document exists and contains the quote. Joined on the path, never on the text."""
    docs = documents.select("path", F.col("text").alias("_doc"))
    return refs.join(docs, "path", "left").withColumn(
        "holds", F.coalesce(F.contains("_doc", F.col("quote")) & (T.strip("quote") != ""), F.lit(False))).drop("_doc")


def lost_evidence(checked: DataFrame) -> DataFrame:
    """Memories with at least one reference that no longer holds."""
    return checked.where(~F.col("holds")).groupBy("memory_id").agg(F.count("*").alias("lost"))


def head_refs(current: DataFrame) -> DataFrame:
    return current.select("memory_id", "revision", F.explode("evidence_refs").alias("r")).select("memory_id", "revision", "r.path", "r.quote")


def checked_heads(current: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(experiences whose quotes all hold, warnings for the others)."""
    lost = lost_evidence(checked_refs(head_refs(current), documents))
    bare = current.where(F.size("evidence_refs") <= 0).select("memory_id").withColumn("lost", F.lit(0).cast("long"))
    bad = lost.unionByName(bare)
    kept = current.join(bad, "memory_id", "left_anti")
    warnings = current.join(bad, "memory_id").select("memory_id", "revision", F.when(F.col("lost") > 0, "quotation_lost").otherwise("no_quotation").alias("reason"))
    return kept, warnings


def remember(versions: DataFrame, batch: DataFrame, documents: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected requests with a reason).

    Batch: `pos, memory_id, <content>, evidence_level, status, evidence_refs, expected_revision, supersedes, supersedes_revision`.
    Of several writes to one memory the first wins and the others are stale. Retrying what is already current is accepted silently.
    """
    clean = batch.select(
        "pos", "memory_id", *[T.strip(F.coalesce(c, F.lit(""))).alias(c) for c in CONTENT], F.coalesce("evidence_level", F.lit("unverified")).alias("evidence_level"),
        "status", "evidence_refs", "expected_revision", "supersedes", "supersedes_revision")
    clean = clean.withColumn("status", F.coalesce("status", F.when(F.col("evidence_level") == "unverified", "candidate").otherwise("active")))
    unique_refs = F.array_sort(F.array_distinct(F.transform(F.coalesce("evidence_refs", F.array().cast(_REF)), lambda r: F.struct(r["path"].alias("path"), r["quote"].alias("quote")))))
    clean = clean.withColumn("evidence_refs", unique_refs).withColumn(
        "memory_id", F.coalesce("memory_id", K.content_id(*[F.col(c) for c in CONTENT], prefix="mem-", digits=20)))
    refs = checked_refs(clean.select("pos", F.explode("evidence_refs").alias("r")).select("pos", "r.path", "r.quote"), documents)
    broken = refs.where(~F.col("holds")).select("pos").distinct().withColumn("broken", F.lit(True))
    now = heads(versions)
    old = now.select("memory_id", F.struct("revision", "status", "evidence_level", "evidence_refs", "parent_revision", *CONTENT).alias("old"))
    parent = now.select(F.col("memory_id").alias("supersedes"), F.struct("*").alias("parent"))
    first = clean.groupBy("memory_id").agg(F.min("pos").alias("first_pos"))
    j = clean.join(broken, "pos", "left").join(old, "memory_id", "left").join(parent, "supersedes", "left").join(first, "memory_id")
    same = F.col("old").isNotNull()
    for c in (*CONTENT, "evidence_level", "status"):
        same = same & F.col(c).eqNullSafe(F.col(f"old.{c}"))
    same = same & (F.to_json("evidence_refs") == F.to_json(F.transform("old.evidence_refs", lambda r: F.struct(r["path"].alias("path"), r["quote"].alias("quote")))))
    expected = F.col("expected_revision")
    retry = same & (expected.isNull() | (expected == F.col("old.revision")) | expected.eqNullSafe(F.col("old.parent_revision")))
    wants = F.col("supersedes").isNotNull()
    reason = (
        F.when((F.col("task_family") == "") | (F.col("scope") == "") | (F.col("recommended_action") == ""), "missing_field")
        .when(~F.col("evidence_level").isin(*V.EVIDENCE_LEVELS) | ~F.col("status").isin("active", "candidate"), "unsupported_level_or_status")
        .when((F.col("evidence_level") == "unverified") & (F.col("status") != "candidate"), "unverified_must_be_candidate")
        .when((F.size("evidence_refs") == 0) | F.col("broken"), "quotation_not_found")
        .when(~F.col("memory_id").rlike(r"^[A-Za-z0-9_.:-]{1,160}$"), "invalid_memory_id")
        .when(retry, "retry")
        .when(F.col("pos") != F.col("first_pos"), "stale_revision")
        .when(F.col("old").isNotNull() & ~expected.eqNullSafe(F.col("old.revision")), "stale_revision")
        .when(F.col("old.status") == "superseded", "superseded_memory")
        .when(F.col("old").isNull() & (F.coalesce(expected, F.lit(0)) != 0), "no_parent_revision")
        .when(wants & (F.col("old").isNotNull() | (F.col("status") != "active")), "successor_must_be_new_and_active")
        .when(wants & (F.col("parent").isNull() | ~F.col("parent.revision").eqNullSafe(F.col("supersedes_revision")) | (F.col("parent.status") == "superseded")), "stale_parent")
        .when(wants & ((F.col("parent.scope") != F.col("scope")) | (F.col("parent.task_family") != F.col("task_family"))), "successor_changes_scope")
    )
    judged = materialize(j.withColumn("reason", reason), "judged")
    ok = judged.where("reason IS NULL")
    # two writes of one batch may not close the same parent
    closers = ok.where(wants).groupBy("supersedes").agg(F.min("pos").alias("_closer"))
    ok = ok.join(closers, "supersedes", "left").withColumn("reason", F.when(wants & (F.col("pos") != F.col("_closer")), "stale_parent"))
    done = ok.where("reason IS NULL")
    source_count = F.size(F.array_distinct(F.transform("evidence_refs", lambda r: r["path"])))
    written = done.select(
        "memory_id", F.coalesce(F.col("old.revision") + 1, F.lit(1)).cast("int").alias("revision"), F.col("old.revision").cast("int").alias("parent_revision"), *CONTENT,
        "evidence_level", "status", F.lit(None).cast("string").alias("superseded_by"), "evidence_refs", source_count.alias("source_count"), as_of.alias("updated_at"))
    closed = done.where(wants).select(
        F.col("parent.memory_id").alias("memory_id"), (F.col("parent.revision") + 1).cast("int").alias("revision"), F.col("parent.revision").cast("int").alias("parent_revision"),
        *[F.col(f"parent.{c}").alias(c) for c in CONTENT], F.col("parent.evidence_level").alias("evidence_level"), F.lit("superseded").alias("status"),
        F.col("memory_id").alias("superseded_by"), F.col("parent.evidence_refs").alias("evidence_refs"), F.col("parent.source_count").alias("source_count"), as_of.alias("updated_at"))
    rejected = judged.where("reason IS NOT NULL AND reason <> 'retry'").select("pos", "memory_id", "reason").unionByName(ok.where("reason IS NOT NULL").select("pos", "memory_id", "reason"))
    return written.unionByName(closed), rejected


def brief(tasks: DataFrame, experiences: DataFrame, *, max_chars: int = 2400, k: int = 5, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen experiences per task, one receipt per task).

    Tasks: `task_id, query, family, project`. Experiences carry `chunk`, the text that would be shown. Candidates share a term
    with the query (or the family when there is no query), rank by shared terms and own project, and are packed greedily: what
    does not fit is skipped. A receipt tells when (`as_of`, else now) and within how many characters it was made; the time is part of its id,
    so a later brief of a task has a receipt of its own. Each of the `k` rounds takes the best next candidate that fits, so no list of candidates is kept.
    """
    asked = tasks.select("task_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("family", F.lit("")).alias("family"), F.coalesce("project", F.lit("")).alias("project"))
    asked = asked.withColumn("terms", K.terms("query"))
    item = experiences.select("memory_id", "revision", "scope", "task_family", F.length("chunk").alias("size"), K.terms(F.concat_ws(" ", "conditions", "recommended_action", "avoid", "task_family")).alias("terms"))
    # the scope is part of the key, so a common word pairs a task only with items it may see
    scopes = F.array_distinct(F.array("project", F.lit("global")))
    overlap = (
        asked.select("task_id", F.explode(scopes).alias("scope"), "terms").select("task_id", "scope", F.explode("terms").alias("term"))
        .join(item.select("memory_id", "scope", F.explode("terms").alias("term")), ["scope", "term"])
        .groupBy("task_id", "memory_id").agg(F.count("*").alias("shared"))
    )
    by_family = asked.where((T.strip("query") == "") & (F.col("family") != "")).select("task_id", F.col("family").alias("task_family")).join(
        item.select("memory_id", "task_family"), "task_family").select("task_id", "memory_id", F.lit(0).cast("long").alias("shared"))
    pairs = overlap.unionByName(by_family).join(asked.select("task_id", "family", "project", F.size("terms").alias("n_terms")), "task_id").join(item.drop("terms"), "memory_id")
    pairs = pairs.where(((F.col("scope") == "global") | (F.col("scope") == F.col("project"))) & ((F.col("family") == "") | (F.col("family") == F.col("task_family"))))
    score = F.col("shared") / F.greatest(F.col("n_terms"), F.lit(1)) + F.when(F.col("scope") == F.col("project"), 0.1).otherwise(0.0)
    ranked = materialize(pairs.select("task_id", F.struct((-score).alias("cost"), "memory_id").alias("rank"), "revision", "size", score.alias("score")), "ranked")

    state = asked.select("task_id", F.lit(None).cast(ranked.schema["rank"].dataType).alias("last"), F.lit(0).alias("used"))
    chosen = None
    for n in range(k):
        gap = 0 if n == 0 else 2
        fits = ranked.join(state, "task_id").where((F.col("last").isNull() | (F.col("rank") > F.col("last"))) & (F.col("used") + F.col("size") + gap <= max_chars))
        pick = fits.groupBy("task_id").agg(F.min(F.struct("rank", "revision", "size", "score", "used")).alias("p"))
        state = pick.select("task_id", F.col("p.rank").alias("last"), (F.col("p.used") + F.col("p.size") + gap).alias("used"))
        rows = pick.select("task_id", F.lit(n + 1).alias("position"), F.col("p.rank.memory_id").alias("memory_id"), "p.revision", "p.size", "p.score")
        chosen = rows if chosen is None else chosen.unionByName(rows)
    kept = chosen.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "memory_id", "revision"))), lambda s: F.struct(s["memory_id"].alias("memory_id"), s["revision"].alias("revision"))).alias("_k"))
    made = F.current_timestamp() if as_of is None else as_of.cast("timestamp")
    asked = asked.withColumns({"created_at": made, "max_chars": F.lit(max_chars)})
    receipts = asked.join(kept, "task_id", "left").select(
        K.content_id(F.col("task_id"), F.col("query"), F.col("family"), F.col("project"), F.unix_micros("created_at").cast("string"), prefix="rec-", digits=32).alias("receipt_id"),
        "task_id", "query", "family", "project", "created_at", "max_chars",
        F.transform(F.coalesce("_k", F.array().cast(kept.schema["_k"].dataType)), lambda s: s["memory_id"]).alias("retrieved_ids"),
        F.map_from_entries(F.coalesce("_k", F.array().cast(kept.schema["_k"].dataType))).alias("revisions"))
    return chosen, receipts


def brief_chunks(experiences: DataFrame, observations: DataFrame) -> DataFrame:
    """Experiences with the text shown in a brief, including reported use of exactly this revision."""
    seen = observations.select("memory_id", "revision", "applied_tasks", *V.OUTCOMES, "recent_corrections")
    j = experiences.join(seen, ["memory_id", "revision"], "left")
    n = {o: F.coalesce(o, F.lit(0)).cast("string") for o in (*V.OUTCOMES, "applied_tasks")}
    told = F.coalesce(F.nullif(F.array_join("recent_corrections", " | "), F.lit("")), F.lit("none recorded"))
    sources = F.array_join(F.transform("evidence_refs", lambda r: F.concat(r["path"], F.lit(" :: "), F.substring(r["quote"], 1, 180))), "\n")
    chunk = F.concat(
        F.lit("["), F.col("memory_id").cast("string"), F.lit(" r"), F.col("revision").cast("string"), F.lit("] "), "task_family", F.lit(" / "), "scope", F.lit("\nConditions: "), "conditions",
        F.lit("\nDo: "), "recommended_action", F.lit("\nAvoid: "), "avoid", F.lit("\nEvidence ("), "evidence_level", F.lit("): "), sources,
        F.lit("\nReported use of this revision: "), n["applied_tasks"], F.lit(" tasks; unknown="), n["unknown"], F.lit(", failed="), n["failed"],
        F.lit(", verified_success="), n["verified_success"], F.lit(", user_accepted="), n["user_accepted"], F.lit("; not causal evidence.\nRecent user corrections: "), told)
    return j.withColumn("chunk", chunk).select(*experiences.columns, "chunk")


def record_feedback(receipts: DataFrame, known: DataFrame, batch: DataFrame, documents: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(feedback rows to append, rejected requests). Repeats have the same id and change nothing.

    Batch: `pos, task_id, receipt_id, outcome_status, applied_memory_ids, observed_actions, user_corrections, evidence_refs`.
    Without a receipt id the newest receipt of the task is meant.
    """
    texts = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: T.strip(s)), lambda s: s != "")))
    b = batch.select(
        "pos", "task_id", "receipt_id", F.coalesce("outcome_status", F.lit("unknown")).alias("outcome_status"), texts("applied_memory_ids").alias("applied_memory_ids"),
        texts("observed_actions").alias("observed_actions"), texts("user_corrections").alias("user_corrections"), F.coalesce("evidence_refs", F.array().cast(_REF)).alias("evidence_refs"))
    refs = checked_refs(b.select("pos", F.explode("evidence_refs").alias("r")).select("pos", "r.path", "r.quote"), documents)
    broken = refs.where(~F.col("holds")).select("pos").distinct().withColumn("broken", F.lit(True))
    newest = top_rows(receipts.select("task_id", F.col("receipt_id").alias("newest"), "created_at"), ["task_id"], [F.desc("created_at"), F.desc("newest")], 1).drop("created_at")
    named = top_rows(receipts.select("task_id", F.col("receipt_id").alias("_rid"), "retrieved_ids", "revisions", "created_at"), ["task_id", "_rid"], [F.desc("created_at")], 1).drop("created_at")
    # Only rows without a receipt are moved by their task, as one task may have most of the rows.
    bare = b.where("receipt_id IS NULL").join(newest, "task_id", "left").withColumnRenamed("newest", "_rid")
    sure = b.where("receipt_id IS NOT NULL").withColumn("_rid", F.col("receipt_id"))
    j = sure.unionByName(bare).join(named, ["task_id", "_rid"], "left").join(broken, "pos", "left")
    quoted = F.forall("user_corrections", lambda t: F.exists("evidence_refs", lambda r: F.contains(r["quote"], t)))
    needs = (F.col("outcome_status") != "unknown") | (F.size("user_corrections") > 0)
    reason = (
        F.when(T.strip(F.coalesce("task_id", F.lit(""))) == "", "missing_task").when(~F.col("outcome_status").isin(*V.OUTCOMES), "unsupported_outcome")
        .when((F.size("applied_memory_ids") > 0) & (F.size("observed_actions") == 0), "no_observed_actions")
        .when((needs & (F.size("evidence_refs") == 0)) | F.col("broken"), "quotation_not_found").when(~quoted, "correction_not_quoted")
        .when(F.col("retrieved_ids").isNull(), "no_receipt_for_task").when(F.size(F.array_except("applied_memory_ids", "retrieved_ids")) > 0, "applied_not_retrieved")
    )
    judged = j.withColumn("reason", reason)
    rows = judged.where("reason IS NULL").withColumn("revisions", F.map_filter("revisions", lambda k, _v: F.array_contains("applied_memory_ids", k)))
    ident = K.content_id(*[F.col(c) for c in ("task_id", "_rid", "applied_memory_ids", "outcome_status", "observed_actions", "user_corrections", "evidence_refs")], prefix="fb-")
    rows = rows.select(
        "pos", ident.alias("feedback_id"), F.col("_rid").alias("receipt_id"), "task_id", "outcome_status", "applied_memory_ids", "revisions", "observed_actions", "user_corrections",
        "evidence_refs", as_of.alias("created_at"))
    new = top_rows(rows, ["feedback_id"], [F.col("pos")], 1).join(known.select("feedback_id"), "feedback_id", "left_anti")
    return new, judged.where("reason IS NOT NULL").select("pos", "task_id", "reason")


def memory_observations(applied: DataFrame) -> DataFrame:
    """Reported use per memory revision: distinct tasks, reports per outcome, three newest distinct corrections.

    Input: one row per report and applied memory: `memory_id, revision, task_id, outcome, seq, corrections`.
    """
    counted = applied.groupBy("memory_id", "revision").agg(
        F.count_distinct("task_id").alias("applied_tasks"), *[F.count_if(F.col("outcome") == o).alias(o) for o in V.OUTCOMES])
    said = applied.select("memory_id", "revision", "seq", F.posexplode("corrections").alias("i", "c")).withColumn("c", F.substring("c", 1, 160))
    newest = said.groupBy("memory_id", "revision", "c").agg(F.max(F.struct("seq", (-F.col("i")).alias("i"))).alias("at"))
    three = top_rows(newest, ["memory_id", "revision"], [F.desc("at"), F.col("c")], 3, rank="nth")
    listed = three.groupBy("memory_id", "revision").agg(ordered_list("c", "nth").alias("recent_corrections"))
    return counted.join(listed, ["memory_id", "revision"], "left").withColumn("recent_corrections", F.coalesce("recent_corrections", F.array().cast("array<string>")))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Newest reported outcome per task."""
    return feedback.groupBy("task_id").agg(F.max_by("outcome", "seq").alias("outcome"))


def experience_stats(versions: DataFrame, receipts: DataFrame, retrieved: DataFrame, feedback: DataFrame, applied: DataFrame) -> DataFrame:
    """One row of counts. `retrieved` and `applied` are (task_id, memory_id) rows, `feedback` has `task_id, outcome, seq`."""
    accepted = ("verified_success", "user_accepted")
    state = heads(versions).agg(F.count_if(F.col("status") == "active").alias("active_memories"), F.count_if(F.col("status") == "candidate").alias("candidate_memories"))
    r = receipts.agg(F.count("*").alias("retrieval_receipts"), F.count_distinct("task_id").alias("retrieval_tasks"))
    uses = retrieved.select("task_id", "memory_id").distinct().agg(F.count("*").alias("retrieved_memory_uses"))
    used = applied.select("task_id", "memory_id").distinct().agg(F.count("*").alias("applied_memory_uses"), F.count_distinct("task_id").alias("applied_tasks"))
    per_task = feedback.groupBy("task_id").agg(
        F.count("*").alias("n"), F.max_by("outcome", "seq").alias("latest"), *[F.bool_or(F.col("outcome") == o).alias(o) for o in V.OUTCOMES])
    f = per_task.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("feedback_observations"), *[F.count_if(o).alias(f"tasks_{o}") for o in V.OUTCOMES],
        F.count_if(F.col("verified_success") | F.col("user_accepted")).alias("ever_accepted_tasks"), F.count_if(F.col("latest").isin(*accepted)).alias("latest_accepted_tasks"))
    silent = receipts.select("task_id").distinct().join(per_task.select("task_id"), "task_id", "left_anti").agg(F.count("*").alias("tasks_without_feedback"))
    one = [d.withColumn("_one", F.lit(1)) for d in (state, r, uses, used, f, silent)]
    out = one[0]
    for part in one[1:]:
        out = out.join(part, "_one")
    return out.drop("_one")
