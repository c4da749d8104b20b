"""The proposal ledger: admission, identities, decisions, follow-ups and preferences, for many tenants at once.

Every operator takes tables and returns new rows; nothing is changed in place. `pos` is the order of a batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import vocab as V
from tracemill.functions import keys as K
from tracemill.functions import text as T
from tracemill.operators.grouping import id_chunk, number_rows, top_rows
from tracemill.operators.substrings import short_text_matches

MAX_PENDING = 13
_NUMBERED = r"^P(\d+)$"
_HISTORY = "array<struct<at:timestamp,from_status:string,to_status:string,reason:string>>"


def proposal_number(ident: str | Column) -> Column:
    """Number of a well-formed id, null otherwise."""
    c = T.col(ident)
    return F.when(c.rlike(_NUMBERED), F.regexp_extract(c, _NUMBERED, 1).cast("long"))


def _highest(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("tenant_id").agg(F.coalesce(F.max(proposal_number("id")), F.lit(0)).alias("_max"))


def _proposal_id(n: Column) -> Column:
    return F.concat(F.lit("P"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))


def admit_proposals(proposals: DataFrame, batch: DataFrame, as_of: Column, *, max_pending: int = MAX_PENDING) -> tuple[DataFrame, DataFrame]:
    """(admitted proposals with new ids, refused ones with a reason).

    Refused: a (target, kind) already on the ledger or earlier in the batch, and everything beyond `max_pending` open ones.
    """
    key = ["tenant_id", "target", "kind"]
    known = proposals.where(F.col("status").isin("pending", "approved", "done", "rejected")).select(*key).distinct()
    first = top_rows(batch, key, [F.col("pos")], 1).join(known, key, "left_anti")
    open_now = proposals.where("status = 'pending'").groupBy("tenant_id").agg(F.count("*").alias("_open"))
    ranked = top_rows(first, ["tenant_id"], [F.col("pos")], max_pending, rank="_n")
    fit = ranked.join(open_now, "tenant_id", "left").join(_highest(proposals), "tenant_id", "left")
    fit = fit.where(F.col("_n") <= max_pending - F.coalesce("_open", F.lit(0)))
    number = F.coalesce("_max", F.lit(0)) + F.col("_n")
    admitted = fit.select(
        "tenant_id", _proposal_id(number).alias("id"), K.content_id(F.col("tenant_id"), number, F.col("kind"), F.col("target"), digits=32).alias("uid"),
        F.lit(None).cast("string").alias("legacy_id"), "kind", "target", "reason", F.lit("pending").alias("status"), F.to_date(as_of).alias("created"),
        F.lit(None).cast("date").alias("resolved"), F.array().cast(_HISTORY).alias("status_history"), "pos")
    refused = batch.join(admitted.select("tenant_id", "pos"), ["tenant_id", "pos"], "left_anti").join(known.withColumn("_known", F.lit(True)), key, "left").join(
        first.select("tenant_id", "pos", F.lit(True).alias("_first")), ["tenant_id", "pos"], "left")
    why = F.when(F.col("_known"), "already_on_ledger").when(F.col("_first"), "queue_full").otherwise("repeated_in_batch")
    return admitted.drop("pos"), refused.select("tenant_id", "pos", "kind", "target", why.alias("reason"))


def repair_identities(proposals: DataFrame) -> DataFrame:
    """Unique ids: the first holder keeps its id, later holders and malformed ids get the next numbers and keep `legacy_id`."""
    first = proposals.groupBy("tenant_id", "id").agg(F.min("pos").alias("_first"))
    flagged = proposals.join(first, ["tenant_id", "id"], "left").withColumn("_bad", proposal_number("id").isNull() | (F.col("pos") != F.col("_first")))
    bad = number_rows(flagged.where("_bad"), ["tenant_id"], id_chunk("pos"), [F.col("pos")], "_n").join(_highest(proposals), "tenant_id", "left")
    fixed = bad.withColumn("legacy_id", F.col("id")).withColumn("id", _proposal_id(F.col("_max") + F.col("_n")))
    columns = [*[c for c in proposals.columns if c != "legacy_id"], "legacy_id"]
    kept = flagged.where("NOT _bad").withColumn("legacy_id", F.lit(None).cast("string"))
    return kept.select(*columns).unionByName(fixed.select(*columns))


def link_follow_ups(follow_ups: DataFrame, proposals: DataFrame) -> DataFrame:
    """Follow-ups tied to the one done proposal that had their id and target; anything ambiguous becomes inconclusive."""
    # Done proposals are counted under what a follow-up may name: target and kind, either of them, or none. Then a follow-up meets one row.
    done = proposals.where("status = 'done'")
    named = lambda c: F.array_distinct(F.array(F.coalesce(c, F.lit("")), F.lit("")))
    old = done.select("tenant_id", F.coalesce("legacy_id", "id").alias("proposal_id"), F.struct(F.col("id").alias("_id"), F.col("uid").alias("_uid")).alias("_p"), "kind", F.explode(named("target")).alias("_wt"))
    old = old.withColumn("_wk", F.explode(named("kind"))).groupBy("tenant_id", "proposal_id", "_wt", "_wk").agg(F.count("*").alias("_n"), F.min("_p").alias("_p")).where("_n = 1")
    kind = F.col("kind") if "kind" in follow_ups.columns else F.lit(None).cast("string")
    wanted = follow_ups.withColumns({"_wt": F.coalesce("target", F.lit("")), "_wk": F.coalesce(kind, F.lit(""))})
    j = wanted.join(old, ["tenant_id", "proposal_id", "_wt", "_wk"], "left").drop("_wt", "_wk")
    linked = F.col("_p").isNotNull()
    return (
        j.withColumn("legacy_proposal_id", F.when(linked, F.col("proposal_id"))).withColumn("proposal_id", F.coalesce("_p._id", "proposal_id"))
        .withColumn("proposal_uid", F.col("_p._uid")).withColumn("link_status", F.when(linked, "verified").otherwise("unresolved"))
        .withColumn("legacy_result", F.when(~linked, F.col("result"))).withColumn("result", F.when(linked, F.col("result")).otherwise("inconclusive")).drop("_n", "_p")
    )


def ledger_violations(proposals: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """Everything wrong with a ledger; empty when it may be written."""
    def repeated(column, name):
        bad = proposals.groupBy("tenant_id", column).agg(F.count("*").alias("n")).where(F.col(column).isNull() | (F.col(column) == "") | (F.col("n") > 1))
        return bad.select("tenant_id", F.lit(name).alias("violation"), F.col(column).alias("value"))

    p = proposals.groupBy("tenant_id", F.col("id").alias("proposal_id")).agg(F.min(F.struct("target", "uid")).alias("_p"))
    f = follow_ups.where("link_status IS NULL OR link_status <> 'unresolved'").join(p, ["tenant_id", "proposal_id"], "left")
    wrong = F.when(F.col("_p").isNull() | ~F.col("_p.target").eqNullSafe(F.col("target")), "target_mismatch").when(~F.col("_p.uid").eqNullSafe(F.col("proposal_uid")), "uid_mismatch")
    links = f.withColumn("violation", wrong).where("violation IS NOT NULL").select("tenant_id", "violation", F.col("proposal_id").alias("value"))
    return repeated("id", "duplicate_id").unionByName(repeated("uid", "duplicate_uid")).unionByName(links)


# ---- decisions ------------------------------------------------------------------------------------------------------
def decision_lines(texts: DataFrame) -> DataFrame:
    """Ticked (`x`) and crossed (`-`) lines of approval texts (`tenant_id, doc_id, text`) with the heading of their section."""
    sections = texts.select("tenant_id", "doc_id", F.posexplode(F.split("text", "\n## ")).alias("section_no", "section"))
    lines = sections.select("tenant_id", "doc_id", "section_no", F.split("section", "\n", 2)[0].alias("heading"), F.posexplode(F.split("section", "\n")).alias("line_no", "line"))
    pattern = r"^[ \t]*-[ \t]*\[([ x\-X])\][ \t]*((?:P|UP)\d+)\b(.*)$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    ticked = lines.where(F.lower(part(1)).isin("x", "-"))
    tail = F.split(part(3), r"\|")
    return ticked.select(
        "tenant_id", "doc_id", "section_no", "line_no", "heading", F.lower(part(1)).alias("mark"), part(2).alias("id"), T.strip(F.get(tail, F.lit(2))).alias("target"),
        F.nullif(F.regexp_extract("line", "<!-- uid:([^ >]+) -->", 1), F.lit("")).alias("uid"), "line")


def match_decisions(decisions: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions that fit a proposal by id, target, uid and stage; the others with a reason). The last line per id counts."""
    p = proposals.groupBy("tenant_id", "id").agg(F.count("*").alias("_n"), F.min(F.struct("target", "uid", "status", "kind")).alias("p"))
    j = decisions.where(~F.startswith("id", F.lit("UP"))).join(p, ["tenant_id", "id"], "left")
    staged = F.contains("heading", F.lit(V.APPROVED_SECTION))
    reason = (
        F.when(F.col("p").isNull() | (F.col("_n") != 1), "missing_or_ambiguous").when(F.col("target").isNotNull() & (F.col("target") != F.col("p.target")), "stale_target")
        .when(F.col("uid").isNotNull() & ~F.col("p.uid").eqNullSafe(F.col("uid")), "stale_uid").when(F.col("p.uid").isNotNull() & F.col("uid").isNull(), "no_identity")
        .when(staged != (F.col("p.status") == "approved"), "stale_stage").when(~F.col("p.status").isin("pending", "approved"), "already_resolved")
    )
    judged = j.withColumn("reason", reason)
    order = [F.desc("doc_id"), F.desc("section_no"), F.desc("line_no")]
    valid = top_rows(judged.where("reason IS NULL"), ["tenant_id", "id"], order, 1)
    return valid.select("tenant_id", "id", "mark", "p.target", "p.uid", "p.kind", "p.status"), judged.where("reason IS NOT NULL").select("tenant_id", "id", "line", "reason")


def apply_decisions(proposals: DataFrame, valid: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger after the decisions, proposals that became done, refused decisions).

    pending + tick: approved, or done at once for retiring a skill that is not protected; approved + tick: done;
    pending + cross: rejected. Only pending proposals can be rejected.
    """
    guarded = (F.col("kind") == "retire") & K.is_protected(F.col("target"), retire=True)
    step = (
        F.when((F.col("mark") == "x") & (F.col("status") == "approved"), "done")
        .when((F.col("mark") == "x") & (F.col("kind") == "retire") & ~guarded, "done").when((F.col("mark") == "x") & ~guarded, "approved")
        .when((F.col("mark") == "-") & (F.col("status") == "pending"), "rejected")
    )
    moved = valid.withColumn("_to", step)
    refused = moved.where("_to IS NULL").select("tenant_id", "id", F.when(F.col("mark") == "-", "only_pending_can_be_rejected").otherwise("protected_skill").alias("reason"))
    j = proposals.join(moved.where("_to IS NOT NULL").select("tenant_id", "id", "_to"), ["tenant_id", "id"], "left")
    entry = F.array(F.struct(as_of.cast("timestamp").alias("at"), F.col("status").alias("from_status"), F.col("_to").alias("to_status"), F.lit("decision").alias("reason")))
    after = (
        j.withColumn("status_history", F.when(F.col("_to").isNotNull(), F.concat(F.coalesce("status_history", F.array().cast(_HISTORY)), entry.cast(_HISTORY))).otherwise(F.col("status_history")))
        .withColumn("status", F.coalesce("_to", "status")).withColumn("resolved", F.when(F.col("_to").isNotNull(), F.to_date(as_of)).otherwise(F.col("resolved")))
    )
    done = after.where("_to = 'done'").drop("_to")
    return after.drop("_to").select(*proposals.columns), done.select(*proposals.columns), refused


def cluster_counts(clusters: DataFrame, keys: DataFrame) -> DataFrame:
    """Largest count per tenant and key among clusters whose title or fingerprint contains the key."""
    text = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("cluster_key", F.lit(""))))
    hay = clusters.select("tenant_id", "cnt", text.alias("_hay"))
    hits = short_text_matches(hay, "_hay", keys.select("tenant_id", "key").distinct(), "key", ["tenant_id"])
    return hits.groupBy("tenant_id", "key").agg(F.max("cnt").alias("cur"))


def create_follow_ups(done: DataFrame, existing: DataFrame, facts: DataFrame, clusters: DataFrame, as_of: Column) -> DataFrame:
    """One follow-up, due in seven days, per done proposal that has none: loads of the name, a mapped cluster, else manual."""
    new = done.join(existing.select("tenant_id", F.col("proposal_id").alias("id"), F.col("proposal_uid").alias("uid"), "target"), ["tenant_id", "id", "uid", "target"], "left_anti")
    mapped = reduce(lambda c, kv: c.when(F.startswith("target", F.lit(kv[0])), kv[1]), V.CLUSTER_FOR_TARGET[1:], F.when(F.startswith("target", F.lit(V.CLUSTER_FOR_TARGET[0][0])), V.CLUSTER_FOR_TARGET[0][1]))
    by_loads = F.col("kind").isin("fix_reference", "retire") & ~F.contains("target", F.lit("/"))
    new = new.withColumn("_loads", by_loads).withColumn("key", F.when(~by_loads, mapped))
    loads = facts.groupBy("tenant_id", F.col("name").alias("target")).agg(F.max("load_sessions").alias("loads"))
    seen = cluster_counts(clusters, new.where("key IS NOT NULL"))
    j = new.join(loads, ["tenant_id", "target"], "left").join(seen, ["tenant_id", "key"], "left")
    metric = F.when(F.col("_loads"), F.concat(F.lit("ref_loads:"), "target")).when(F.col("key").isNotNull(), F.concat(F.lit("cluster:"), "key")).otherwise("manual_review")
    base = F.when(F.col("_loads"), F.coalesce("loads", F.lit(0))).when(F.col("key").isNotNull(), F.coalesce("cur", F.lit(0)))
    return j.select(
        "tenant_id", F.col("id").alias("proposal_id"), F.col("uid").alias("proposal_uid"), "target", metric.alias("metric"), F.lit("verified").alias("link_status"),
        F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("result_detail"), base.cast("long").alias("baseline"),
        F.date_add(F.to_date(as_of), 7).alias("check_after"), F.lit(None).cast("boolean").alias("recurrence_detected"))


def check_due(follow_ups: DataFrame, facts: DataFrame, clusters: DataFrame, as_of: Column) -> DataFrame:
    """Follow-ups that are due, with their result. Growth of a lifetime count proves recurrence, never a worse rate."""
    due = follow_ups.where("(link_status IS NULL OR link_status <> 'unresolved') AND result IS NULL").where(F.col("check_after") <= F.to_date(as_of))
    name = F.when(F.startswith("metric", F.lit("ref_loads:")), F.substring_index("metric", "ref_loads:", -1))
    key = F.when(F.startswith("metric", F.lit("cluster:")), F.substring_index("metric", "cluster:", -1))
    due = due.withColumn("_name", name).withColumn("key", key)
    loads = facts.groupBy("tenant_id", F.col("name").alias("_name")).agg(F.max("load_sessions").alias("loads"))
    j = due.join(loads, ["tenant_id", "_name"], "left").join(cluster_counts(clusters, due.where("key IS NOT NULL")), ["tenant_id", "key"], "left")
    base, cur = F.coalesce("baseline", F.lit(0)), F.coalesce("cur", F.lit(0))
    result = (
        F.when(F.col("_name").isNotNull(), F.when(F.col("loads").isNull() | (F.col("loads") < base), "inconclusive").when(F.col("loads") == base, "no_change").otherwise("worse"))
        .when(F.col("key").isNotNull(), F.when(cur == base, "no_change").otherwise("inconclusive")).otherwise("inconclusive")
    )
    now = F.when(F.col("_name").isNotNull(), F.col("loads")).when(F.col("key").isNotNull(), cur)
    detail = F.when(F.col("_name").isNull() & F.col("key").isNull(), "manual review").otherwise(F.concat(F.lit("baseline="), base.cast("string"), F.lit(" now="), F.coalesce(now.cast("string"), F.lit("?"))))
    out = j.withColumn("result", result).withColumn("result_detail", detail).withColumn("recurrence_detected", F.when(F.col("key").isNotNull(), cur > base))
    return out.select(*follow_ups.columns)


def reconcile(proposals: DataFrame, facts: DataFrame, as_of: Column, *, defer_all: bool = False) -> DataFrame:
    """Open proposals without current evidence: deferred when the agent changed, superseded when the reference no longer fails."""
    f = facts.groupBy("tenant_id", F.lower("name").alias("_key")).agg(F.bool_or("archived").alias("_archived"), F.max("recent_self_errors").alias("_errors"))
    j = proposals.withColumn("_key", F.lower("target")).join(f, ["tenant_id", "_key"], "left")
    is_open = F.col("status").isin("pending", "approved")
    gone = (F.col("kind") == "fix_reference") & (F.coalesce("_archived", F.lit(False)) | (F.coalesce("_errors", F.lit(0)) == 0))
    to = F.when(is_open, F.lit("deferred")) if defer_all else F.when(is_open & gone, "superseded")
    why = "needs a baseline of the current agent" if defer_all else "archived or no failure in the last 30 days"
    entry = F.array(F.struct(as_of.cast("timestamp").alias("at"), F.col("status").alias("from_status"), F.col("_to").alias("to_status"), F.lit(why).alias("reason"))).cast(_HISTORY)
    moved = j.withColumn("_to", to).withColumn("status_history", F.when(F.col("_to").isNotNull(), F.concat(F.coalesce("status_history", F.array().cast(_HISTORY)), entry)).otherwise(F.col("status_history")))
    return moved.withColumn("status", F.coalesce("_to", "status")).select(*proposals.columns)


def close_capped(proposals: DataFrame, disabled: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(all proposals, those just closed): pending retirements of skills the size cap has disabled become done. The closed ones get their
    follow-ups by `create_follow_ups`, like any other done proposal."""
    hit = disabled.select("tenant_id", F.col("name").alias("target")).distinct().withColumn("_hit", F.lit(True))
    j = proposals.join(hit, ["tenant_id", "target"], "left").withColumn("_close", F.coalesce(F.col("_hit") & (F.col("status") == "pending") & (F.col("kind") == "retire"), F.lit(False)))
    after = j.withColumn("status", F.when(F.col("_close"), "done").otherwise(F.col("status"))).withColumn("resolved", F.when(F.col("_close"), F.to_date(as_of)).otherwise(F.col("resolved")))
    return after.select(*proposals.columns), after.where("_close").select(*proposals.columns)


def open_queue(proposals: DataFrame, preferences: DataFrame) -> DataFrame:
    """Everything that waits for a person: pending and approved proposals and pending preferences."""
    p = proposals.where(F.col("status").isin("pending", "approved")).select(
        "tenant_id", F.when(F.col("status") == "pending", "proposal").otherwise("to_execute").alias("queue"), "id", F.concat_ws(" | ", "kind", "target").alias("subject"), F.substring("reason", 1, 80).alias("note"))
    u = preferences.where("status = 'pending'").select("tenant_id", F.lit("preference").alias("queue"), "id", F.col("title").alias("subject"), F.substring("rule", 1, 80).alias("note"))
    return p.unionByName(u)


# ---- replies of a reviewer ------------------------------------------------------------------------------------------
def _blocks(replies: DataFrame, pattern: str, groups: int, k: int | None) -> DataFrame:
    arrays = [F.regexp_extract_all("text", F.lit(pattern), i + 1) for i in range(groups)]
    found = replies.select("reply_id", *[a.alias(f"g{i}") for i, a in enumerate(arrays)])
    zipped = F.arrays_zip(*[f"g{i}" for i in range(groups)])
    return found.select("reply_id", F.posexplode(F.slice(zipped, 1, k) if k else zipped).alias("block_no", "b")).select("reply_id", "block_no", "b.*")


def reply_proposals(replies: DataFrame, *, k: int = 8) -> DataFrame:
    """Proposals in reply texts: the first eight blocks, of a known kind, with all three parts, in whatever layout."""
    b = _blocks(replies, r"(?sU)###\s*\[L\d+\]\s*(\w+):\s*(.+?)\n(.*?)(?=\n#{2,3}\s|\z)", 3, k)
    stop = "|".join(V.REPLY_PARTS)

    def part(label):
        return T.strip(T.squeeze(F.regexp_extract("g2", rf"(?sU)\*\*{label}\*\*[：:]\s*(.+?)(?=\*\*(?:{stop})\*\*[：:]|\z)", 1)))

    reason, evidence, action = map(part, V.REPLY_PARTS)
    out = b.select("reply_id", "block_no", T.strip("g0").alias("kind"), T.strip("g1").alias("target"), reason.alias("reason"), evidence.alias("evidence"), action.alias("action"))
    return out.where(F.col("kind").isin(*V.REPLY_KINDS) & (F.col("reason") != "") & (F.col("evidence") != "") & (F.col("action") != "")).select(
        "reply_id", "block_no", "kind", F.substring("target", 1, 60).alias("target"), F.substring("reason", 1, 180).alias("reason"),
        F.substring("evidence", 1, 180).alias("evidence"), F.substring("action", 1, 120).alias("action"))


def skip_settled(batch: DataFrame, proposals: DataFrame) -> DataFrame:
    """The new proposals (`tenant_id, target`) without those whose target was rejected, done or is pending already, whatever the kind."""
    settled = proposals.where(F.col("status").isin("rejected", "done", "pending")).select("tenant_id", "target").distinct()
    return batch.join(settled, ["tenant_id", "target"], "left_anti")


def reply_preferences(replies: DataFrame) -> DataFrame:
    """Preference candidates in reply texts."""
    rule, evidence, why = V.PREFERENCE_PARTS
    pattern = rf"(?sU)###\s*\[U\d+\]\s*(\w+)\s*[:：]\s*(.+?)\n\*\*{rule}\*\*[：:]\s*(.+?)\n\*\*{evidence}\*\*[：:]\s*(.+?)\n\*\*{why}\*\*[：:]\s*(.+?)(?=\n###|\z)"
    b = _blocks(replies, pattern, 5, None)
    line = lambda i, n: F.substring(T.strip(T.squeeze(F.col(f"g{i}"))), 1, n)
    return b.select("reply_id", "block_no", line(0, 1000).alias("category"), line(1, 80).alias("title"), line(2, 240).alias("rule"), line(3, 240).alias("evidence"), line(4, 200).alias("why"))


def admit_preferences(preferences: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """New preference candidates with their numbers; known titles, and repeats inside the batch, are skipped."""
    once = top_rows(batch, ["tenant_id", "title"], [F.col("pos")], 1).join(preferences.select("tenant_id", "title").distinct(), ["tenant_id", "title"], "left_anti")
    have = preferences.groupBy("tenant_id").agg(F.count("*").alias("_have"))
    placed = number_rows(once, ["tenant_id"], id_chunk("pos"), [F.col("pos")], "_n").join(have, "tenant_id", "left")
    n = F.coalesce("_have", F.lit(0)) + F.col("_n")
    ident = F.concat(F.lit("UP"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))
    return placed.select("tenant_id", ident.alias("id"), "category", "title", "rule", "evidence", "why", F.lit("pending").alias("status"), F.to_date(as_of).alias("proposed"), F.date_add(F.to_date(as_of), 7).alias("follow_up_after"))


def decide_preferences(preferences: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """Preferences after ticks and crosses; only pending ones can be approved, any listed one can be rejected."""
    d = top_rows(decisions.where(F.startswith("id", F.lit("UP"))), ["tenant_id", "id"], [F.desc("doc_id"), F.desc("section_no"), F.desc("line_no")], 1).select("tenant_id", "id", "mark")
    to = F.when((F.col("mark") == "x") & (F.col("status") == "pending"), "approved").when(F.col("mark") == "-", "rejected")
    return preferences.join(d, ["tenant_id", "id"], "left").withColumn("status", F.coalesce(to, F.col("status"))).drop("mark")
