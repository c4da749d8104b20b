"""User signals (corrections, approvals, habits) and session outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill import vocab as V
from tracemill.functions import keys as K
from tracemill.functions import text as T
from tracemill.operators.grouping import micros, nearest_value, number_rows, time_chunk, top_rows
from tracemill.vocab import DEFAULT, Vocabulary

KEYS = ("tenant_id", "session_id")


def session_messages(messages: DataFrame, sessions: DataFrame, *, skip_sources: Sequence[str] = V.SKIP_SOURCES, root_only: bool = True) -> DataFrame:
    """Messages of sessions that people hold: not archived, not automatic and, if asked, without a parent."""
    keep = (F.coalesce("archived", F.lit(0)) == 0) & ~F.coalesce("source", F.lit("")).isin(*skip_sources)
    if root_only:
        keep = keep & (F.coalesce("parent_session_id", F.lit("")) == "")
    return messages.join(sessions.where(keep).select(*KEYS, "title", "source"), list(KEYS))


def user_signals(spoken: DataFrame, *, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Signal of every real user message that gives one."""
    users = spoken.where((F.col("role") == "user") & T.is_real_user_text("content"))
    return (
        users.withColumn("_s", T.user_signal("content", vocab)).where("_s IS NOT NULL")
        .select(*KEYS, "msg_id", "ts", "title", "_s.kind", "_s.signal", T.strip("content").alias("text"))
    )


def signal_counts(signals: DataFrame, *, tz: str = "UTC") -> DataFrame:
    """Corrections, approvals and habits per tenant and day."""
    return signals.groupBy("tenant_id", K.day_of("ts", tz).alias("day")).agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("correction", "approval", "habit")]
    )


def correction_trend(signals: DataFrame, tenants: DataFrame, day: str, *, days: int = 7, tz: str = "UTC") -> DataFrame:
    """Corrections per day for the days up to `day`, zero where there were none."""
    d = F.to_date(F.lit(day))
    grid = tenants.select("tenant_id").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(d, days - 1), d)))
    found = signals.where("kind = 'correction'").groupBy("tenant_id", K.day_of("ts", tz).alias("day")).agg(F.count("*").alias("n"))
    return grid.join(found, ["tenant_id", "day"], "left").select("tenant_id", "day", F.coalesce("n", F.lit(0)).alias("corrections"))


def recurring_signals(signals: DataFrame, day: str, *, days: int = 3, at_least: int = 2, tz: str = "UTC") -> DataFrame:
    d = F.to_date(F.lit(day))
    recent = K.day_of("ts", tz).between(F.date_sub(d, days - 1), d)
    return (
        signals.where((F.col("kind") == "correction") & recent).groupBy("tenant_id", "signal").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    )


def append_trend(trend: DataFrame, points: DataFrame, *, keep: int = 26) -> DataFrame:
    """Trend history (`tenant_id, grain, day, ...`) with new points; a point of the same day replaces, `keep` newest stay."""
    both = trend.withColumn("_new", F.lit(0)).unionByName(points.withColumn("_new", F.lit(1)))
    latest = top_rows(both, ["tenant_id", "grain", "day"], [F.desc("_new")], 1).drop("_new")
    return top_rows(latest, ["tenant_id", "grain"], [F.desc("day")], keep)


def corrections_with_reply(spoken: DataFrame, *, vocab: Vocabulary = DEFAULT, limit: int = 400) -> DataFrame:
    """Every correction with the assistant's last substantial reply before it.

    Only corrections and candidate replies are shuffled, and of a reply only the part that is reported.
    """
    reply = (F.col("role") == "assistant") & (F.length("content") > 20) & ~F.startswith("content", F.lit("[System:"))
    asked = (F.col("role") == "user") & T.is_real_user_text("content")
    hit = F.when(asked, T.first_word(T.strip("content"), vocab.correction))
    rows = spoken.select(
        *KEYS, "msg_id", "ts", "title", hit.alias("signal"), F.when(reply, F.substring("content", 1, limit)).alias("_reply"),
        F.when(asked, T.strip("content")).alias("text"),
    ).where("signal IS NOT NULL OR _reply IS NOT NULL")
    near = nearest_value(rows, KEYS, micros("ts"), time_chunk("ts"), F.col("_reply"), "prior_reply", tie=F.col("msg_id"))
    return near.where("signal IS NOT NULL").select(*KEYS, "msg_id", "ts", "title", "signal", "text", F.coalesce("prior_reply", F.lit("")).alias("prior_reply"))


def correction_pairs(pairs: DataFrame, as_of: Column, *, days: int = 90, budget: int = 9000) -> DataFrame:
    """Numbered correction / reply pairs per tenant, oldest first, as many whole records as fit the character budget.

    A record has at least one character, so no more than `budget` rows per tenant are ever ordered in one place.
    """
    recent = pairs.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days))).select(
        "tenant_id", "session_id", "msg_id", "ts", "title", F.substring("text", 1, 150).alias("text"), F.substring("prior_reply", 1, 200).alias("reply"))
    size = F.length("text") + F.length("reply") + F.length(F.coalesce("title", F.lit(""))) + 1
    first = top_rows(recent, ["tenant_id"], [F.col("ts"), F.col("msg_id")], budget, rank="n")
    w = Window.partitionBy("tenant_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget).withColumn("pair_id", F.concat(F.lit("E"), "n")).drop("n")


def growth_facts(pairs: DataFrame, signals: DataFrame, day: str, *, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """First eight corrections of a day with 150 characters of the reply, and first five habits."""
    order = [F.col("ts"), F.col("msg_id")]
    c = top_rows(pairs.where(K.in_day("ts", day, tz)), ["tenant_id"], order, 8, rank="position").select(
        "tenant_id", "position", "signal", F.substring("text", 1, 100).alias("text"), F.substring("prior_reply", 1, 150).alias("did"))
    h = top_rows(signals.where((F.col("kind") == "habit") & K.in_day("ts", day, tz)), ["tenant_id"], order, 5, rank="position").select(
        "tenant_id", "position", F.substring("text", 1, 80).alias("text"))
    return c, h


def growth_counts(signals: DataFrame, tenants: DataFrame, day: str, *, tz: str = "UTC") -> DataFrame:
    """Per tenant the corrections, approvals and habits of a day, and `trend`: its corrections on each of the seven days up to it."""
    d = F.to_date(F.lit(day))
    trend = correction_trend(signals, tenants, day, tz=tz)
    trend = trend.groupBy("tenant_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "corrections"))), lambda x: x["corrections"]).alias("trend"))
    counts = signal_counts(signals, tz=tz).where(F.col("day") == d).drop("day")
    kinds = [F.coalesce(c, F.lit(0)).alias(c) for c in ("corrections", "approvals", "habits")]
    return trend.join(counts, "tenant_id", "left").select("tenant_id", *kinds, "trend")


# ---- outcomes -------------------------------------------------------------------------------------------------------
def closing_messages(messages: DataFrame) -> DataFrame:
    """Last substantial assistant text of a session, looked for among its newest 30 assistant rows."""
    reasoning = F.col("reasoning_content") if "reasoning_content" in messages.columns else F.lit(None).cast("string")
    said = T.strip(F.coalesce("content", F.lit("")))
    thought = T.strip(F.coalesce(reasoning, F.lit("")))
    injected = r"^(\[System:|\[OUT-OF-BAND)"
    text = F.when(said.rlike(injected), None).when(F.length(said) >= 10, said).when(
        (said == "") & ~thought.rlike(r"^\[System:") & (F.length(thought) >= 10), thought)
    rows = messages.where(F.col("role").isin("assistant", "hermes_reasoning")).select(*KEYS, "msg_id", "ts", text.alias("text"))
    newest = top_rows(rows, KEYS, [F.desc("ts"), F.desc("msg_id")], 30).where("text IS NOT NULL")
    return top_rows(newest, KEYS, [F.desc("ts"), F.desc("msg_id")], 1).select(*KEYS, F.col("ts").alias("closed_at"), "text")


def first_reactions(messages: DataFrame, closings: DataFrame, *, k: int = 5, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """First reaction among the five user messages at or after the closing one; the cut to five precedes the length test."""
    said = T.strip(F.coalesce("content", F.lit("")))
    short = F.when((said != "") & (F.length(said) <= 60), said)
    users = messages.where("role = 'user'").select(*KEYS, "msg_id", "ts", short.alias("short"))
    after = users.join(closings.select(*KEYS, "closed_at"), list(KEYS)).where("ts >= closed_at")
    order = [F.col("ts"), F.col("msg_id")]
    five = top_rows(after, KEYS, order, k, salt=F.col("msg_id"))
    told = five.where("short IS NOT NULL").withColumn("reaction", T.user_reaction("short", vocab)).where("reaction IS NOT NULL")
    return top_rows(told, KEYS, order, 1).select(*KEYS, "reaction")


def score_sessions(messages: DataFrame, sessions: DataFrame, *, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Outcome and confidence per session. What the user says beats what the assistant claims."""
    closings = closing_messages(messages)
    labelled = closings.select(*KEYS, T.closing_label("text", vocab).alias("label"))
    reactions = first_reactions(messages, closings, vocab=vocab)
    j = sessions.select(*KEYS).join(labelled, list(KEYS), "left").join(reactions, list(KEYS), "left")
    label, reaction = F.col("label"), F.col("reaction")

    def verdict(outcome, confidence):
        return F.struct(F.lit(outcome).alias("outcome"), F.lit(confidence).alias("confidence"))

    result = (
        F.when(label.isNull(), verdict("uncertain", "low"))
        .when(reaction == "complain", verdict("fail", "high"))
        .when((reaction == "approve") & (label == "fail"), verdict("uncertain", "medium"))
        .when(reaction == "approve", verdict("success", "high"))
        .when(label == "success_strong", verdict("success", "medium"))
        .when(label == "success", verdict("success", "high"))
        .when(label == "fail", verdict("fail", "high"))
        .when(label == "conflict", verdict("uncertain", "medium"))
        .otherwise(verdict("uncertain", "low"))
    )
    return j.withColumn("_v", result).select(*KEYS, "label", "reaction", "_v.outcome", "_v.confidence")


def scored_window(sessions: DataFrame, as_of: Column, *, days: int = 7, skip_sources: Sequence[str] = V.SKIP_SOURCES) -> DataFrame:
    """Sessions of the last days that count as user tasks."""
    return sessions.where(
        (F.col("started_at") >= as_of - F.make_dt_interval(F.lit(days))) & ~F.coalesce("source", F.lit("")).isin(*skip_sources)
        & (F.coalesce("parent_session_id", F.lit("")) == "") & (F.coalesce("message_count", F.lit(0)) >= 4)
    )


def outcome_window(scores: DataFrame) -> DataFrame:
    """Counts per outcome and the success rate among decided sessions."""
    counted = scores.groupBy("tenant_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "fail", "uncertain")])
    return counted.withColumn("success_rate", F.round(F.try_divide("success", F.col("success") + F.col("fail")), 4))


def failed_sessions(scores: DataFrame, sessions: DataFrame) -> DataFrame:
    return scores.where("outcome = 'fail'").join(sessions.select(*KEYS, "title", "started_at"), list(KEYS)).select(
        *KEYS, "title", "confidence", "label", "reaction", "started_at")


def tail_outcomes(messages: DataFrame, *, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Simple outcome from the end of the last assistant message of more than 20 characters."""
    rows = messages.where((F.col("role") == "assistant") & (F.length(T.strip("content")) > 20))
    rows = rows.where(F.coalesce("active", F.lit(1)) == 1) if "active" in messages.columns else rows
    last = top_rows(rows.select(*KEYS, "msg_id", F.substring("content", -400, 400).alias("tail")), KEYS, [F.desc("msg_id")], 1)
    return last.select(*KEYS, T.tail_outcome("tail", vocab).alias("outcome"))
