"""Evidence of a day: what users asked, what was concluded, within a size budget that never drops a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import keys as K
from tracemill.functions import text as T
from tracemill.operators.grouping import ordered_list, top_rows
from tracemill.vocab import DEFAULT, Vocabulary

KEYS = ("tenant_id", "session_id")


def session_evidence(messages: DataFrame, sessions: DataFrame, day: str | None = None, *, tz: str = "UTC", vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Per session: first four requests, last three conclusions (else the longest and the last answer), class and counts."""
    keys = list(KEYS)
    chosen = sessions if day is None else sessions.where(K.in_day("started_at", day, tz))
    active = messages.where(F.coalesce("active", F.lit(1)) == 1) if "active" in messages.columns else messages
    said = active.join(chosen.select(*KEYS), keys, "left_semi").select(*KEYS, "role", "ts", "msg_id", T.clean_lines("content").alias("text"))
    said = said.where("text <> ''")
    order = [F.col("ts"), F.col("msg_id")]
    users = top_rows(said.where("role = 'user'").withColumn("text", T.denoise("text", vocab)), KEYS, order, 4, rank="nth")
    requests = users.groupBy(*KEYS).agg(ordered_list("text", "nth").alias("requests"))

    answers = said.where("role = 'assistant'").select(*KEYS, "ts", "msg_id", F.length("text").alias("size"), F.md5("text").alias("digest"), "text")
    concluding = answers.where(F.col("text").rlike(T.any_of(vocab.conclusion)) & (F.col("size") > 30))
    last = top_rows(concluding.select(*KEYS, "ts", "msg_id", F.substring("text", 1, 260).alias("text")), KEYS, [F.desc("ts"), F.desc("msg_id")], 3)
    concluded = last.groupBy(*KEYS).agg(ordered_list("text", F.struct("ts", "msg_id")).alias("concluded"))
    view = F.struct("digest", F.substring("text", 1, 260).alias("text"))
    ends = answers.groupBy(*KEYS).agg(
        F.max_by(view, F.struct("size", -F.unix_micros(F.col("ts").cast("timestamp")), -F.col("msg_id"))).alias("longest"), F.max_by(view, F.struct("ts", "msg_id")).alias("tail"),
    ).select(*KEYS, F.when(F.col("longest.digest") == F.col("tail.digest"), F.array("longest.text")).otherwise(F.array("longest.text", "tail.text")).alias("ends"))

    empty = F.array().cast("array<string>")
    joined = chosen.join(requests, keys, "left").join(concluded, keys, "left").join(ends, keys, "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.substring(F.col("session_id").cast("string"), 1, 14))
    first = F.coalesce(F.get("requests", F.lit(0)), F.lit(""))
    messages_n, tools_n = F.coalesce("message_count", F.lit(0)), F.coalesce("tool_call_count", F.lit(0))
    return joined.select(
        *KEYS, title.alias("title"), messages_n.alias("messages"), tools_n.alias("tools"), F.col("started_at"), F.col("source"),
        F.coalesce("requests", empty).alias("requests"), F.coalesce("concluded", "ends", empty).alias("conclusions"),
        T.session_class(F.col("source"), title, messages_n, tools_n, first, vocab).alias("class"),
    )


def fit_budget(evidence: DataFrame, *, many: int = 6, budget: int = 14_000, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Lists cut so that a tenant's day fits: two and two for more than `many` sessions, one and one if still too long. `by` names what has a
    budget of its own; evidence of several days needs the day too."""
    def weight(n):
        lists = [F.slice(c, 1, n) for c in ("requests", "conclusions")]
        return F.length("title") + sum((F.length(F.array_join(x, "")) for x in lists), F.lit(0))

    size = evidence.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(weight(2)).alias("_chars"))
    keep = F.when(F.col("_n") <= many, F.lit(4)).when(F.col("_chars") <= budget, F.lit(2)).otherwise(F.lit(1))
    out = evidence.join(size.select(*by, keep.alias("kept")), list(by))
    return out.withColumn("requests", F.slice("requests", F.lit(1), F.col("kept"))).withColumn("conclusions", F.slice("conclusions", F.lit(1), F.col("kept")))
