"""Review packets: what a reviewer must cover, whether a reply covers it, and the state of the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import vocab as V
from tracemill.operators.grouping import number_rows, top_rows


def _read_as(follow_ups: DataFrame) -> DataFrame:
    """Follow-ups with the result reports may state: old trend claims on lifetime counts read as inconclusive."""
    by_count = F.startswith("metric", F.lit("cluster:")) & F.col("result").isin("improved", "worse")
    lost = F.coalesce(F.col("link_status") == "unresolved", F.lit(False))
    shown = F.when(lost | by_count, "inconclusive").otherwise(F.coalesce("result", F.lit("pending")))
    review = lost | (by_count & (F.col("result") == "worse")) | (~by_count & F.coalesce("recurrence_detected", F.lit(False)))
    return follow_ups.withColumn("shown", shown).withColumn("needs_review", F.coalesce(review, F.lit(False)))


def followup_summary(follow_ups: DataFrame) -> DataFrame:
    """Counts per tenant and result, and how many follow-ups need review."""
    return _read_as(follow_ups).groupBy("tenant_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("shown") == r).alias(r) for r in ("improved", "no_change", "worse", "inconclusive", "pending")],
        F.count_if("needs_review").alias("review_items"))


def evidence_packet(clusters: DataFrame, failed: DataFrame, follow_ups: DataFrame, *, k: int = 10) -> DataFrame:
    """Numbered evidence per tenant: top clusters C#, failed sessions F#, follow-ups to review W#; `required` marks must-cover ones."""
    c = top_rows(clusters, ["tenant_id"], [F.desc("cnt"), F.col("cluster_key")], k, rank="n").select(
        "tenant_id", F.concat(F.lit("C"), "n").alias("item_id"), F.col("cluster_key").alias("subject"), (F.col("cnt") >= 3).alias("required"))
    f = top_rows(failed, ["tenant_id"], [F.desc("started_at"), F.col("session_id")], k, rank="n").select(
        "tenant_id", F.concat(F.lit("F"), "n").alias("item_id"), F.col("session_id").cast("string").alias("subject"), (F.col("confidence") == "high").alias("required"))
    w = _read_as(follow_ups).where("needs_review OR shown = 'worse'").select("tenant_id", "proposal_id", "target", "check_after").distinct()
    day = F.datediff("check_after", F.lit("1970-01-01").cast("date"))
    w = number_rows(w, ["tenant_id"], F.coalesce(day, F.lit(0)), [F.col("proposal_id"), F.col("target")], "n").select(
        "tenant_id", F.concat(F.lit("W"), "n").alias("item_id"), F.concat_ws(":", "proposal_id", "target").alias("subject"), F.lit(True).alias("required"))
    return c.unionByName(f).unionByName(w)


def review_coverage(packet: DataFrame, replies: DataFrame) -> DataFrame:
    """Verdict per reply (`tenant_id, reply_id, text`): accepted, invalid, or the number of required ids it does not mention."""
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\b(C\d+|F\d+|W\d+)\b"), 1))
    must = packet.where("required").select("tenant_id", "item_id").distinct()
    needed = must.groupBy("tenant_id").agg(F.count("*").alias("needed"))
    named = replies.select("tenant_id", "reply_id", F.explode(ids).alias("item_id")).distinct().join(must, ["tenant_id", "item_id"])
    named = named.groupBy("tenant_id", "reply_id").agg(F.count("*").alias("named"))
    valid = (F.length("text") > 100) & F.contains("text", F.lit(V.REPLY_HEADING))
    j = replies.join(named, ["tenant_id", "reply_id"], "left").join(needed, "tenant_id", "left")
    j = j.withColumn("missing", F.coalesce("needed", F.lit(0)) - F.coalesce("named", F.lit(0)))
    return j.select("tenant_id", "reply_id", "missing", F.when(~valid, "empty_or_invalid_output").when(F.col("missing") > 0, "missing_coverage").otherwise("accepted").alias("verdict"))


def review_packet(summaries: DataFrame, cards: DataFrame, proposals: DataFrame, follow_ups: DataFrame, as_of: Column) -> DataFrame:
    """State of the archive and the ledger per tenant: recent sessions, missing cards, duplicate ids, broken and unresolved links, queue."""
    recent = F.col("updated") >= as_of - F.expr("INTERVAL 7 DAYS")
    s = summaries.groupBy("tenant_id").agg(F.count("*").alias("indexed_sessions"), F.count_if(recent).alias("recent_sessions"))
    missing = summaries.select("tenant_id", "session_id").join(cards.select("tenant_id", "session_id"), ["tenant_id", "session_id"], "left_anti").groupBy("tenant_id").agg(F.count("*").alias("missing_cards"))
    ids = proposals.groupBy("tenant_id", "id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("open"))
    p = ids.groupBy("tenant_id").agg((F.sum("n") - F.count("*")).alias("duplicate_ids"), F.sum("open").alias("pending"))
    known = proposals.select("tenant_id", F.col("id").alias("proposal_id"), F.col("target").alias("_t"), F.col("uid").alias("_u"))
    known = known.groupBy("tenant_id", "proposal_id").agg(F.max(F.struct("_t", "_u")).alias("_p"))
    f = follow_ups.join(known, ["tenant_id", "proposal_id"], "left")
    lost = F.coalesce(F.col("link_status") == "unresolved", F.lit(False))
    wrong = ~F.col("target").eqNullSafe(F.col("_p._t")) | (F.col("proposal_uid").isNotNull() & ~F.col("proposal_uid").eqNullSafe(F.col("_p._u")))
    f = f.groupBy("tenant_id").agg(F.count_if(~lost & wrong).alias("mismatched_links"), F.count_if(lost).alias("unresolved_links"))
    out = s.join(missing, "tenant_id", "full").join(p, "tenant_id", "full").join(f, "tenant_id", "full")
    return out.select("tenant_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "tenant_id"])


def seal_packet(packet: DataFrame) -> DataFrame:
    """Content hash per tenant, the same whatever the order of the rows. Each row is hashed with its names and nulls; the rows' digests are
    summed in eight parts, so the seal merges like a sum and a repeated row changes it."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(packet.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = packet.select("tenant_id", row.alias("r")).groupBy("tenant_id").agg(
        F.count("*").alias("n"), *[F.sum(F.conv(F.substring("r", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"d{k}") for k in range(8)])
    return parts.select("tenant_id", F.sha2(F.concat_ws("|", "n", *[F.col(f"d{k}").cast("string") for k in range(8)]), 256).alias("packet_id"))


def complete_reviews(sealed: DataFrame, checks: DataFrame) -> DataFrame:
    """Verdict per tenant for a review (`tenant_id, packet_id, check_id, status, detail`): every check exactly once, each explained.

    Accepted reviews get their state: findings before missing data before ok.
    """
    good = F.col("status").isin(*V.REVIEW_STATUSES) & (F.length(F.coalesce("detail", F.lit(""))) >= 20)
    known = F.col("check_id").isin(*V.REVIEW_CHECKS)
    per = checks.groupBy("tenant_id").agg(
        F.count("*").alias("n"), F.count_distinct(F.when(known, F.col("check_id"))).alias("covered"), F.bool_and(good).alias("explained"), F.min("packet_id").alias("lo"), F.max("packet_id").alias("hi"),
        F.count_if(F.col("status") == "finding").alias("findings"), F.count_if(F.col("status") == "insufficient_data").alias("insufficient"))
    j = per.join(sealed, "tenant_id", "left")
    total = len(V.REVIEW_CHECKS)
    verdict = (
        F.when(F.col("packet_id").isNull() | (F.col("lo") != F.col("packet_id")) | (F.col("hi") != F.col("packet_id")), "refused_wrong_packet")
        .when((F.col("n") != total) | (F.col("covered") != total), "refused_coverage").when(~F.col("explained"), "refused_unexplained")
        .when(F.col("findings") > 0, "reviewed_with_findings").when(F.col("insufficient") > 0, "reviewed_with_insufficient_data").otherwise("ok")
    )
    return j.select("tenant_id", verdict.alias("status"), "findings", "insufficient")


def staleness(stamps: DataFrame, as_of: Column, limits: dict[str, int]) -> DataFrame:
    """Channels (`tenant_id, channel, ts, status, findings`) whose newest stamp is too old, degraded or has findings."""
    newest = stamps.groupBy("tenant_id", "channel").agg(F.max_by(F.struct("ts", "status", "findings"), F.struct("ts", "status")).alias("r")).select("tenant_id", "channel", "r.*")
    limit = None
    for channel, seconds in limits.items():
        limit = (F.when if limit is None else limit.when)(F.col("channel") == channel, seconds)
    age = (F.unix_micros(as_of) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(1_000_000)
    problem = F.when(age > limit, "stale").when(F.coalesce("findings", F.lit(0)) > 0, "findings").when(~F.col("status").isin("ok", "reviewed_with_findings"), "degraded")
    return newest.withColumn("problem", problem).where("problem IS NOT NULL").select("tenant_id", "channel", "problem")
