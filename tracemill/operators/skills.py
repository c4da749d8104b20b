"""How often skills are loaded, how often loading fails, and which skills to retire, repair or disable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import keys as K
from tracemill.operators.grouping import id_chunk, nearest_value, number_rows, top_rows

KEYS = ("tenant_id", "session_id")


def skill_calls(messages: DataFrame) -> DataFrame:
    """One row per `skill_view` call of an assistant message."""
    raw = messages.where((F.col("role") == "assistant") & F.contains("tool_calls", F.lit("skill_view")))
    calls = raw.select(*KEYS, "msg_id", "ts", F.posexplode(K.tool_calls("tool_calls")).alias("call_no", "c"))
    return (
        calls.where("c.tool = 'skill_view'").select(*KEYS, "msg_id", "ts", "call_no", K.bare_name(F.col("c.arguments.name")).alias("skill"), "c.call_id")
        .where("skill <> ''")
    )


def skill_edits(messages: DataFrame) -> DataFrame:
    """Number of `skill_manage` operations per skill."""
    raw = messages.where((F.col("role") == "assistant") & F.contains("tool_calls", F.lit("skill_manage")))
    ops = raw.select("tenant_id", F.explode(K.tool_calls("tool_calls")).alias("c")).where("c.tool = 'skill_manage'")
    ops = ops.select("tenant_id", F.explode("c.arguments.operations").alias("op")).where("op.name <> ''")
    return ops.groupBy("tenant_id", F.col("op.name").alias("skill")).agg(F.count("*").alias("edits"))


def call_outcomes(calls: DataFrame, messages: DataFrame) -> DataFrame:
    """Each call with `failed` from its own tool result, else from the next tool row of the session (`approximate`).

    Results are reduced to a flag before anything is shuffled. Several calls of one message are judged one by one.
    """
    tool = messages.where("role = 'tool'").select(*KEYS, "msg_id", "tool_call_id", F.col("content").isNotNull().alias("told"), K.tool_failed("content").alias("failed"))
    direct = tool.where("tool_call_id IS NOT NULL").groupBy("tenant_id", "tool_call_id").agg(F.min_by("failed", "msg_id").alias("own"))
    # Calls without an id can't have a result of their own and stay out of the join, where their nulls would be one key.
    own = direct.withColumnRenamed("tool_call_id", "call_id")
    judged = calls.where("call_id IS NOT NULL").join(own, ["tenant_id", "call_id"], "left").unionByName(calls.where("call_id IS NULL").withColumn("own", F.lit(None).cast("boolean")))
    open_calls = judged.where("own IS NULL")
    columns = ["skill", "call_id", "call_no", "ts"]
    both = open_calls.select(*KEYS, "msg_id", *columns, F.lit(None).cast("boolean").alias("_f")).unionByName(
        tool.where("told").select(*KEYS, "msg_id", F.col("failed").alias("_f")), allowMissingColumns=True)
    near = nearest_value(both, KEYS, F.col("msg_id"), id_chunk("msg_id"), F.col("_f"), "own", tie=F.col("msg_id"), forward=True).where("skill IS NOT NULL")
    exact = judged.where("own IS NOT NULL").select(*KEYS, "msg_id", *columns, F.col("own").alias("failed"), F.lit(False).alias("approximate"))
    return exact.unionByName(near.select(*KEYS, "msg_id", *columns, F.coalesce("own", F.lit(False)).alias("failed"), F.lit(True).alias("approximate")))


def skill_metrics(loads: DataFrame, as_of: Column) -> DataFrame:
    """Distinct sessions and failures (all and last 30 days), last use, sessions that loaded the skill again.

    Input `tenant_id, session_id, skill, ts, failed`. Names are compared without case; counts are taken once per call.
    """
    recent = F.col("ts") >= as_of - F.expr("INTERVAL 30 DAYS")
    per_session = loads.groupBy("tenant_id", F.lower("skill").alias("skill_key"), "session_id").agg(
        F.min("skill").alias("skill"), F.count("*").alias("n"), F.count_if("failed").alias("errors"), F.bool_or(recent).alias("recent"),
        F.count_if(F.col("failed") & recent).alias("recent_errors"), F.max("ts").alias("last"),
    )
    return per_session.groupBy("tenant_id", "skill_key").agg(
        F.min("skill").alias("skill"), F.count("*").alias("load_sessions"), F.count_if("recent").alias("load_sessions_30d"),
        F.sum("errors").alias("self_errors"), F.sum("recent_errors").alias("recent_self_errors"),
        F.count_if(F.col("n") >= 2).alias("reload_sessions"), F.floor(K.age_seconds(F.max("last").cast("timestamp"), as_of) / 86_400).cast("int").alias("last_used_days"),
    )


def one_entry_per_name(catalog: DataFrame) -> DataFrame:
    """The catalog with its `skill_key`, one entry per tenant and key; whether any entry is archived stays known."""
    rest = [c for c in catalog.columns if c != "tenant_id"]
    first = F.struct((~F.coalesce("installed", F.lit(False))).alias("_away"), *rest)
    folded = catalog.groupBy("tenant_id", F.lower("name").alias("skill_key")).agg(F.min(first).alias("e"), F.max(F.coalesce("archived", F.lit(False))).alias("_archived"))
    return folded.select("tenant_id", "skill_key", *[F.col("_archived").alias(c) if c == "archived" else F.col(f"e.{c}").alias(c) for c in rest])


def skill_facts(metrics: DataFrame, catalog: DataFrame, edits: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """Catalog and usage side by side; a used name that is not in the catalog is a broken reference.

    Catalog: `tenant_id, name, installed, archived, disabled, size_bytes, age_days, usage_quality`. Several entries of a name, in any case,
    are one record: the installed one counts, before an archived one, then the first name.
    """
    keys = ["tenant_id", "skill_key"]
    cat = one_entry_per_name(catalog)
    full = cat.join(metrics, keys, "full")
    for extra, column in ((edits, "edits"), (mentions, "vault_mentions_90d")):
        if extra is None:
            full = full if column in full.columns else full.withColumn(column, F.lit(0).cast("long"))
        else:
            counted = extra.groupBy("tenant_id", F.lower("skill").alias("skill_key")).agg(F.sum(column).alias(column))
            full = full.drop(column).join(counted, keys, "left")
    zero = ("load_sessions", "load_sessions_30d", "self_errors", "recent_self_errors", "reload_sessions", "edits", "vault_mentions_90d")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return full.select(
        "tenant_id", "skill_key", F.coalesce("name", "skill").alias("name"), flag("installed"), flag("disabled"), flag("archived"),
        "size_bytes", "age_days", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], "last_used_days",
        F.coalesce("usage_quality", F.lit("measured")).alias("usage_quality"),
    )


def usage_totals(facts: DataFrame) -> DataFrame:
    """Installed, used, unused and broken counts per tenant."""
    used = F.col("load_sessions") > 0
    return facts.groupBy("tenant_id").agg(
        F.count_if("installed").alias("total_installed"), F.count_if(used).alias("used"),
        F.count_if(F.col("installed") & ~used).alias("dead"), F.count_if(~F.col("installed") & used).alias("broken_ref"),
    )


def top_used(facts: DataFrame, k: int = 10) -> DataFrame:
    used = facts.where("load_sessions > 0")
    return top_rows(used, ["tenant_id"], [F.desc("load_sessions"), F.col("name")], k, rank="position").select("tenant_id", "position", "name", "load_sessions")


# ---- weekly snapshots -----------------------------------------------------------------------------------------------
def weekly_loads(loads: DataFrame, as_of: Column, *, weeks: int = 6) -> DataFrame:
    """Loads per Monday week and skill over the last weeks."""
    recent = loads.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(weeks * 7)))
    return recent.groupBy("tenant_id", K.week_of("ts").alias("week"), F.lower("skill").alias("skill")).agg(F.count("*").cast("int").alias("load"))


def backfill_snapshots(snapshots: DataFrame, weekly: DataFrame, *, keep: int = 26) -> DataFrame:
    """Adds weeks that have no snapshot yet; weeks that have one stay as they are."""
    missing = weekly.join(snapshots.select("tenant_id", "week").distinct(), ["tenant_id", "week"], "left_anti")
    zero = [F.lit(0).alias(c) for c in ("self_err", "reload", "edits")]
    filled = missing.select("tenant_id", "week", "skill", "load", *zero, F.lit(False).alias("disabled"), F.lit(True).alias("backfilled"))
    return keep_snapshots(snapshots.unionByName(filled), keep=keep)


def add_snapshot(snapshots: DataFrame, facts: DataFrame, day: str, *, keep: int = 26) -> DataFrame:
    """Adds the facts as the snapshot of a day; an earlier one of the same day is replaced."""
    d = F.to_date(F.lit(day))
    tenants = facts.select("tenant_id", d.alias("week")).distinct()
    new = facts.select(
        "tenant_id", d.alias("week"), F.col("name").alias("skill"), F.col("load_sessions").cast("int").alias("load"), F.col("self_errors").cast("int").alias("self_err"),
        F.col("reload_sessions").cast("int").alias("reload"), F.col("edits").cast("int").alias("edits"), "disabled", F.lit(False).alias("backfilled"))
    return keep_snapshots(snapshots.join(tenants, ["tenant_id", "week"], "left_anti").unionByName(new), keep=keep)


def _newest_weeks(snapshots: DataFrame, k: int, rank: str = "nth") -> DataFrame:
    """The newest `k` weeks per tenant, ranked on the distinct weeks only."""
    return top_rows(snapshots.select("tenant_id", "week").distinct(), ["tenant_id"], [F.desc("week")], k, rank=rank)


def keep_snapshots(snapshots: DataFrame, *, keep: int = 26) -> DataFrame:
    return snapshots.join(_newest_weeks(snapshots, keep).select("tenant_id", "week"), ["tenant_id", "week"], "left_semi")


def baseline(snapshots: DataFrame, as_of: Column, *, weeks: int = 3) -> tuple[DataFrame, DataFrame]:
    """(tenants that have a baseline, skills used in it): the last `weeks` snapshots that are older than three days."""
    old = snapshots.where(F.col("week") < F.date_sub(F.to_date(as_of), 3))
    recent = _newest_weeks(old, weeks)
    ready = recent.groupBy("tenant_id").agg(F.count("*").alias("n")).where(F.col("n") >= weeks).select("tenant_id")
    used = old.join(recent.select("tenant_id", "week"), ["tenant_id", "week"], "left_semi").where(F.col("load") > 0)
    return ready, used.select("tenant_id", F.lower("skill").alias("skill_key")).distinct()


# ---- proposals from facts -------------------------------------------------------------------------------------------
def retire_candidates(facts: DataFrame, ready: DataFrame, used: DataFrame, *, min_age: int = 90, k: int = 5) -> DataFrame:
    """Unused, old, unprotected skills of tenants with a baseline; the five largest per tenant."""
    fit = facts.where(
        F.col("installed") & ~F.col("disabled") & ~K.is_protected(F.col("name"), retire=True) & (F.col("load_sessions") == 0)
        & (F.col("usage_quality") != "unknown") & (F.coalesce("age_days", F.lit(0)) >= min_age) & (F.coalesce("vault_mentions_90d", F.lit(0)) == 0)
    )
    fit = fit.join(ready, "tenant_id", "left_semi").join(used, ["tenant_id", "skill_key"], "left_anti")
    return top_rows(fit, ["tenant_id"], [F.desc(F.coalesce("size_bytes", F.lit(0))), F.col("name")], k, rank="position").select(
        "tenant_id", "position", F.lit("retire").alias("kind"), F.col("name").alias("target"), "size_bytes", "age_days")


def repair_candidates(facts: DataFrame) -> DataFrame:
    """Skills that failed to load in the last 30 days: missing ones need a new reference, present ones a repair."""
    failing = F.col("recent_self_errors") > 0
    kind = F.when(F.col("installed") & failing, "repair").when(~F.col("installed") & ~F.col("archived") & failing, "fix_reference")
    return facts.withColumn("kind", kind).where("kind IS NOT NULL").select("tenant_id", "kind", F.col("name").alias("target"), "self_errors", "recent_self_errors")


def cap_plan(facts: DataFrame, *, cap: int = 120, min_age: int = 90) -> tuple[DataFrame, DataFrame]:
    """(actions, totals) that bring every tenant down to `cap` active skills, largest first.

    `disable` for measured fleets, `review` where no usage was ever measured, `conflict` for skills that notes still mention.
    The order is cut by exact position, whatever the number of skills of a tenant.
    """
    active = facts.where(F.col("installed") & ~F.col("disabled")).withColumn("size", F.coalesce("size_bytes", F.lit(0)))
    totals = active.groupBy("tenant_id").agg(
        F.count("*").alias("active_before"), F.bool_or(F.col("usage_quality") == "measured").alias("measured"),
    ).withColumn("over", F.greatest(F.col("active_before") - cap, F.lit(0)))
    idle = (F.col("load_sessions") == 0) & (F.coalesce("age_days", F.lit(0)) >= min_age) & ~K.is_protected(F.col("name"), retire=False)
    mentioned = F.coalesce("vault_mentions_90d", F.lit(0)) > 0
    over = active.join(totals.where("over > 0").select("tenant_id", "measured", "over"), "tenant_id").withColumn("idle", idle).withColumn("mentioned", mentioned)
    eligible = over.where(~F.col("measured") | (F.col("idle") & ~F.col("mentioned")))
    ranked = number_rows(eligible, ["tenant_id"], -F.floor(F.col("size") / F.lit(1024)), [F.desc("size"), F.col("name")], "position").where("position <= over")
    columns = ["tenant_id", "name", "size_bytes", "age_days"]
    chosen = ranked.select(*columns, F.when(F.col("measured"), "disable").otherwise("review").alias("action"))
    conflicts = over.where("measured AND idle AND mentioned").select(*columns, F.lit("conflict").alias("action"))
    done = chosen.groupBy("tenant_id").agg(F.count_if(F.col("action") == "disable").alias("disabled_now"))
    summary = totals.join(done, "tenant_id", "left").select(
        "tenant_id", F.lit(cap).alias("cap"), "active_before", (F.col("active_before") - F.coalesce("disabled_now", F.lit(0))).alias("active_after"),
        F.when(F.col("measured"), F.col("over") - F.coalesce("disabled_now", F.lit(0))).otherwise(F.lit(0)).alias("skipped"),
        F.when(F.col("measured"), "measured").otherwise("unknown").alias("usage_quality"),
    )
    return chosen.unionByName(conflicts), summary

