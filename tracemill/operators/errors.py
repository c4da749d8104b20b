"""Error events: recurring patterns, reports, the daily ledger and log failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill import vocab as V
from tracemill.functions import keys as K
from tracemill.functions import text as T
from tracemill.operators.grouping import number_rows, ordered_list, time_chunk, top_rows


def cluster_errors(errors: DataFrame, *, by: tuple[str, ...] = ("tenant_id",), order: str = "event_id") -> DataFrame:
    """One row per fingerprint: count, sources, first and last day, shortest title and the first two distinct examples.

    Input: `error_text, source, cnt, first_seen, last_seen` plus the order column. Equal texts are folded first, so a
    pattern that holds most of all events arrives at its group as partial sums.
    """
    group = [*by, "cluster_key"]
    text = F.coalesce("error_text", F.lit(""))
    folded = (
        errors.select(
            *by, F.col(order).alias("ord"), text.alias("txt"), F.coalesce("source", F.lit("")).alias("source"),
            F.greatest(F.coalesce("cnt", F.lit(1)), F.lit(1)).alias("cnt"), "first_seen", "last_seen",
        )
        .groupBy(*by, "txt")
        .agg(
            F.sum("cnt").alias("cnt"), F.min("ord").alias("ord"), F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"), F.collect_set(F.nullif("source", F.lit(""))).alias("sources"),
        )
        .withColumn("cluster_key", K.cluster_key("txt"))
    )
    shown = F.substring("txt", 1, 120)
    total = folded.groupBy(*group).agg(
        F.sum("cnt").cast("long").alias("cnt"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min_by(shown, F.struct(F.least(F.length("txt"), F.lit(120)), "ord")).alias("title"),
    )
    examples = (
        top_rows(folded.where("txt <> ''").select(*group, "ord", F.substring("txt", 1, 200).alias("txt")), group, [F.col("ord")], 2)
        .groupBy(*group).agg(ordered_list("txt", "ord").alias("examples"))
    )
    return total.join(examples, group, "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def failure_events(events: DataFrame) -> DataFrame:
    """Events that report a failure; banners and summaries dropped, exact repeats of an event id counted once."""
    t = F.coalesce("what", "key", F.lit(""))
    kept = events.withColumn("error_text", t).where(
        ~T.strip(t).rlike(V.BANNER) & t.rlike(V.FAIL_HINT) & ~t.rlike(V.NOT_FAILURE_TEXT)
    )
    seen = K.date_in(F.coalesce("last_seen", "date", "timestamp"))
    return (
        kept.withColumn("event_key", F.coalesce("event_id", "run_id", F.sha2(F.to_json(F.struct(*events.columns)), 256)))
        .withColumn("last_seen", seen)
        .withColumn("first_seen", F.coalesce(K.date_in("first_seen"), seen))
        .withColumn("source", F.coalesce("source", "job"))
        .withColumn("cnt", F.greatest(F.coalesce(F.col("count").cast("int"), F.lit(1)), F.lit(1)))
        .groupBy("event_key")
        .agg(F.min_by(F.struct("ordinal", "error_text", "source", "cnt", "first_seen", "last_seen"), "ordinal").alias("r"))
        .select("event_key", "r.*")
    )


def incident_notes(notes: DataFrame) -> DataFrame:
    """One failure per incident note: its first telling heading, else the file name without its date."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    heads = F.regexp_extract_all("body", F.lit(r"(?md)^# (.*)$"), 1)
    telling = F.filter(F.transform(heads, lambda h: T.strip(h)), lambda h: ~F.lower(h).isin(*V.GENERIC_HEADINGS))
    stem = F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), r"^\d{4}-\d{2}-\d{2}-?", "")
    title = F.coalesce(F.get(telling, F.lit(0)), stem)
    return (
        notes.where(~name.rlike(V.NOT_INCIDENT_NAME) & name.rlike(V.FAIL_HINT))
        .select(
            F.concat(F.lit("incident:"), name).alias("event_id"), title.alias("error_text"), F.lit("incident").alias("source"),
            F.lit(1).alias("cnt"), K.date_in(name).alias("first_seen"), K.date_in(name).alias("last_seen"),
        )
        .where(~F.lower("error_text").isin(*V.GENERIC_HEADINGS) & ~F.col("error_text").rlike(V.BANNER) & ~F.col("error_text").rlike(V.NOT_FAILURE_TEXT))
    )


def recent_failures(entries: DataFrame, days: int | None, as_of: Column) -> DataFrame:
    """Failures of the last days; entries without a date never count as recent."""
    return entries if days is None else entries.where(F.col("last_seen") >= F.date_sub(F.to_date(as_of), days))


def error_report(errors: DataFrame, as_of: Column, *, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Count and whole percent per category, with today's and the last week's share of it."""
    today = F.to_date(as_of)
    day = F.to_date("ts")
    counted = errors.groupBy(*by, F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count("*").alias("n"), F.count_if(day == today).alias("today"), F.count_if(day >= F.date_sub(today, 7)).alias("week"),
    )
    total = F.sum("n").over(Window.partitionBy(*by))
    return counted.withColumn("percent", (F.floor(F.col("n") * 100 / total)).cast("long"))


def top_messages(errors: DataFrame, k: int, *, by: tuple[str, ...] = ("tenant_id",), column: str = "message", at_least: int = 1, first: str = "event_id") -> DataFrame:
    """Most frequent values of a column per group; equal counts in order of first appearance."""
    counted = errors.groupBy(*by, column).agg(F.count("*").alias("n"), F.min(first).alias("first")).where(F.col("n") >= at_least)
    return top_rows(counted, by, [F.desc("n"), F.col("first")], k, rank="position").drop("first")


def keep_last(errors: DataFrame, k: int = 100, *, by: tuple[str, ...] = ("tenant_id",), order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest `k` rows per group."""
    return top_rows(errors, by, [F.desc(o) for o in order], k)


def learning_report(errors: DataFrame, *, at_least: int = 3, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Frequent messages (ten), top messages (fifteen) and top tools (ten), one section per row group."""
    def section(name, df, column):
        return df.select(*by, F.lit(name).alias("section"), F.col(column).alias("value"), "n", "position")

    return (
        section("frequent", top_messages(errors, 10, by=by, at_least=at_least), "message")
        .unionByName(section("top", top_messages(errors, 15, by=by), "message"))
        .unionByName(section("tool", top_messages(errors, 10, by=by, column="tool"), "tool"))
    )


def repeated_themes(titles: DataFrame, *, by: tuple[str, ...] = (), distinct: bool = True, at_least: int = 2) -> DataFrame:
    """Title words (two or more letters or CJK characters) that occur in several titles."""
    words = F.regexp_extract_all("title", F.lit("[一-龥A-Za-z]{2,}"), 0)
    words = F.array_distinct(words) if distinct else words
    return (
        titles.select(*by, F.explode(words).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    )


def job_failures(executions: DataFrame, jobs: DataFrame, day: str, *, tz: str = "UTC") -> DataFrame:
    """Failed executions of one day with the job's name and the first line of the error. The day ends at the next midnight."""
    failed = executions.where((F.col("status") == "failed") & K.in_day("claimed_at", day, tz))
    first_line = F.substring(F.split(T.strip(F.coalesce("error", F.lit(""))), "\n", 2)[0], 1, 140)
    names = jobs.select("job_id", F.col("name").alias("job_name"))
    return failed.join(names, "job_id", "left").select(
        *[c for c in ("tenant_id",) if c in executions.columns], "job_id",
        F.coalesce("job_name", F.substring("job_id", 1, 8)).alias("name"),
        F.date_format(F.from_utc_timestamp("claimed_at", tz), "HH:mm").alias("at"), first_line.alias("err"), F.lit("cron").alias("source"),
    )


def run_status(stamps: DataFrame, day: str, *, by: tuple[str, ...] = ("tenant_id",), tz: str = "UTC") -> DataFrame:
    """Newest status stamp per group, if it is of that day."""
    newest = stamps.groupBy(*by).agg(F.max_by(F.struct("status", "note", "ts"), F.struct("ts", "status")).alias("r")).select(*by, "r.*")
    return newest.where(K.in_day("ts", day, tz))


def scheduler_failures(lines: DataFrame, day: str, *, last: int = 400) -> DataFrame:
    """Failure lines of one day among the last lines of every log file."""
    tail = top_rows(lines, ["path"], [F.desc("ordinal")], last)
    part = lambda i: F.regexp_extract("line", V.LOG_FAILURE_LINE, i)
    return tail.where(F.col("line").rlike(V.LOG_FAILURE_LINE) & (part(1) == day)).select(
        F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("name"), "ordinal", F.substring(T.strip(part(2)), 1, 140).alias("err"),
    )


def tool_errors(lines: DataFrame) -> DataFrame:
    """Tool failures from a runtime log: time, tool and `tool: message`."""
    part = lambda i: F.regexp_extract("line", V.TOOL_ERROR_LINE, i)
    payload = part(3)
    quoted = F.regexp_extract(payload, r'"error":\s*"([^"]+)"', 1)
    message = F.when(quoted != "", quoted).otherwise(F.substring(payload, 1, 200))
    return lines.where(F.col("line").rlike(V.TOOL_ERROR_LINE)).select(
        "path", "ordinal", part(1).try_cast("timestamp").alias("ts"), part(2).alias("tool"),
        F.concat(part(2), F.lit(": "), F.substring(message, 1, 150)).alias("message"),
    )


def daily_errors(day: str, job_failures: DataFrame, log_failures: DataFrame, statuses: DataFrame) -> DataFrame:
    """The three error sources of a day in one shape, with the key that identifies a recurrence."""
    def shaped(df, channel, source, name, err, severity, key_tail):
        return df.select(
            "tenant_id", F.concat(F.lit(f"{day}|{channel}|"), key_tail).alias("error_key"), F.lit(source).alias("source"),
            name.alias("job"), F.lit(severity).alias("severity"), err.alias("what"),
        )

    short = F.concat_ws("|", "name", F.substring("err", 1, 60))
    failed = statuses.where("status IS NOT NULL AND status <> 'ok'")
    return (
        shaped(job_failures, "cron", "cron", F.col("name"), F.col("err"), "high", short)
        .unionByName(shaped(log_failures, "launchd", "launchd", F.col("name"), F.col("err"), "medium", short))
        .unionByName(shaped(failed, "autoupdate", "auto-update", F.lit("auto-update"), F.substring(F.coalesce("note", "status"), 1, 140), "high", F.col("status")))
    )


def upsert_errors(ledger: DataFrame, incoming: DataFrame, day: str, run_id: str) -> DataFrame:
    """Ledger with the errors of a run added. Running the same run again changes nothing.

    Ledger: `tenant_id, error_key, source, job, severity, what, cnt, first_seen, last_seen, run_ids`.
    """
    d = F.to_date(F.lit(day))
    new = incoming.groupBy("tenant_id", "error_key").agg(
        F.count("*").alias("n"), *[F.min(c).alias(f"n_{c}") for c in ("source", "job", "severity", "what")]
    )
    joined = ledger.join(new, ["tenant_id", "error_key"], "full")
    runs = F.coalesce("run_ids", F.array().cast("array<string>"))
    counts = F.col("n").isNotNull() & ~F.array_contains(runs, run_id)
    return joined.select(
        "tenant_id", "error_key", *[F.coalesce(c, f"n_{c}").alias(c) for c in ("source", "job", "severity", "what")],
        (F.coalesce("cnt", F.lit(0)) + F.when(counts, F.col("n")).otherwise(0)).cast("long").alias("cnt"),
        F.coalesce("first_seen", d).alias("first_seen"),
        F.when(counts, F.greatest(F.coalesce("last_seen", d), d)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(counts, F.array_append(runs, F.lit(run_id))).otherwise(runs).alias("run_ids"),
    )


def mark_jobs(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """ok / failed mark per job session: failed when a failure of the tenant has its name, or a ten-character prefix of it.

    A failed name decides by its first ten characters (a shorter one by all of it), so the prefix test is an equality test on
    the lengths that occur, at most eleven of them.
    """
    name = F.split("title", " · ", 2)[0]
    probes = failures.select("tenant_id", F.substring("name", 1, 10).alias("probe")).where("probe <> ''").distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(10), F.greatest(F.length("name"), F.lit(1)))), lambda n: F.substr(F.col("name"), F.lit(1), n))
    named = jobs.withColumn("name", name)
    hit = (
        named.select("tenant_id", "name").distinct().withColumn("probe", F.explode(prefixes))
        .join(probes, ["tenant_id", "probe"], "left_semi").select("tenant_id", "name").distinct().withColumn("failed", F.lit(True))
    )
    return named.join(hit, ["tenant_id", "name"], "left").withColumn("mark", F.when(F.col("failed"), "failed").otherwise("ok")).drop("failed")


def missing_days(outputs: DataFrame, groups: DataFrame, day: str, back: int) -> DataFrame:
    """Days among the last `back` before `day` for which a group has no output."""
    d = F.to_date(F.lit(day))
    expected = groups.withColumn("day", F.explode(F.sequence(F.date_sub(d, back), F.date_sub(d, 1))))
    return expected.join(outputs, [*groups.columns, "day"], "left_anti")


def number_errors(errors: DataFrame, *, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Position of every error in its group's timeline."""
    return number_rows(errors, by, time_chunk("ts", 86_400), [F.col("ts"), F.col("event_id")], "position")
