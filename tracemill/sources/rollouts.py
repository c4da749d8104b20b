"""Session logs: JSON lines, one file per run of an agent, archived files before active ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import keys as K
from tracemill.functions import text as T
from tracemill.operators.grouping import id_chunk, nearest_value, number_rows, top_rows
from tracemill.session import materialize

KEYS = ("tenant_id", "session_id")
POSITION = ("root_order", "path", "ordinal")
FILE = ("tenant_id", "root_order", "path")
#: Lines in a block by which sessions are joined.
LINE_BLOCK = 256
_FILE_ID = r"(?i)(?:rollout-)?(?:\d{4}-\d{2}-\d{2}T[^-]+-)?([0-9a-f]{8}-[0-9a-f-]{27,})"


def read_raw_lines(spark: SparkSession, paths: str | Sequence[str], *, pattern: str = "*") -> DataFrame:
    """`path, start, seq, line` of text files: the split a line is in and its place among the lines of its task. Nothing is moved."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .text([paths] if isinstance(paths, str) else list(paths))
        .select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"),
        )
    )


def numbered_lines(rows: DataFrame, file: Sequence[str]) -> DataFrame:
    """`ordinal` (from 0 in each file) in place of `start` and `seq`.

    Files stay splittable: a split is read in order, so lines are numbered inside their split and shifted by the line counts
    of the splits before it. No task sees more than one split of a file.
    """
    return number_rows(rows, file, F.col("start"), [F.col("seq")], "ordinal").withColumn("ordinal", F.col("ordinal") - 1).drop("start", "seq")


def read_lines(spark: SparkSession, paths: str | Sequence[str], *, pattern: str = "*") -> DataFrame:
    """`path, ordinal, line` of text files, `ordinal` being the line number from 0."""
    return numbered_lines(read_raw_lines(spark, paths, pattern=pattern), ["path"]).select("path", "ordinal", "line")


def read_rollouts(spark: SparkSession, roots: Sequence[str], *, tenant_id: int | Column = 0) -> DataFrame:
    """Raw lines of all roots, not yet numbered; earlier roots win when a message appears in several."""
    tenant = F.lit(tenant_id) if isinstance(tenant_id, int) else tenant_id
    parts = [
        read_raw_lines(spark, root, pattern="*.jsonl").select(tenant.cast("long").alias("tenant_id"), F.lit(i).alias("root_order"), "path", "start", "seq", "line")
        for i, root in enumerate(roots)
    ]
    return reduce(DataFrame.unionByName, parts)


def file_session_id(path: str | Column) -> Column:
    name = F.regexp_extract(T.col(path), "([^/]*)$", 1)
    found = F.regexp_extract(name, _FILE_ID, 1)
    stem = F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("rollout-"), F.lit(""))
    return F.when(found != "", found).otherwise(stem)


def _read_record(line: Column) -> list[Column]:
    """What later steps need of a line's record, so that no payload is moved or sorted: of its text an excerpt, a digest and whether it counts as
    a message or as proof."""
    v = F.try_parse_json(line)

    def text(path):
        return F.try_variant_get(v, path, "string")

    kind, payload_type, role = F.coalesce(text("$.type"), F.lit("")), text("$.payload.type"), text("$.payload.role")
    said = (kind == "response_item") & (payload_type == "message") & role.isin("user", "assistant")

    def of_text(raw: Column) -> Column:
        clean = F.when(said, T.clean_message(raw, role))
        return F.struct(
            F.when(said, T.excerpt(clean)).otherwise(T.excerpt(raw)).alias("text"), F.substring(F.sha1(raw), 1, 16).alias("digest"),
            F.coalesce((raw != "") & (F.length(clean) >= 2) & ~T.is_meta(clean), F.lit(False)).alias("is_message"), T.is_verified(raw, payload_type).alias("verified"))

    found = F.when(kind.isin("response_item", "event_msg"), T.let(T.visible_text(F.to_json(F.try_variant_get(v, "$.payload", "variant"))), of_text))
    return [
        v.isNotNull().alias("is_record"), kind.alias("type"), payload_type.alias("payload_type"), role.alias("role"),
        K.parse_ts(F.coalesce(F.nullif(text("$.timestamp"), F.lit("")), text("$.payload.timestamp"))).alias("ts"),
        F.when(kind == "session_meta", F.coalesce(F.nullif(text("$.payload.session_id"), F.lit("")), F.nullif(text("$.payload.id"), F.lit("")), F.lit(""))).alias("named"),
        F.coalesce(text("$.payload.id"), text("$.payload.call_id")).alias("item_id"),
        F.coalesce(
            F.nullif(text("$.payload.internal_chat_message_metadata_passthrough.turn_id"), F.lit("")), text("$.payload.turn_id"), F.lit("")
        ).alias("turn_id"),
        F.coalesce(text("$.payload.turn_id"), F.lit("")).alias("event_turn"),
        F.nullif(text("$.payload.cwd"), F.lit("")).alias("cwd"), F.nullif(text("$.payload.source"), F.lit("")).alias("source"),
        found.alias("found"),
    ]


def session_intervals(records: DataFrame) -> DataFrame:
    """FILE, block, low, high and named: the lines that each `session_meta` names, up to the next one or the end of its file, once for each
    block of `LINE_BLOCK` lines they reach into. Few rows: those of the metas, and one for each block."""
    metas = records.where("named IS NOT NULL").select(*FILE, "ordinal", "named")
    metas = nearest_value(metas, FILE, F.col("ordinal"), id_chunk("ordinal", 65536), F.col("ordinal"), "following", forward=True)
    ends = records.groupBy(*FILE).agg(F.max("ordinal").alias("end"))
    lines = metas.join(ends, list(FILE)).select(*FILE, "named", F.col("ordinal").alias("low"), F.coalesce(F.col("following") - 1, F.col("end")).alias("high"))
    return lines.select(*FILE, "low", "high", "named", F.explode(F.sequence(id_chunk("low", LINE_BLOCK), id_chunk("high", LINE_BLOCK))).alias("block"))


def parse_rollouts(lines: DataFrame) -> DataFrame:
    """Records with their session: the last `session_meta` above a line in its file names the session, else the file name.

    Lines come numbered (`ordinal`) or as read (`start, seq`); these are numbered after parsing, when only excerpts are left. The parsed
    rows are stored once, and sessions are joined to them by block of lines.
    """
    place = ["ordinal"] if "ordinal" in lines.columns else ["start", "seq"]
    read = lines.select(*FILE, *place, *_read_record(F.col("line")))
    read = read.select("*", "found.text", "found.digest", "found.is_message", "found.verified").drop("found")
    if place != ["ordinal"]:
        read = numbered_lines(materialize(read, "read"), FILE)
    records = materialize(read.where("is_record").drop("is_record"), "parsed")
    r, spans = records.drop("named").withColumn("block", id_chunk("ordinal", LINE_BLOCK)).alias("r"), session_intervals(records).alias("s")
    same = [F.col(f"r.{c}") == F.col(f"s.{c}") for c in (*FILE, "block")]
    named = r.join(spans, reduce(and_, same) & F.col("r.ordinal").between(F.col("s.low"), F.col("s.high")), "left")
    return named.select("r.*", F.coalesce(F.nullif("s.named", F.lit("")), file_session_id("r.path")).alias("session_id")).drop("block")


class SessionTables:
    """Deduplicated parts of the session logs: messages, tool evidence and lifecycle events. `pos` orders the rows of a session.

    Of rows with the same id in a session the first one wins. With `store` the parsed records and every part in use are
    written to the shared folder, for jobs that read them many times.
    """

    def __init__(self, records: DataFrame, *, store: bool = False):
        self._keep = (lambda df, name: materialize(df, name)) if store else (lambda df, name: df)
        self.records = self._keep(records, "records")

    @cached_property
    def _items(self) -> DataFrame:
        ident = F.coalesce(F.nullif("item_id", F.lit("")), F.concat_ws(":", F.col("ordinal").cast("string"), F.coalesce("payload_type", F.lit(""))))
        items = self.records.where("type = 'response_item'").select(
            *KEYS, F.struct(*POSITION).alias("pos"), "path", "ts", "turn_id", ident.alias("message_id"), "payload_type", "role", "text", "is_message", "verified")
        return top_rows(items, [*KEYS, "message_id"], [F.col("pos")], 1)

    @cached_property
    def messages(self) -> DataFrame:
        return self._keep(self._items.where("is_message").select(*KEYS, "pos", "path", "role", "text", "ts", "turn_id", "message_id"), "messages")

    @cached_property
    def _happened(self) -> DataFrame:
        kind = F.coalesce("payload_type", F.lit(""))
        return self.records.where("type = 'event_msg'").select(
            *KEYS, F.struct(*POSITION).alias("pos"), "path", "ts", "event_turn", kind.alias("event_type"), F.concat_ws(":", kind, "event_turn", "digest").alias("event_key"), "text", "verified")

    @cached_property
    def events(self) -> DataFrame:
        once = top_rows(self._happened.select(*KEYS, "pos", "event_type", "event_key", "ts"), [*KEYS, "event_key"], [F.col("pos")], 1)
        return self._keep(once, "events")

    @cached_property
    def evidence(self) -> DataFrame:
        columns = [*KEYS, "pos", "path", "text", "ts", "turn_id", "message_id", "verified"]
        outputs = self._items.where("payload_type IN ('custom_tool_call_output', 'function_call_output') AND text <> ''")
        proved = self._happened.where("verified").withColumnsRenamed({"event_turn": "turn_id", "event_key": "message_id"})
        return self._keep(outputs.select(*columns).unionByName(proved.select(*columns)), "evidence")


def session_tables(records: DataFrame, *, store: bool = False) -> SessionTables:
    return SessionTables(records, store=store)


def parse_titles(lines: DataFrame) -> DataFrame:
    """Latest title per session id from an index of JSON lines."""
    v = F.try_parse_json("line")

    def first(*names):
        return F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names])

    rows = lines.select(
        "tenant_id", "path", "ordinal", first("id", "session_id", "thread_id").alias("session_id"), first("thread_name", "title", "name").alias("title")
    ).where("session_id IS NOT NULL AND title IS NOT NULL")
    latest = top_rows(rows, ["tenant_id", "session_id"], [F.desc("path"), F.desc("ordinal")], 1)
    return latest.select("tenant_id", "session_id", T.clean_message("title").alias("title"))


def read_titles(spark: SparkSession, path: str, *, tenant_id: int = 0) -> DataFrame:
    return parse_titles(read_lines(spark, path).withColumn("tenant_id", F.lit(tenant_id).cast("long")))
