"""Readers for agent tables, error lists, notes and the skill catalog. Missing input gives an empty table of the right type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill import vocab as V
from tracemill.functions import keys as K
from tracemill.functions import text as T
from tracemill.sources.json_arrays import read_array_items
from tracemill.sources.rollouts import read_lines

MESSAGES = ("tenant_id long, session_id string, msg_id long, turn_id string, ordinal int, role string, content string, reasoning_content string, "
            "tool_calls string, tool_call_id string, ts timestamp, active int")
SESSIONS = ("tenant_id long, session_id string, source string, title string, parent_session_id string, archived int, started_at timestamp, "
            "message_count int, tool_call_count int")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of the schema in its order; missing ones are null, epoch numbers become timestamps."""
    def column(field):
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        c = F.col(field.name)
        numeric = df.schema[field.name].dataType.typeName() in ("double", "float", "long", "integer", "decimal")
        if field.dataType.typeName() == "timestamp" and numeric:
            return F.timestamp_micros(F.round(c.cast("double") * 1_000_000).cast("long")).alias(field.name)
        return c.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in StructType.fromDDL(schema)])


def read_table(load: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """What `load` returns in the shape of the schema; an absent table is an empty one. `load` may use any source, JDBC too."""
    try:
        return conform(load(), schema)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            return spark.createDataFrame([], schema)
        raise


def read_agent_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) from Parquet under `base`."""
    return (
        read_table(lambda: spark.read.parquet(f"{base}/sessions"), spark, SESSIONS),
        read_table(lambda: spark.read.parquet(f"{base}/messages"), spark, MESSAGES),
    )


ERROR_LIST = ("event_id string, run_id string, key string, what string, source string, job string, category string, message string, ts string, "
              "date string, timestamp string, first_seen string, last_seen string, count string, ordinal long")


def parse_error_lines(lines: DataFrame) -> DataFrame:
    """Error records from JSON lines or from lines of a JSON array; lines that are not an object are skipped."""
    fields = StructType.fromDDL(ERROR_LIST).fieldNames()[:-1]
    text = lines.select("path", F.col("ordinal").cast("long").alias("ordinal"), F.regexp_replace(T.strip("line"), r"^\[|,$|\]$", "").alias("text"))
    # Conditions on the fields stay above a generator, so a line is parsed once and not again for each of them.
    parsed = text.where(F.col("text").rlike(r"^[ \t\r\n]*\{")).select("path", "ordinal", F.explode(F.array(F.try_parse_json("text"))).alias("v")).where("v IS NOT NULL")
    return parsed.select("path", *[F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in fields], "ordinal")


def read_error_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line."""
    return parse_error_lines(read_lines(spark, path))


def read_error_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array per file, of any layout and size."""
    return parse_error_lines(read_array_items(spark, path).withColumnRenamed("item", "line"))


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """Markdown notes under a root with directory, project, title and time of change; system directories and untitled notes dropped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    notes = raw.select(F.replace(path, F.lit(base), F.lit("")).alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("body"))
    hidden = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in V.SKIP_DIRECTORIES) + ")/"
    notes = notes.where(~F.col("path").rlike(hidden)).withColumn("title", T.note_title("body")).where("title <> ''")
    return notes.select(
        "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory"), F.regexp_extract("path", "^projects/([^/]+)/", 1).alias("project"), "title", "body",
        K.date_in(F.regexp_extract("path", r"([^/]*)$", 1)).alias("day"), "modified")


def parse_skill_files(files: DataFrame, disabled: DataFrame, as_of: Column) -> DataFrame:
    """Catalog rows from skill files (`tenant_id, path, body, size_bytes, modified`): the name in the front matter, else the directory.

    Without usage data the quality of usage is `unknown`, never zero.
    """
    named = T.strip(F.regexp_extract(F.substring("body", 1, 2000), r"""(?mdU)^name:\s*["']?([^\n"']+?)["']?\s*$""", 1))
    folder = F.regexp_extract("path", "([^/]+)/[^/]*$", 1)
    archived = F.col("path").rlike(r"(^|/)\.archive/")
    rows = files.select(
        "tenant_id", "path", F.when(named == "", folder).otherwise(named).alias("name"), archived.alias("archived"), (~archived).alias("installed"),
        F.col("size_bytes").cast("long").alias("size_bytes"), K.age_days("modified", as_of).alias("age_days"), F.lit("unknown").alias("usage_quality"))
    off = disabled.select("tenant_id", "name").distinct().withColumn("disabled", F.lit(True))
    return rows.join(off, ["tenant_id", "name"], "left").withColumn("disabled", F.coalesce("disabled", F.lit(False)))


def read_skill_catalog(spark: SparkSession, root: str, as_of: Column, *, tenant_id: int = 0, disabled: DataFrame | None = None) -> DataFrame:
    def files(path: str) -> DataFrame:
        raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "SKILL.md").text(path, wholetext=True)
        return raw.select(
            F.lit(tenant_id).cast("long").alias("tenant_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"),
            F.col("_metadata.file_size").alias("size_bytes"), F.col("_metadata.file_modification_time").alias("modified"))

    found = files(root)
    try:  # Spark lists no hidden directory that isn't named
        found = found.unionByName(files(f"{root}/.archive"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    off = spark.createDataFrame([], "tenant_id long, name string") if disabled is None else disabled
    return parse_skill_files(found, off, as_of)
