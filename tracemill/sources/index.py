"""The stored session index: full snapshots in folders of their own, cards by date, vectors by model, health rows."""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text as T

SUMMARIES = (
    "tenant_id long, session_id string, date date, updated timestamp, project string, cwd string, source string, status string, title string, "
    "goal array<string>, claims array<string>, verified array<string>, open_items array<string>, decisions array<string>, corrections array<string>, "
    "artifacts array<string>, message_count int, evidence_count int, source_count int, count_quality string"
)
_REQUIRED = ("session_id", "date", "title", "project", "status", "evidence_count", "claims", "verified", "open_items", "decisions", "corrections")


class DamagedIndex(ValueError):
    """The stored index breaks a rule; nothing may be written over it."""


def _snapshots(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """(number, batch) of every finished snapshot, oldest first. A write that did not finish has no _SUCCESS file and does not count."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/snapshots")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = [x.getPath() for x in files.listStatus(path)]
    names = [x.getName() for x in done if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted((int(n), unquote(batch)) for n, _, batch in (name.partition("-") for name in names))


def write_summaries(summaries: DataFrame, base: str, batch: str | None = None) -> bool:
    """Stores a full snapshot in a folder of its own; it counts once Spark has committed it, and earlier ones stay readable.

    `batch` names what was merged into it. A batch that has a finished snapshot is done: nothing is written and False returned. There is
    one writer per index. The number is one more than the newest snapshot's, whatever the batch is called, so nothing written is hidden.
    """
    spark = summaries.sparkSession
    known = _snapshots(spark, base)
    if batch is not None and batch in {b for _, b in known}:
        return False
    number = known[-1][0] + 1 if known else 0
    ordered = summaries.repartitionByRange("date", "updated", "session_id").sortWithinPartitions(F.desc("date"), F.desc("updated"), F.desc("session_id"))
    # A failed write of the same number may have left its folder without _SUCCESS; nobody reads that.
    ordered.write.mode("overwrite").json(f"{base}/snapshots/{number:012d}-{quote(batch if batch is not None else uuid.uuid4().hex, safe='')}")
    return True


def violations(rows: DataFrame) -> DataFrame:
    """Rows of an index that may not be overwritten blindly: a missing field, an empty id or a repeated id."""
    missing = F.lit(False)
    for c in _REQUIRED:
        missing = missing | F.col(c).isNull()
    bad = rows.where(missing | (F.coalesce(F.col("session_id").cast("string"), F.lit("")) == "")).select("session_id", F.lit("missing_field").alias("violation"))
    twice = rows.groupBy("tenant_id", "session_id").agg(F.count("*").alias("n")).where("n > 1").select("session_id", F.lit("duplicate_session").alias("violation"))
    return bad.unionByName(twice)


def check_summaries(rows: DataFrame) -> DataFrame:
    """The rows themselves, or an error when any of them breaks a rule."""
    first = violations(rows).head()
    if first is not None:
        raise DamagedIndex(f"{first.violation}: {first.session_id}")
    return rows


def read_summaries(spark: SparkSession, base: str) -> DataFrame:
    """Newest finished snapshot, checked. A line that does not parse, or a row that breaks a rule, stops the job."""
    known = _snapshots(spark, base)
    if not known:
        return spark.createDataFrame([], SUMMARIES)
    number, batch = known[-1]
    lines = spark.read.text(f"{base}/snapshots/{number:012d}-{quote(batch, safe='')}").where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", SUMMARIES + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    if parsed.where("r IS NULL OR r._broken IS NOT NULL").head() is not None:
        raise DamagedIndex("a line of the index does not parse")
    return check_summaries(parsed.select("r.*").drop("_broken"))


def session_cards(summaries: DataFrame, date: str | None = None) -> DataFrame:
    """One card per session with its path; `date` limits the cards, never the index."""
    rows = summaries if date is None else summaries.where(F.col("date") == F.to_date(F.lit(date)))
    sid = F.col("session_id").cast("string")
    return rows.withColumn("card_path", F.concat(T.card_path(F.col("date"), sid), F.lit(".md")))


def write_cards(summaries: DataFrame, base: str, date: str | None = None) -> None:
    """Cards by date; only the dates written are replaced."""
    session_cards(summaries, date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(base)


def write_vectors(vectors: DataFrame, base: str) -> None:
    """Appends new vectors (`content_hash, embedding, fingerprint`) under their model fingerprint."""
    vectors.select("content_hash", "embedding", "fingerprint").write.mode("append").partitionBy("fingerprint").parquet(base)


def read_vectors(spark: SparkSession, base: str) -> DataFrame:
    schema = "content_hash string, embedding array<float>, fingerprint string"
    try:
        return spark.read.schema(schema).parquet(base)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def vector_health(units: DataFrame, new: DataFrame, warnings: DataFrame, fingerprint: Column) -> DataFrame:
    """One row: units, experience units, newly encoded documents and evidence warnings."""
    u = units.agg(F.count("*").alias("units"), F.count_if(F.col("source_type") == "experience").alias("experiences")).withColumn("_one", F.lit(1))
    n = new.agg(F.count("*").alias("encoded")).withColumn("_one", F.lit(1))
    w = warnings.agg(F.count("*").alias("evidence_warnings")).withColumn("_one", F.lit(1))
    return u.join(n, "_one").join(w, "_one").drop("_one").withColumn("fingerprint", fingerprint)


def write_health(row: DataFrame, base: str) -> None:
    row.coalesce(1).write.mode("append").json(base)

