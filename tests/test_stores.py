"""Stored cards, vectors and health rows, texts of briefs, and files and turns of sessions."""
import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill import vocab as V
from tracemill.operators import experience as X
from tracemill.operators import sessions as S
from tracemill.sources import index as I

T0 = dt.datetime(2024, 1, 1)


def rows_of(spark, *rows):
    base = dict(tenant_id=1, date=dt.date(2024, 1, 1), updated=T0, title="t", project="p", status="done", evidence_count=1, message_count=2, count_quality="exact")
    lists = dict.fromkeys(("goal", "claims", "verified", "open_items", "decisions", "corrections", "artifacts"), ["x"])
    schema = T.StructType.fromDDL(I.SUMMARIES)
    return spark.createDataFrame([tuple((base | lists | r).get(f.name) for f in schema.fields) for r in rows], schema)


def test_cards_replace_only_their_dates(spark, tmp_path):
    base = str(tmp_path / "cards")
    rows = rows_of(spark, dict(session_id="a"), dict(session_id="b/../c", date=dt.date(2024, 1, 2)))
    I.write_cards(rows, base)
    I.write_cards(rows.withColumn("title", F.lit("new")), base, date="2024-01-02")
    cards = {r.session_id: (r.title, r.card_path) for r in spark.read.parquet(base).collect()}
    assert cards["a"][0] == "t" and cards["b/../c"][0] == "new"
    assert cards["a"][1] == "sessions/2024-01-01/a/memory.md" and "/../" not in cards["b/../c"][1]


def test_vectors_are_kept_by_model(spark, tmp_path):
    base = str(tmp_path / "vectors")
    assert I.read_vectors(spark, base).isEmpty()
    schema = "content_hash string, embedding array<float>, fingerprint string"
    I.write_vectors(spark.createDataFrame([("h1", [1.0, 2.0], "m1")], schema), base)
    I.write_vectors(spark.createDataFrame([("h2", [3.0], "m2")], schema), base)
    assert {(r.content_hash, tuple(r.embedding), r.fingerprint) for r in I.read_vectors(spark, base).collect()} == {("h1", (1.0, 2.0), "m1"), ("h2", (3.0,), "m2")}
    units = spark.createDataFrame([("experience",), ("session",), ("session",)], "source_type string")
    health = I.vector_health(units, spark.range(2), spark.range(1), F.lit("m1")).head()
    assert (health.units, health.experiences, health.encoded, health.evidence_warnings, health.fingerprint) == (3, 1, 2, 1, "m1")


def test_health_rows_are_added(spark, tmp_path):
    merged = S.merge_summaries(rows_of(spark, dict(session_id="a"), dict(session_id="gone")), rows_of(spark, dict(session_id="a", updated=T0 - dt.timedelta(days=1))))
    for _ in range(2):
        I.write_health(S.index_health(merged, F.lit("2024-01-05").cast("timestamp")), str(tmp_path / "health"))
    got = spark.read.json(str(tmp_path / "health")).collect()
    assert [(r.indexed_sessions, r.source_sessions, r.retained_missing_source, r.retained_partial_source) for r in got] == [(2, 1, 1, 1)] * 2


def test_brief_text(spark):
    experience = spark.createDataFrame([("m1", 2, "build", "demo", "when red", "rerun", "guessing", "verified", [("log.md", "exit 0")])], "memory_id string, revision int, task_family string, scope string, conditions string, recommended_action string, avoid string, evidence_level string, evidence_refs array<struct<path:string,quote:string>>")
    counts = ", ".join(f"{o} long" for o in V.OUTCOMES)
    seen = spark.createDataFrame([("m1", 1, 9, *[9] * len(V.OUTCOMES), ["old"])], f"memory_id string, revision int, applied_tasks long, {counts}, recent_corrections array<string>")
    text = X.brief_chunks(experience, seen).head().chunk
    assert text.startswith("[m1 r2] build / demo\nConditions: when red\nDo: rerun\nAvoid: guessing\nEvidence (verified): log.md :: exit 0\n") and "0 tasks" in text and text.endswith("none recorded")
    used = seen.withColumn("revision", F.lit(2)).withColumn("applied_tasks", F.lit(3).cast("long"))
    assert "3 tasks" in X.brief_chunks(experience, used).head().chunk and X.brief_chunks(experience, used).head().chunk.endswith("old")


def test_files_and_turns_of_sessions(spark):
    records = spark.createDataFrame([(1, "s", "a"), (1, "s", "a"), (1, "s", "b")], "tenant_id long, session_id string, path string")
    assert sorted(r.path for r in S.session_files(records).collect()) == ["a", "b"]
    turns = spark.createDataFrame([(1, "s", "t1"), (1, "s", ""), (1, "s", "t1")], "tenant_id long, session_id string, turn_id string")
    assert [r.turn_id for r in S.session_turns(turns, turns.withColumn("turn_id", F.lit("t2"))).orderBy("turn_id").collect()] == ["t1", "t2"]
