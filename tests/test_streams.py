"""Streams against their batch twins: the same rows in many micro-batches, with a restart in between."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.sources import index as I
from tracemill.streaming import alerts as A
from tracemill.streaming import flows as W
from tracemill.streaming import triggers as G

T0 = dt.datetime(2024, 1, 1)



def drain(spark, make, src, schema, out, check, limit=1):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", limit).option("recursiveFileLookup", "true").parquet(src)
    make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def both(spark, tmp_path, df, stream_op):
    """Runs the stream in two starts: half of the input is there at first, the rest comes after a stop."""
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    cut = df.selectExpr("percentile(unix_micros(ts), 0.5)").head()[0]
    first = df.where(F.unix_micros("ts") <= cut)
    first.orderBy("ts", "event_id").coalesce(1).write.mode("append").parquet(src)
    drain(spark, stream_op, src, df.schema, out, check)
    df.where(F.unix_micros("ts") > cut).orderBy("ts", "event_id").coalesce(1).write.mode("append").parquet(src)
    drain(spark, stream_op, src, df.schema, out, check)
    return spark.read.parquet(out)


@pytest.fixture()
def events(spark):
    rows = [(i, f"c{i % 2}", f"m{(i // 7) % 3}", T0 + dt.timedelta(seconds=i * i * 11 % 20000 + i), i % 4 != 0, i % 3) for i in range(200)]
    return spark.createDataFrame(rows, "event_id long, channel string, message string, ts timestamp, delivered boolean, session_id long")


def test_alerts_golden(spark):
    at = lambda s: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, "c", "a", at(10000), False), (2, "c", "a", at(10001), False), (3, "c", "a", at(14000), True), (4, "c", "a", at(20000), True), (5, "c", "b", at(20001), True), (6, "c", None, at(20002), True), (7, "c", "b", at(20003), True)]
    got = A.suppress_alerts_batch(spark.createDataFrame(rows, "event_id long, channel string, message string, ts timestamp, delivered boolean")).orderBy("event_id").collect()
    assert [r.send for r in got] == [True, False, True, False, True, False, True]


def test_alert_stream_equals_batch(spark, events, tmp_path):
    got = both(spark, tmp_path, events, A.suppress_alerts)
    want = A.suppress_alerts_batch(events)
    assert sorted(map(tuple, got.select("event_id", "send").collect())) == sorted(map(tuple, want.select("event_id", "send").collect()))


def test_trigger_stream_equals_batch(spark, events, tmp_path):
    got = both(spark, tmp_path, events, G.snapshot_triggers)
    want = G.snapshot_triggers_batch(events)
    cols = ("event_id", "turn", "trigger")
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_levels(spark):
    rows = [(r.used, r.l) for r in spark.createDataFrame([(1500,), (1501,), (1801,)], "used long").withColumn("l", G.memory_level("used")).collect()]
    assert rows == [(1500, None), (1501, "warn"), (1801, "urgent")]


def test_dedupe_stream_keeps_the_rows_of_the_batch(spark, events, tmp_path):
    keys = ["channel", "message"]
    want = {tuple(r) for r in W.dedupe_events_batch(events, keys).select("event_id", *keys).collect()}
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for part in range(4):  # in the order of time: the stream keeps what comes first
        events.orderBy("ts", "event_id").limit(50 * (part + 1)).subtract(events.orderBy("ts", "event_id").limit(50 * part)).coalesce(1).orderBy("ts", "event_id").write.mode("append").parquet(src)
        drain(spark, lambda s: W.dedupe_events(s, keys, delay="30 days"), src, events.schema, out, check)
    assert {tuple(r) for r in spark.read.parquet(out).select("event_id", *keys).collect()} == want


def test_dedupe_stream_keeps_the_first_to_arrive(spark, events, tmp_path):
    late = events.where("event_id = 3").withColumn("ts", F.expr("ts - INTERVAL 1 DAY")).withColumn("event_id", F.lit(-1).cast("long"))
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for part in (events.where("event_id = 3"), late):
        part.write.mode("append").parquet(src)
        drain(spark, lambda s: W.dedupe_events(s, ["channel", "message"], delay="30 days"), src, events.schema, out, check)
    assert [r.event_id for r in spark.read.parquet(out).collect()] == [3]
    assert [r.event_id for r in W.dedupe_events_batch(events.where("event_id = 3").union(late), ["channel", "message"]).collect()] == [-1]


SUMMARY = dict(tenant_id=1, date=dt.date(2024, 1, 1), title="t", project="p", status="done", evidence_count=1, claims=["a"], verified=[], open_items=[], decisions=[], corrections=[], message_count=2, count_quality="exact")


def summaries(spark, *ids):
    schema = T.StructType.fromDDL(I.SUMMARIES)
    rows = [SUMMARY | {"session_id": i, "updated": T0} for i in ids]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


@pytest.fixture()
def stored(spark, tmp_path):
    base, health = str(tmp_path / "index"), []
    run = lambda stream: W.ingest_batch(lambda: I.read_summaries(spark, base), lambda df, batch: I.write_summaries(df, base, batch), lambda h: health.append(h.head()), lambda b: b, stream)
    return base, health, run


def ids(spark, base):
    return sorted(r.session_id for r in I.read_summaries(spark, base).collect())


def test_replayed_batch_changes_nothing(spark, stored):
    base, health, run = stored
    ingest = run("one")
    ingest(summaries(spark, "a"), 0)
    ingest(summaries(spark, "b"), 1)
    once = sorted(map(str, I.read_summaries(spark, base).collect()))
    ingest(summaries(spark, "b"), 1)
    ingest(summaries(spark, "a"), 0)
    assert sorted(map(str, I.read_summaries(spark, base).collect())) == once and ids(spark, base) == ["a", "b"]
    assert [h.indexed_sessions for h in health] == [1, 2]


def test_new_checkpoint_loses_nothing(spark, stored):
    base, _, run = stored
    run("one")(summaries(spark, "a"), 0)
    run("one")(summaries(spark, "b"), 7)
    run("two")(summaries(spark, "c"), 0)
    assert ids(spark, base) == ["a", "b", "c"]


def test_unfinished_write_is_not_read(spark, stored, tmp_path):
    base, _, run = stored
    run("one")(summaries(spark, "a"), 0)
    broken = tmp_path / "index/snapshots/000000000001-one%3A1"
    broken.mkdir(parents=True)
    (broken / "part-0.json").write_text("{")
    assert ids(spark, base) == ["a"]
    run("one")(summaries(spark, "b"), 1)
    assert ids(spark, base) == ["a", "b"]


def test_stream_into_the_stored_index(spark, stored, tmp_path):
    base, _, run = stored
    src = str(tmp_path / "src")
    for part in ("a", "b"):
        summaries(spark, part).write.mode("append").parquet(src)
        spark.readStream.schema(I.SUMMARIES).parquet(src).writeStream.foreachBatch(run("s")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert ids(spark, base) == ["a", "b"]
    spark.readStream.schema(I.SUMMARIES).parquet(src).writeStream.foreachBatch(run("s2")).option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).start().awaitTermination()
    assert ids(spark, base) == ["a", "b"]
