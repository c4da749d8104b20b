"""Streams in order of event time against their batch twins, with rows out of order over micro-batches and restarts."""
import datetime as dt
import random

from pyspark.sql import functions as F

from tracemill.streaming import ordered as O
from tracemill.streaming import triggers as G

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "session_id long, channel string, event_id long, ts timestamp, used long"


def shuffled(seed, n=120):
    """Rows by time, and the same dealt to micro-batches so that each is late by less than an hour."""
    r = random.Random(seed)
    rows, at = [], T0
    for k in range(n):
        at += dt.timedelta(seconds=r.choice([0, 30, 400, 2500]))
        rows.append((k % 3, f"c{k % 2}", k, at, r.choice([100, 1600, 1900])))
    late = sorted(rows, key=lambda x: x[3] + dt.timedelta(seconds=r.randrange(3000)))
    end = (9, "end", 10_000, at + dt.timedelta(days=2), 0)  # moves the watermark past all others
    cuts = [0, n // 4, n // 2, n // 2 + 5, n]
    return rows, [late[a:b] for a, b in zip(cuts, cuts[1:])] + [[end], [(9, "end", 10_001, at + dt.timedelta(days=2), 0)]], end


def drained(spark, tmp_path, batches, make):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for rows in batches:  # the query starts anew for each batch, from its checkpoint
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        make(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_triggers_in_order(spark, tmp_path):
    rows, batches, _ = shuffled(1)
    got = drained(spark, tmp_path, batches, O.ordered_triggers)
    want = G.snapshot_triggers_batch(spark.createDataFrame(rows, SCHEMA))
    key = lambda df: {(r.session_id, r.event_id, r.ts, r.turn, r.trigger) for r in df.where("session_id < 9").collect()}
    assert key(got) == key(want)


def test_level_changes_in_order(spark, tmp_path):
    rows, batches, _ = shuffled(2)
    got = drained(spark, tmp_path, batches, O.level_changes)
    want = G.level_changes_batch(spark.createDataFrame(rows, SCHEMA))
    key = lambda df: {(r.session_id, r.event_id, r.ts, r.used, r.level) for r in df.where("session_id < 9").collect()}
    assert key(got) == key(want) and key(want)


def test_silences_in_order(spark, tmp_path):
    rows, batches, end = shuffled(3)
    got = drained(spark, tmp_path, batches, lambda s: O.silences(s, limit=1500))
    want = O.silences_batch(spark.createDataFrame(rows, SCHEMA), limit=1500, until=F.lit(end[3]))
    key = lambda df: sorted((r.channel, r.ts, r.state) for r in df.where("channel <> 'end'").collect())
    assert key(got) == key(want)
    assert {x[2] for x in key(want)} == {"stale", "recovered"} and sum(x[2] == "stale" for x in key(want)) == sum(x[2] == "recovered" for x in key(want)) + 2
