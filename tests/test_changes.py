"""Incremental ingest: replays, restarts, a crash between write and commit, and the fold against merging one after the other."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.sessions import merge_summaries
from tracemill.sources import index as I
from tracemill.streaming import changes as C

T0 = dt.datetime(2024, 1, 1)
ROW = dict(tenant_id=1, date=dt.date(2024, 1, 1), title="t", project="p", cwd="", source="", status="done", artifacts=[], evidence_count=1, source_count=1, claims=["a"], goal=[], verified=[], open_items=[], decisions=[], corrections=[], message_count=2, count_quality="exact", updated=T0)


def summaries(spark, *rows):
    schema = T.StructType.fromDDL(I.SUMMARIES)
    return spark.createDataFrame([tuple((ROW | r).get(f.name) for f in schema.fields) for r in rows], schema)


def content(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def files(base):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def test_fold_equals_merging_in_turn(spark, tmp_path):
    r, base = random.Random(3), str(tmp_path / "changes")
    index = spark.createDataFrame([], I.SUMMARIES)
    for k in range(7):
        rows = [dict(session_id=s, updated=r.choice([None, T0, T0 + dt.timedelta(days=r.randrange(4))]), message_count=r.randrange(4), claims=[f"c{r.randrange(3)}"], title=f"t{k}") for s in "abcdef" if r.random() < 0.7]
        batch = summaries(spark, *rows)
        C.write_changes(batch, base, k // 4, k % 4)
        merged = merge_summaries(index, batch).drop("action")
        index = spark.createDataFrame(merged.collect(), merged.schema)
        assert content(C.read_index(spark, base).select(index.columns)) == content(index)


def test_batch_writes_only_its_own_partition(spark, tmp_path):
    base = str(tmp_path / "changes")
    assert C.read_index(spark, base).isEmpty()
    ingest = C.ingest_changes(base, 0, lambda b: b)
    ingest(summaries(spark, dict(session_id="a")), 0)
    before = files(base)
    ingest(summaries(spark, dict(session_id="b")), 1)
    ingest(summaries(spark).limit(0), 2)
    after = files(base)
    assert before.items() <= after.items() and all("epoch=0/batch=1" in f for f in after.keys() - before.keys())
    once = content(C.read_index(spark, base))
    ingest(summaries(spark, dict(session_id="b")), 1)  # a replay
    assert content(C.read_index(spark, base)) == once and C.read_changes(spark, base).count() == 2
    C.ingest_changes(base, 1, lambda b: b)(summaries(spark, dict(session_id="a", title="later")), 0)  # a new checkpoint
    assert {(x.session_id, x.title) for x in C.read_index(spark, base).collect()} == {("a", "later"), ("b", "t")}


def test_crash_between_write_and_commit(spark, tmp_path):
    src, base, check = (str(tmp_path / n) for n in ("src", "changes", "check"))
    ingest, crashed = C.ingest_changes(base, 0, lambda b: b), []

    def then_crash(batch, batch_id):
        ingest(batch, batch_id)
        if batch_id == 1 and not crashed:
            crashed.append(batch_id)
            raise RuntimeError("lost before the commit")

    def run():
        spark.readStream.schema(I.SUMMARIES).parquet(src).writeStream.foreachBatch(then_crash).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    summaries(spark, dict(session_id="a")).write.mode("append").parquet(src)
    run()
    summaries(spark, dict(session_id="a", title="new"), dict(session_id="b")).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="lost before the commit"):
        run()
    run()  # the restart runs batch 1 again
    summaries(spark, dict(session_id="c")).write.mode("append").parquet(src)
    run()
    assert crashed == [1] and C.read_changes(spark, base).groupBy("session_id").count().select(F.sum("count")).head()[0] == 4
    assert {(x.session_id, x.title) for x in C.read_index(spark, base).collect()} == {("a", "new"), ("b", "t"), ("c", "t")}
