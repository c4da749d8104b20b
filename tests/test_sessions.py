"""Session logs from files, summaries, merging and the stored index."""
import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import sessions as S
from tracemill.sources import index as I
from tracemill.sources import rollouts as L
from tracemill.session import materialize
from tracemill.sources import tables as B

ONE, TWO = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"


def record(kind, stamp, **payload):
    return json.dumps({"timestamp": stamp, "type": kind, "payload": payload}, ensure_ascii=False)


def message(role, text, ident, stamp="2026-09-01T01:00:00Z"):
    return record("response_item", stamp, type="message", role=role, id=ident, content=[{"type": "input_text", "text": text}])


@pytest.fixture()
def home(tmp_path):
    user = "<environment_context>SECRET_ENV</environment_context><codex_internal_context>INTERNAL_GOAL</codex_internal_context>## My request:\n不对，这个结论错了，请修改 scripts/run.py 文件"
    first = [record("session_meta", "2026-09-01T00:59:00Z", id=ONE, cwd="/work/demo-project/"), message("user", user, "u1"),
             message("assistant", "我先只读检查。接下来会重跑门禁；如果通过就完成最终发布。现在我会改成只使用已安装副本。运行态仿真已通过，并已写入验证卡片。", "a1"),
             record("response_item", "2026-09-01T01:02:00Z", type="function_call_output", call_id="c1", output="PASS: runtime simulation; exit_code: 0")]
    again = [record("session_meta", "2026-09-01T00:59:00Z", id=ONE, cwd="/work/demo-project/"), message("user", user, "u1"), "{broken", record("event_msg", "2026-09-01T01:05:00Z", type="task_complete")]
    second = [message("user", "请继续完成这个任务", "u9"), record("event_msg", "2026-09-01T02:00:00Z", type="turn_aborted")]
    for name, lines in (("archived/rollout-a", first), ("active/x", again), (f"active/rollout-2026-09-01T02-00-00-{TWO}", second)):
        path = tmp_path / f"{name}.jsonl"
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return tmp_path


def build(spark, home):
    t = L.session_tables(L.parse_rollouts(L.read_rollouts(spark, [str(home / "archived"), str(home / "active")])), store=True)
    titles = spark.createDataFrame([], "tenant_id long, session_id string, title string")
    return materialize(S.session_summaries(t, titles))


def test_build(spark, home):
    rows = {r.session_id: r for r in build(spark, home).collect()}
    a, b = rows[ONE], rows[TWO]
    assert (a.message_count, a.project, a.status, a.source_count, a.evidence_count) == (2, "demo-project", "done", 2, 1)
    assert a.verified and "SECRET_ENV" not in str(a) and "INTERNAL_GOAL" not in str(a)
    claims = " ".join(a.claims)
    assert "运行态仿真已通过" in claims and "现在我会改成" not in claims and "最终发布" not in claims
    assert a.corrections and a.artifacts == ["scripts/run.py"] and str(a.date) == "2026-09-01"
    assert (b.status, list(b.verified), b.message_count) == ("blocked", [], 1)


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "f.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        rows = L.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.ordinal, r.line) for r in rows) == [(i, f"line {i}") for i in range(500)]


def test_index_versions_and_merge(spark, home, tmp_path):
    base = str(tmp_path / "index")
    first = build(spark, home)
    assert I.write_summaries(first, base, "b1") and not I.write_summaries(first.limit(0), base, "b1")
    kept = I.read_summaries(spark, base)
    assert sorted(map(str, kept.collect())) == sorted(map(str, first.collect()))
    gone = S.merge_summaries(kept, first.where("false"))
    assert {r.action for r in gone.collect()} == {"missing_source"}
    assert S.index_health(gone, F.lit("2026-09-02").cast("timestamp")).head().retained_missing_source == 2
    tail = first.where(F.col("session_id") == ONE).withColumn("message_count", F.lit(1)).withColumn("updated", F.col("updated") + F.expr("INTERVAL 1 DAY")).withColumn("claims", F.array(F.lit("决定采用独立记忆索引")))
    merged = S.merge_summaries(kept, tail).where(F.col("session_id") == ONE).head()
    assert merged.count_quality == "lower_bound_partial_source" and merged.message_count == 2 and merged.claims[-1] == "决定采用独立记忆索引" and len(merged.claims) > 1
    same = S.merge_summaries(kept, tail.withColumn("updated", F.lit("2026-09-01").cast("timestamp")))
    assert {r.action for r in same.collect()} == {"kept", "missing_source"}


def test_damaged_index_is_refused(spark, tmp_path):
    base = tmp_path / "i"
    folder = base / "snapshots" / "000000000000-x"
    folder.mkdir(parents=True)
    (folder / "_SUCCESS").touch()
    (folder / "a.json").write_text("{broken\n")
    with pytest.raises(I.DamagedIndex):
        I.read_summaries(spark, str(base))


def test_absent_tables_and_notes(spark, tmp_path):
    sessions, messages = B.read_agent_tables(spark, str(tmp_path / "nothing"))
    assert sessions.count() == messages.count() == 0 and "tool_calls" in messages.columns
    for name, body in (("projects/p/2024-01-02-x.md", "# One\nbody"), (".trash/y.md", "# Two"), ("z.md", "\n")):
        f = tmp_path / "vault" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    notes = B.read_notes(spark, str(tmp_path / "vault")).collect()
    assert [(n.path, n.project, n.title, str(n.day)) for n in notes] == [("projects/p/2024-01-02-x.md", "p", "One", "2024-01-02")]


def test_open_items(spark):
    req = spark.createDataFrame([(1, "s", 1, "我已经补上所有脚本，但我不会声称完美：当前还没有真实 launchd 端到端验证")], "tenant_id long, session_id string, pos int, text string")
    none = spark.createDataFrame([], "tenant_id long, session_id string, idx int, text string")
    items = [r.text for r in S.open_items(req, none).collect()]
    assert any("还没有真实 launchd" in i for i in items) and not any(i.startswith("我已经补上") for i in items)
