"""Feedback on briefs, with and without the id of a receipt."""
from pyspark.sql import functions as F

from tracemill.operators import experience as X

BATCH = ("pos long, task_id string, receipt_id string, outcome_status string, applied_memory_ids array<string>, observed_actions array<string>, user_corrections array<string>, "
         "evidence_refs array<struct<path:string,quote:string>>")


def test_only_rows_without_a_receipt_look_for_the_newest(spark):
    receipts = spark.createDataFrame(
        [("t", "r1", ["a"], {"a": 1}, 1), ("t", "r2", ["a", "b"], {"a": 1, "b": 2}, 2), ("u", "r3", ["c"], {"c": 1}, 3)],
        "task_id string, receipt_id string, retrieved_ids array<string>, revisions map<string,int>, created_at int")
    asked = [("t", "r1", ["a"]), ("t", "r1", ["b"]), ("t", None, ["b"]), ("u", None, ["c"]), ("v", None, []), ("u", "r1", []), ("t", "r9", [])]
    batch = spark.createDataFrame([(k, t, r, None, a, ["ran"], [], []) for k, (t, r, a) in enumerate(asked)], BATCH)
    known, docs = spark.createDataFrame([], "feedback_id string"), spark.createDataFrame([], "path string, text string")
    new, refused = X.record_feedback(receipts, known, batch, docs, F.lit("2024-03-15").cast("timestamp"))
    assert {r.pos: (r.receipt_id, r.revisions) for r in new.collect()} == {0: ("r1", {"a": 1}), 2: ("r2", {"b": 2}), 3: ("r3", {"c": 1})}
    assert {r.pos: r.reason for r in refused.collect()} == {1: "applied_not_retrieved", 4: "no_receipt_for_task", 5: "no_receipt_for_task", 6: "no_receipt_for_task"}
    # A task with most of the rows is not one key of a join, if they name their receipts.
    assert "Filter isnull(receipt_id" in refused._jdf.queryExecution().optimizedPlan().toString()
