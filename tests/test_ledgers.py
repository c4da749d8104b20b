"""Proposals, follow-ups, experience and reviews on literal rows."""
from pyspark.sql import functions as F

from tracemill.operators import experience as X
from tracemill.operators import proposals as P
from tracemill.operators import reviews as V
from tracemill.operators import skills as L
from tracemill.plans.retrieval_queries import EXPERIENCE
from tracemill.vocab import REPLY_HEADING


def as_of():
    return F.lit("2024-03-15").cast("timestamp")


PROPS = "tenant_id long, pos long, id string, uid string, legacy_id string, kind string, target string, reason string, status string, created date, resolved date, status_history array<struct<at:timestamp,from_status:string,to_status:string,reason:string>>"


def props(spark, rows):
    return spark.createDataFrame([(1, i, p, f"u{i}", None, k, t, "r", s, None, None, []) for i, (p, k, t, s) in enumerate(rows)], PROPS)


def test_numbering_and_queue(spark):
    have = props(spark, [("P001", "enhance", "a", "done"), ("P003", "enhance", "b", "pending")])
    batch = spark.createDataFrame([(1, i, "enhance", f"t{i}", "r") for i in range(15)] + [(1, 99, "enhance", "b", "r")], "tenant_id long, pos long, kind string, target string, reason string")
    new, refused = P.admit_proposals(have, batch, as_of())
    ids = sorted(r.id for r in new.collect())
    assert ids[0] == "P004" and len(ids) == 12
    assert sorted(r.reason for r in refused.collect()) == ["already_on_ledger", "queue_full", "queue_full", "queue_full"]


def test_identity_repair(spark):
    fixed = {r.pos: (r.id, r.legacy_id) for r in P.repair_identities(props(spark, [("P054", "enhance", "a", "done"), ("P054", "enhance", "b", "done"), ("bad", "enhance", "c", "done")])).collect()}
    assert fixed == {0: ("P054", None), 1: ("P055", "P054"), 2: ("P056", "bad")}


def test_follow_up_results(spark):
    fu = spark.createDataFrame(
        [(1, "P1", "u", "x", "ref_loads:x", "verified", None, None, 1, None), (1, "P2", "u", "y", "ref_loads:y", "verified", None, None, 3, None),
         (1, "P3", "u", "z", "manual_review", "verified", None, None, None, None), (1, "P4", "u", "w", "cluster:timeout", "verified", None, None, 10, None)],
        "tenant_id long, proposal_id string, proposal_uid string, target string, metric string, link_status string, result string, result_detail string, baseline long, recurrence_detected boolean").withColumn("check_after", F.lit("2024-03-15").cast("date"))
    facts = spark.createDataFrame([(1, "x", 9)], "tenant_id long, name string, load_sessions long")
    clusters = spark.createDataFrame([(1, "Tool timeout", "k", 12)], "tenant_id long, title string, cluster_key string, cnt long")
    got = {r.proposal_id: (r.result, r.recurrence_detected) for r in P.check_due(fu, facts, clusters, as_of()).collect()}
    assert got == {"P1": ("worse", None), "P2": ("inconclusive", None), "P3": ("inconclusive", None), "P4": ("inconclusive", True)}


def test_decisions(spark):
    p = props(spark, [("P900", "enhance", "t", "pending"), ("P901", "enhance", "q", "pending"), ("P902", "retire", "user-x", "pending"), ("P903", "enhance", "v", "pending")])
    text = "## queue\n- [x] P900 | enhance | t | r <!-- uid:u0 -->\n- [-] P901 | enhance | q | r <!-- uid:u1 -->\n- [x] P902 | retire | user-x | r <!-- uid:u2 -->\n- [X] P903 | enhance | WRONG | r <!-- uid:u3 -->\n- [ ] P900 | x | y"
    lines = P.decision_lines(spark.createDataFrame([(1, 1, text)], "tenant_id long, doc_id long, text string"))
    valid, stale = P.match_decisions(lines, p)
    after, done, refused = P.apply_decisions(p, valid, as_of())
    assert {r.id: r.status for r in after.collect()} == {"P900": "approved", "P901": "rejected", "P902": "pending", "P903": "pending"}
    assert [r.reason for r in stale.collect()] == ["stale_target"] and [r.reason for r in refused.collect()] == ["protected_skill"] and done.count() == 0


REQUEST = ("pos long, memory_id string, task_family string, scope string, conditions string, recommended_action string, avoid string, evidence_level string, status string, "
           "evidence_refs array<struct<path:string,quote:string>>, expected_revision int, supersedes string, supersedes_revision int")


def request(spark, *rows):
    return spark.createDataFrame(list(rows), REQUEST)


def test_experience_ledger(spark):
    docs = spark.createDataFrame([("d", "User correction: preserve history. And more.")], "path string, text string")
    ref = [("d", "User correction: preserve history.")]
    v = spark.createDataFrame([], EXPERIENCE)
    new, bad = X.remember(v, request(spark, (1, "m", "f", "global", "c", "keep history", "a", "user_explicit", None, ref, None, None, None), (2, "n", "f", "global", "c", "x", "", None, None, ref, None, None, None)), docs, as_of())
    rows = {r.memory_id: (r.revision, r.status) for r in new.collect()}
    assert rows == {"m": (1, "active"), "n": (1, "candidate")} and bad.count() == 0
    v = v.unionByName(new)
    again, bad = X.remember(v, request(spark, (1, "m", "f", "global", "c", "keep history", "a", "user_explicit", None, ref, None, None, None), (2, "n", "f", "global", "c", "other", "", None, None, ref, 7, None, None)), docs, as_of())
    assert again.count() == 0 and [r.reason for r in bad.collect()] == ["stale_revision"]
    heir, bad = X.remember(v, request(spark, (1, "m2", "f", "global", "c", "keep all history", "", "user_explicit", None, ref, None, "m", 1)), docs, as_of())
    assert {(r.memory_id, r.revision, r.status) for r in heir.collect()} == {("m2", 1, "active"), ("m", 2, "superseded")} and bad.count() == 0
    items = X.load_experiences(v).withColumn("chunk", F.lit("x" * 100))
    tasks = spark.createDataFrame([("t1", "keep the history", "", "p")], "task_id string, query string, family string, project string")
    chosen, receipts = X.brief(tasks, items, max_chars=12)
    assert chosen.count() == 0 and receipts.head().retrieved_ids == []
    chosen, receipts = X.brief(tasks, items)
    r = receipts.head()
    assert r.retrieved_ids == ["m"] and r.revisions == {"m": 1}
    said = spark.createDataFrame(
        [(1, "t1", None, "user_accepted", ["m"], ["ran it"], ["preserve history"], ref), (2, "t1", None, "user_accepted", ["m"], ["ran it"], ["preserve history"], ref), (3, "t2", None, "unknown", [], [], [], [])],
        "pos long, task_id string, receipt_id string, outcome_status string, applied_memory_ids array<string>, observed_actions array<string>, user_corrections array<string>, evidence_refs array<struct<path:string,quote:string>>")
    ok, refused = X.record_feedback(receipts, spark.createDataFrame([], "feedback_id string"), said, docs, as_of())
    assert ok.count() == 1 and [x.reason for x in refused.collect()] == ["no_receipt_for_task"]


def test_review_coverage(spark):
    clusters = spark.createDataFrame([(1, f"k{i}", 4) for i in range(10)], "tenant_id long, cluster_key string, cnt long")
    failed = spark.createDataFrame([(1, "s", "high")], "tenant_id long, session_id string, confidence string").withColumn("started_at", as_of())
    fu = spark.createDataFrame([(1, "P1", "t", "cluster:x", "verified", "inconclusive", True)], "tenant_id long, proposal_id string, target string, metric string, link_status string, result string, recurrence_detected boolean").withColumn("check_after", F.to_date(as_of()))
    packet = V.evidence_packet(clusters, failed, fu)
    assert {r.item_id for r in packet.where("required").collect()} == {f"C{i}" for i in range(1, 11)} | {"F1", "W1"}
    text = "## 技能提案\n" + "x" * 100 + ", ".join(f" C{i}" for i in range(1, 11))
    replies = spark.createDataFrame([(1, 1, text), (1, 2, text + " F1 W1")], "tenant_id long, reply_id long, text string")
    assert {r.reply_id: r.verdict for r in V.review_coverage(packet, replies).collect()} == {1: "missing_coverage", 2: "accepted"}


def test_seal_sees_every_change(spark):
    schema = "tenant_id int, a string, b string"
    seals = [V.seal_packet(spark.createDataFrame([(1, *r) for r in rows], schema)).head().packet_id for rows in (
        [("x", None)], [(None, "x")], [("x", "x")], [("x", None), ("x", None)], [("x", None), (None, "x")], [(None, None)])]
    assert len(set(seals)) == len(seals)
    again = V.seal_packet(spark.createDataFrame([(1, None, "x"), (1, "x", None)], schema).repartition(2)).head().packet_id
    assert again == seals[4]


def test_coverage_of_one_tenant_with_most_rows(spark):
    packet = spark.createDataFrame([(1, f"C{k}", k % 2 == 0) for k in range(40)] + [(2, "F1", False)], "tenant_id int, item_id string, required boolean")
    text = REPLY_HEADING + "x" * 100 + " "
    replies = spark.createDataFrame([(1, k, text + " ".join(f"C{j}" for j in range(40) if j != k)) for k in range(40)] + [(2, 1, text), (3, 1, text), (1, 99, "C1")], "tenant_id int, reply_id int, text string")
    got = {(r.tenant_id, r.reply_id): (r.missing, r.verdict) for r in V.review_coverage(packet, replies).collect()}
    assert all(got[1, k] == ((1, "missing_coverage") if k % 2 == 0 else (0, "accepted")) for k in range(40))
    assert got[2, 1] == got[3, 1] == (0, "accepted") and got[1, 99] == (20, "empty_or_invalid_output")


def test_catalog_entries_of_one_name_are_one_record(spark):
    catalog = spark.createDataFrame(
        [(1, "Demo", True, False, False, 10, 5, "measured"), (1, "demo", False, True, True, 20, 90, "measured"), (1, "old", False, True, False, 1, 1, "measured"), (2, "demo", True, False, False, 1, 1, "measured")],
        "tenant_id int, name string, installed boolean, archived boolean, disabled boolean, size_bytes long, age_days int, usage_quality string")
    metrics = spark.createDataFrame([(1, "demo", "demo", 3)], "tenant_id int, skill_key string, skill string, load_sessions long")
    for c in ("load_sessions_30d", "self_errors", "recent_self_errors", "reload_sessions", "last_used_days"):
        metrics = metrics.withColumn(c, F.lit(1).cast("long"))
    facts = L.skill_facts(metrics, catalog)
    got = {(r.tenant_id, r.skill_key): r for r in facts.collect()}
    assert len(got) == facts.count() == 3 and (got[1, "demo"].name, got[1, "demo"].installed, got[1, "demo"].archived, got[1, "demo"].size_bytes) == ("Demo", True, True, 10)
    totals = {r.tenant_id: (r.total_installed, r.used, r.dead, r.broken_ref) for r in L.usage_totals(facts).collect()}
    assert totals == {1: (1, 1, 0, 0), 2: (1, 0, 1, 0)}


def test_two_briefs_of_a_task_have_two_receipts(spark):
    tasks = spark.createDataFrame([("t", "tests first", "", "p")], "task_id string, query string, family string, project string")
    items = spark.createDataFrame([("m", 1, "global", "f", "tests", "run", "none", "chunk")], "memory_id string, revision int, scope string, task_family string, conditions string, recommended_action string, avoid string, chunk string")
    first, second = (X.brief(tasks, items, as_of=F.lit(f"2024-03-1{d}").cast("timestamp"))[1] for d in (1, 2))
    both = first.unionByName(second)
    assert both.select("receipt_id").distinct().count() == 2 and {r.max_chars for r in both.collect()} == {2400}
    said = spark.createDataFrame([(1, "t", None, "unknown", ["m"], ["ran it"], [], [])], "pos long, task_id string, receipt_id string, outcome_status string, applied_memory_ids array<string>, observed_actions array<string>, user_corrections array<string>, evidence_refs array<struct<path:string,quote:string>>")
    ok, refused = X.record_feedback(both.unionByName(second), spark.createDataFrame([], "feedback_id string"), said, spark.createDataFrame([], "path string, text string"), as_of())
    assert refused.isEmpty() and [r.receipt_id for r in ok.collect()] == [second.head().receipt_id]


def test_follow_ups_of_one_old_id(spark):
    old = [("P1", "enhance", f"t{k}", "done") for k in range(60)] + [("P1", "retire", "t0", "done"), ("P2", "enhance", "x", "done")]
    follow = spark.createDataFrame([(1, k, "P1", f"t{k}", "worse") for k in range(60)] + [(1, 100, "P1", None, "worse"), (1, 101, "P2", None, "worse"), (1, 102, "P2", "y", "worse")], "tenant_id long, follow_up_id long, proposal_id string, target string, result string")
    got = {r.follow_up_id: r.link_status for r in P.link_follow_ups(follow, props(spark, old)).collect()}
    assert sorted(k for k, v in got.items() if v == "unresolved") == [0, 100, 102]
    kinds = follow.where("follow_up_id = 0").withColumn("kind", F.lit("retire"))
    assert P.link_follow_ups(kinds, props(spark, old)).head().link_status == "verified"
