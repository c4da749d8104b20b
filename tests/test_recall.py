"""Recall with bounds against a plain scoring of every session."""
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tracemill import vocab as V
from tracemill.operators import recall as C
from tracemill.operators import retrieval as R
from tracemill.session import held, materialize

FIELDS = [n for n, _ in V.RECALL_WEIGHTS]
SCHEMA = "tenant_id long, session_id string, date date, updated timestamp, status string, project string, title string, " + ", ".join(f"{n} array<string>" for n in FIELDS[2:])
AS_OF = date(2024, 3, 10)


def world(seed, sessions, queries):
    r = random.Random(seed)
    common, rare = ["the", "of", "a", "in", "AND", "is"], [f"word{k}" for k in range(60)]
    say = lambda n: " ".join(r.choice(common if r.random() < 0.6 else rare) for _ in range(n))
    rows = []
    for k in range(sessions):
        day = date(2024, 3, r.randrange(1, 14))
        rows.append((k % 2, f"s{k}", day, datetime(2024, 3, 1, k % 24), r.choice(["done", "blocked", "in_progress"]), r.choice(["alpha", None, "beta the"]), say(3), *[[say(r.randrange(0, 5)) for _ in range(r.randrange(0, 3))] for _ in FIELDS[2:]]))
    asked = [(k % 2, k, r.choice([say(r.randrange(1, 8)), "ord1", "a", "of a", "the the word5", "  ", "nothing-like-it", "a I", "lpha", "xyz the of in is and", None])) for k in range(queries)]
    return rows, asked


def plain(rows, asked, k):
    out = set()
    for tenant, query_id, query in asked:
        q = (query or "").strip().lower()
        scored = []
        for row in rows:
            texts = [(" ".join(v) if isinstance(v, list) else v or "").lower() for v in row[5:]]
            points = sum(4 for w in q.split() if w in " ".join(texts)) if q and row[0] == tenant else 0
            if points:
                points += sum(w for (_, w), t in zip(V.RECALL_WEIGHTS, texts, strict=True) if q in t)
                points += 8 * (row[4] != "done") + max(0, 10 - min((AS_OF - row[2]).days, 10))
                scored.append((points, row[2], row[3], row[1]))
        out |= {(tenant, query_id, s, points, n + 1) for n, (points, _, _, s) in enumerate(sorted(scored, reverse=True)[:k])}
    return out


@pytest.mark.parametrize(("seed", "first_entries"), [(1, 1), (2, 30), (3, 10_000)])
def test_recall_equals_plain_scoring(spark, seed, first_entries):
    rows, asked = world(seed, 80, 40)
    summaries, queries = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "tenant_id long, query_id long, query string")
    got = C.recall(summaries, queries, as_of=F.lit(AS_OF), k=3, first_entries=first_entries)
    assert {(r.tenant_id, r.query_id, r.session_id, r.score, r.position) for r in got.collect()} == plain(rows, asked, 3)


def test_stored_postings_serve_many_questions(spark, tmp_path):
    rows, asked = world(4, 60, 6)
    summaries, queries = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "tenant_id long, query_id long, query string")
    C.store_postings(C.build_postings(summaries), str(tmp_path / "postings"))
    stored = spark.read.parquet(str(tmp_path / "postings"))
    asked.append((0, 99, " ".join(["word7", "the"] * 70)))
    queries = spark.createDataFrame(asked, "tenant_id long, query_id long, query string")
    got = C.recall(summaries, queries, as_of=F.lit(AS_OF), postings=stored)
    assert {(r.tenant_id, r.query_id, r.session_id, r.score, r.position) for r in got.collect()} == plain(rows, asked, 5)
    assert C.recall(summaries.limit(0), queries).isEmpty() and C.recall(summaries, queries.limit(0)).isEmpty()


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_postings_and_texts_are_not_moved(spark, capsys):
    """What a question asks for goes to the postings and texts, also where it is over Spark's own limit for that."""
    rows, asked = world(5, 60, 12)
    summaries, queries = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "tenant_id long, query_id long, query string")
    postings = materialize(C.build_postings(summaries))
    tokens = spark.createDataFrame([(0, 1, 0, "word7")], "tenant_id long, query_id long, pos int, word string")
    hits = spark.createDataFrame([("word7", "word7")], "needle string, word string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C._found(tokens, hits, postings, 1)
        assert "BroadcastHashJoin" in (p := plan(found, capsys)) and "SortMergeJoin" not in p
        assert {r.session_id for r in found.collect()} == {r.session_id for r in postings.where("tenant_id = 0 AND word = 'word7'").collect()}
        best = C.recall(summaries, queries, as_of=F.lit(AS_OF), k=3)
        assert "LeftSemi" in plan(best, capsys)
        assert "LeftSemi" in plan(R.recall_blocks(best, summaries), capsys)
        assert {(r.tenant_id, r.query_id, r.session_id, r.score, r.position) for r in best.collect()} == plain(rows, asked, 3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_few_rows_are_held(spark, capsys):
    many, few = spark.range(100), materialize(spark.range(3).withColumn("n", F.lit(1)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, kind in ((3, "BroadcastHashJoin"), (2, "SortMergeJoin")):
            joined = many.join(held(few, most), "id")
            assert kind in plan(joined, capsys) and joined.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
