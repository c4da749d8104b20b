"""The group helpers against brute force, with chunks far smaller than a group and with ties."""
import random

from pyspark.sql import functions as F

from tracemill.operators import substrings as B
from tracemill.operators.grouping import id_chunk, nearest_value, number_rows, top_rows


def sample():
    r = random.Random(7)
    # one key holds most rows, many rows share an instant
    return [(0 if i % 3 else r.randrange(4), r.randrange(60), i, r.choice([None, None, f"v{i}"])) for i in range(400)]


def test_nearest_value_both_ways(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "k long, t long, i long, v string")
    for forward in (False, True):
        for inclusive in (False, True):
            got = {r.i: r.near for r in nearest_value(df, ["k"], F.col("t"), id_chunk("t", 7), F.col("v"), "near", tie=F.col("i"), forward=forward, inclusive=inclusive).collect()}
            for k, t, i, _v in rows:
                side = [(tt, ii, vv) for kk, tt, ii, vv in rows if kk == k and vv and ((tt > t if forward else tt < t) or (inclusive and tt == t))]
                want = (min(side)[2] if forward else max(side)[2]) if side else None
                assert got[i] == want, (forward, inclusive, i)


def test_number_rows(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "k long, t long, i long, v string").repartition(5)
    got = {r.i: r.n for r in number_rows(df, ["k"], id_chunk("t", 9), [F.col("t"), F.col("i")], "n").collect()}
    for key in range(4):
        for n, (_t, i) in enumerate(sorted((t, i) for k, t, i, _v in rows if k == key), 1):
            assert got[i] == n


def test_salted_top_rows(spark):
    df = spark.createDataFrame(sample(), "k long, t long, i long, v string")
    plain = sorted(tuple(r) for r in top_rows(df, ["k"], [F.col("t"), F.col("i")], 5).collect())
    assert plain == sorted(tuple(r) for r in top_rows(df, ["k"], [F.col("t"), F.col("i")], 5, salt=F.col("i")).collect())


def test_substring_joins(spark):
    r = random.Random(3)
    texts = [(i, " ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(8))) for i in range(40)]
    needles = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(25)})
    t, n = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(x,) for x in needles], "n string")
    want = {(i, x) for i, text in texts for x in needles if x in text}
    assert {tuple(x) for x in B.needles_in_texts(t, ["id"], F.col("t"), n, "n").collect()} == want
    assert {(x.id, x.n) for x in B.short_text_matches(t, "t", n, "n").collect()} == want
