"""Language ID and quality: held-out accuracy, defined odd cases."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.rows import ODD_TEXTS, arrow, odd_docs
from tracemill.llm import langid, quality
from tracemill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES["op1_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out AND lang IS NOT NULL").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).head()
    assert rows[0] > 0.98 and rows[1] > 200
    assert found.where("score < 0 OR score > 1").isEmpty()
    assert {r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.collect()} == {True}


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(got) == len(ODD_TEXTS)
    for k, text in enumerate(ODD_TEXTS):
        assert got[k].lang_pred == ("en" if text and any(map(str.isalpha, text)) else "und")
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.lang_pred != "und"}
    assert langid.train(docs.limit(0)) is None and langid.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"} and langid.keep_identified(docs, None).count() == len(ODD_TEXTS)
    assert not langid.identify(docs.limit(0), model).collect()


def test_language_machines_separate_points():
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(m, 0.3, (40, 5)) for m in (0, 1, 2)]).astype(np.float32)
    y = np.repeat([0, 1, 2], 40)
    best, sure = langid.Duels(["a", "b", "c"]).fit(x, y).predict(x)
    assert (best == y).mean() > 0.9 and sure.min() >= 0.5 and sure.max() <= 1


def test_trigrams_equal_plain_counting():
    texts = ["Ab  cd, É1x", "", None, "zz"]
    whole = np.vstack(list(langid.features(arrow(texts))))
    fold = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).encode()
    for text, row in zip(texts, whole, strict=True):
        data = fold(text)
        grams = {data[k : k + 3] for k in range(len(data) - 2) if not (data[k + 1] == 32 and 32 in (data[k], data[k + 2]))}
        assert (row > 0).sum() == len(grams) and (not grams or abs(float(row @ row) - 1) < 1e-5)


@needs_data
def test_quality_on_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rated = quality.ratings(labels)
    model = quality.train(docs, rated.where("doc_id % 2 = 0"))
    rows = quality.grade(docs, model).join(rated.where("doc_id % 2 = 1"), "doc_id").collect()
    assert len(rows) > 150 and np.mean([r.kept == (r.grade > 0) for r in rows]) > 0.97
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    by_grade = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in (0, 1, 2)]
    assert by_grade == sorted(by_grade)


def test_toxic_documents_are_caught(spark):
    r = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(r.choice(list("aeinorst"), 4)) for _ in range(n))
    rows, insults = [], ["idiot", "scum", "moron"]
    for k in range(900):
        words, toxic = prose(int(r.integers(60, 200))).split(), k % 4 == 1
        if toxic:
            words[int(r.integers(len(words)))] = insults[k % 3]
        rows.append((k, " ".join(words) if k % 4 else " ".join(w + "###" for w in words), int(k % 4 > 0), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    rated = quality.ratings(docs)
    model = quality.train(docs, rated.where("doc_id < 600"))
    got = quality.grade(docs, model, least_grade=2).join(rated, "doc_id").where("doc_id >= 600").collect()
    share = {g: np.mean([x.kept for x in got if x.grade == g]) for g in (0, 1, 2)}
    assert share[0] == 0 and share[1] < 0.05 and share[2] > 0.98
    assert all(x.tail == x.tail_2 <= x.tail_1 for x in got) and np.mean([x.tail_1 >= 0.5 for x in got if x.grade == 1]) > 0.95
    assert {x.doc_id for x in quality.keep_graded(docs, model, least_grade=2).collect() if x.doc_id >= 600} == {x.doc_id for x in got if x.kept}


@needs_data
def test_query_and_stage_drop_toxic_documents(spark):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = QUERIES["op8_quality_grades"](spark, SF).where("kept").select("doc_id")
    staged = corpus_pipeline.quality_stage(spark, docs, SF).select("doc_id")
    for left in (kept, staged):
        toxic, clean = (left.join(labels.where(f"quality = 1 AND toxic = {t}"), "doc_id").count() for t in (1, 0))
        assert toxic <= 0.35 * labels.where("quality = 1 AND toxic = 1").count() and clean >= 0.98 * labels.where("quality = 1 AND toxic = 0").count()


def test_quality_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (5, 0, 0), (16, 0, None), (8, 1, None), (None, 1, 0), (9, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in quality.ratings(labels).collect()} == {(4, 1), (5, 0), (16, 0), (8, 2), (99, 1)}
    model = quality.train(docs, quality.ratings(labels))
    got = quality.grade(docs, model).collect()
    assert len(got) == len(ODD_TEXTS) and len({(r.expected_grade, r.tail) for r in got if r.doc_id in (12, 13)}) == 1
    assert {r.doc_id for r in quality.keep_graded(docs, model).collect()} == {r.doc_id for r in got if r.kept}
    assert quality.train(docs, quality.ratings(labels.limit(0))) is None and quality.keep_graded(docs, None).count() == len(ODD_TEXTS)
    assert not quality.grade(docs.limit(0), model).collect() and {r.kept for r in quality.grade(docs, None).collect()} == {True}


def test_ordinal_thresholds_ascend_and_fit():
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 4)).astype(np.float32)
    y = np.digitize(x @ [2, -1, 0.5, 0] + r.logistic(size=600) * 0.3, [-1, 0.5, 2])
    model = quality.fit(x, y)
    assert (np.diff(model.thresholds) > 0).all()
    expected = model.grades[0] + model.tails(x) @ np.diff(model.grades)
    assert np.corrcoef(expected, y)[0, 1] > 0.85
    assert len(quality.fit(x, np.zeros(600)).thresholds) == 0
