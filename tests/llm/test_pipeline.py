"""The pipeline on planted documents, and SQL twins of the operators."""
import os
import tracemalloc

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_duplicates import brute
from tests.test_queries import SF, TABLES, normal
from tracemill.llm import langid, neardup, piece_arrays, quality
from tracemill.llm.queries import ORACLES, QUERIES

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, cur.fetchall())


@needs_data
def test_stages_keep_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.columns
        kept[name] = (before, docs)
    before, after = kept["quality"]
    clean, junk, toxic = (labels.where(x).select("doc_id") for x in ("quality = 1 AND toxic = 0", "quality = 0", "quality = 1 AND toxic = 1"))
    assert after.join(clean, "doc_id").count() >= 0.98 * clean.count() and after.join(junk, "doc_id").count() <= 0.05 * junk.count()
    assert after.join(toxic, "doc_id").count() < 0.5 * toxic.count()
    before, after = kept["language"]
    assert after.count() == before.where(F.col("text").rlike(r"\p{L}")).count()
    before, after = kept["near_duplicates"]
    groups = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    left = [r.doc_id for r in after.collect()]
    assert len(left) == len({groups[i][1] for i in left}) == len({v[1] for v in groups.values()})


def test_run_on_planted_rows(spark, tmp_path):
    words = "the of and to in that is was for with as on by at from this".split()
    text = lambda k: " ".join(f"{words[j * j % 16]}{chr(97 + k)}" for j in range(40))
    rows = [(k, text(k), "en", "s", 1) for k in range(12)] + [(20, text(3), "en", "s", 1), (21, None, "en", "s", 1), (22, "123 !!", "en", "s", 1), (23, text(5), None, "s", 1), (24, "", "de", "s", 1), (5, text(5), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted(r.doc_id for r in got)
    assert len(ids) == 12 and {*ids} - {20, 23} <= {*range(12)} and sum(i in (3, 20) for i in ids) == 1 and sum(i in (5, 23) for i in ids) == 1
    assert len({r.sequence_id for r in got}) == 1


def test_row_numbers_stay_when_splits_change(spark, tmp_path, monkeypatch):
    for part in range(4):
        rows = [(10 * part + k, " ".join(f"w{k}-{j}" for j in range(20))) for k in range(10)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    real, setting = corpus_pipeline.neardup.near_duplicates, "spark.sql.files.maxPartitionBytes"

    def and_then_other_splits(*args, **options):
        found = spark.createDataFrame(real(*args, **options).collect(), "doc_id long, n_shingles long, component_id long, kept boolean")
        spark.conf.set(setting, "1")
        return found

    monkeypatch.setattr(corpus_pipeline.neardup, "near_duplicates", and_then_other_splits)
    before = spark.conf.get(setting)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        left = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path)).collect()
    finally:
        spark.conf.set(setting, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len(left) == len({r.text for r in left}) == 10


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert not corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_sequences_hold_the_language_that_was_found(spark, tmp_path):
    words = {"en": "the of and with that from this thing which through".split(), "es": "el los una para pero como cuando donde ella mucho".split()}
    text = lambda lang, k: " ".join(words[lang][(k + j * j) % 10] for j in range(30))
    rows = [(100 * n + k, text(lang, k), None if k >= 20 else lang, "s", 1) for n, lang in enumerate(words) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    assert {r.doc_id: r.lang for r in found.collect()} == {r[0]: ("es" if r[0] >= 100 else "en") for r in rows}
    packed = corpus_pipeline.packing_stage(spark, found, str(tmp_path)).collect()
    held = {s: {r.doc_id >= 100 for r in packed if r.sequence_id == s} for s in {r.sequence_id for r in packed}}
    assert len(packed) == 50 and all(len(langs) == 1 for langs in held.values())


def _peak_mb(work):
    """MB that Python and NumPy take at most while `work` goes through its rows."""
    tracemalloc.start()
    for _ in work:
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


@pytest.mark.parametrize("work", [quality.features, quality.word_sets, langid.features, lambda texts: neardup._sets(texts, 5)])
def test_a_batch_takes_little_memory(work):
    texts = pa.array([" ".join(f"w{(k * 31 + j * j) % 5000}" for j in range(300)) for k in range(2000)])
    assert texts.nbytes > 3e6
    assert _peak_mb(work(texts)) < 32


def test_encoding_takes_little_memory():
    texts = pa.array([" ".join(f"w{k * 1000 + j}" for j in range(1000)) for k in range(1000)])
    assert texts.nbytes > 7e6
    table = piece_arrays.PieceTable(lambda pieces: [b"abcd"] * len(pieces), most=20_000)
    assert _peak_mb(piece_arrays.encoded_rows(texts, table, piece_arrays.blank_cuts)) < 64
