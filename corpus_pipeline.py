"""From raw documents to packed training sequences: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again for the next one. All stages but
the last return the columns of the documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import langid, neardup, packing, quality
from tracemill.llm.tables import table
from tracemill.session import checkpoint_dir, materialize

#: No SQL twin: learned models, MinHash and packing are tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of being good and not toxic (grade 2), learned from the given labels, is under a half. Without
    labels all stay."""
    model = quality.train(docs, quality.ratings(table(spark, sf_dir, "labels")))
    return quality.keep_graded(docs, model, least_grade=quality.CLEAN, least_tail=0.5)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language, those without a text or a letter, and sets `lang` to the language found, by which the last stage packs.
    Without known languages to learn from all stay as they are."""
    return langid.keep_identified(docs, langid.train(docs), lang_col="lang")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (shingles of five words, similarity of 0.8 or more): the first row, in the order
    of the stored table. Repeated rows are duplicates too, whatever their ids; texts without words all stay."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    # Stored, as another job may deal the rows to tasks, and so number them, in another way.
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = neardup.near_duplicates(numbered, width=5, percent=80, id_col=row)
    gone = classes.where("NOT kept").select(F.col("doc_id").alias("_gone"))
    return numbered.join(gone, numbered[row] == gone["_gone"], "left_anti").drop(row)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences of 2048, each of one language."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0, by="lang")


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; the tables between them lie in the shared folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
