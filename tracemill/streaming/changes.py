"""Incremental ingest: a micro-batch stores the sessions it summarized and nothing else; the index is what these changes add up to.

A batch writes one partition (epoch, batch) of the change table and replaces it if it runs again, so a replay, a restart or a crash between write
and commit leaves one copy. Reading folds the changes of each session in order, by the rule of `merge_summaries`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.operators.sessions import KEYS, MERGED_LISTS
from tracemill.sources.index import SUMMARIES

CHANGES = SUMMARIES + ", epoch int, batch long"
_COUNTS = ("message_count", "evidence_count", "source_count")


def write_changes(summaries: DataFrame, base: str, epoch: int, batch_id: int) -> None:
    """Stores the summaries of one batch (one row a session) as its partition. `epoch` counts the checkpoints of the stream, as a new one numbers
    its batches from 0 again."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SUMMARIES)]
    rows = summaries.select(*columns, F.lit(epoch).alias("epoch"), F.lit(batch_id).cast("long").alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "batch").parquet(base)


def ingest_changes(base: str, epoch: int, summarize: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function that stores what `summarize` makes of each batch."""
    return lambda batch, batch_id: write_changes(summarize(batch), base, epoch, batch_id)


def read_changes(spark: SparkSession, base: str) -> DataFrame:
    """All stored changes; none before the first write."""
    try:
        return spark.read.schema(CHANGES).parquet(base)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], CHANGES)
        raise


def fold_changes(changes: DataFrame) -> DataFrame:
    """One summary per session: its changes merged in order of epoch and batch, as `merge_summaries` merges one after the other. A session has as
    many changes as batches in which it was summarized."""
    fields = [f.name for f in StructType.fromDDL(SUMMARIES) if f.name not in KEYS]
    oldest = F.lit("0001-01-01").cast("timestamp")

    def merged(a: Column, b: Column) -> Column:
        shorter = b["message_count"] < a["message_count"]
        ua, ub = F.coalesce(a["updated"], oldest), F.coalesce(b["updated"], oldest)
        kept = F.coalesce((ub < ua) | (shorter & (ub <= ua)), F.lit(False))
        appended = F.coalesce(shorter, F.lit(False))

        def pick(c: str) -> Column:
            longer = b[c]
            if c in MERGED_LISTS:
                longer = F.array_distinct(F.concat(a[c], b[c]))
            elif c in _COUNTS:
                longer = F.greatest(a[c], b[c])
            elif c == "count_quality":
                longer = F.lit("lower_bound_partial_source")
            return F.when(kept, a[c]).when(appended, longer).otherwise(b[c]).alias(c)

        return F.struct(*map(pick, fields))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("epoch", "batch", F.struct(*fields).alias("row")))), lambda x: x["row"])
    rows = changes.groupBy(*KEYS).agg(ordered.alias("rows"))
    out = F.aggregate(F.slice("rows", 2, F.size("rows")), F.element_at("rows", 1), merged)
    return rows.withColumn("row", out).select(*KEYS, "row.*")


def read_index(spark: SparkSession, base: str) -> DataFrame:
    """The session index that the stored changes add up to."""
    return fold_changes(read_changes(spark, base))
