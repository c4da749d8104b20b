"""The given tables, the shared folder, and models that ship with the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what an operator needs, under names of its own, so that other columns can't clash."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))


def spread_sample(df: DataFrame, key: str, rows: int, *by: str) -> DataFrame:
    """About `rows` rows for each value of `by`, dealt by a hash of `key`, so the same rows at each run. The counts decide the share,
    the values of `by` must be few."""
    counts = {tuple(r[: len(by)]): r["count"] for r in df.groupBy(*by).count().collect()}
    share = F.lit(0.0)
    for values, n in counts.items():
        match = F.lit(True)
        for c, v in zip(by, values, strict=True):
            match = match & F.col(c).eqNullSafe(F.lit(v))
        share = F.when(match, F.lit(min(1.0, rows / n))).otherwise(share)
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share * float(1 << 20))
