"""Exact group-wise helpers that never need one whole group in one task.

A session, tenant or project may hold a large part of all rows. Every helper here therefore works on
(group, chunk) pieces plus one small summary row per piece, and a piece is bounded by the caller's choice of chunk:
a time slice, a block of ids or a block of line numbers. A chunk must never decrease when the order column grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT_BUCKETS = 32


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def time_chunk(ts: str | Column, seconds: int = 600) -> Column:
    """Number of the time slice; one session in one slice is the unit of work of the as-of helpers."""
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def id_chunk(ident: str | Column, rows: int = 4096) -> Column:
    """Block of unique integer ids; holds at most `rows` rows."""
    c = F.col(ident) if isinstance(ident, str) else ident
    return F.floor(c / F.lit(rows)).cast("long")


def nearest_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    chunk: Column,
    value: Column,
    name: str,
    *,
    tie: Column | None = None,
    forward: bool = False,
    inclusive: bool = False,
) -> DataFrame:
    """Adds `name`: the nearest non-null `value` on an earlier (or later) row of the same keys.

    `order` is an integer column and rows of equal order are seen only with `inclusive`. `tie` picks among candidates of equal
    order: the largest looking back, the smallest looking forward. Exact for any chunk: first inside the chunk, then from the
    summaries of the chunks before (after) it.
    """
    sign = -1 if forward else 1
    tie = F.lit(0) if tie is None else tie
    work = df.withColumn("_o", (order * sign).cast("long")).withColumn("_c", (chunk * sign).cast("long"))
    work = work.withColumn(
        "_v", F.when(value.isNotNull(), F.struct(F.col("_o").alias("o"), (tie * sign).alias("t"), value.alias("v")))
    )
    inside = Window.partitionBy(*keys, "_c").orderBy("_o").rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        work.groupBy(*keys, "_c")
        .agg(F.max("_v").alias("_last"))
        .select(*keys, "_c", F.max("_last").over(before).alias("_carry"))
        .where("_carry IS NOT NULL")
    )
    return (
        work.withColumn("_near", F.max("_v").over(inside))
        .join(carry, [*keys, "_c"], "left")
        .withColumn(name, F.coalesce("_near", "_carry")["v"])
        .drop("_o", "_c", "_v", "_near", "_carry")
    )


def number_rows(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Adds `name`: 1-based position inside the keys, ordered by (chunk, order)."""
    work = df.withColumn("_c", chunk)
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        work.groupBy(*keys, "_c").agg(F.count("*").alias("_n"))
        .select(*keys, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_c").orderBy(*order)
    return (
        work.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_c"])
        .withColumn(name, (F.col("_rn") + F.col("_offset")).cast("long"))
        .drop("_c", "_rn", "_offset")
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, *, rank: str | None = None, salt: Column | None = None) -> DataFrame:
    """First `k` rows per key. Spark cuts to `k` before the shuffle; `salt` adds a first cut per (key, salt) where the
    input already sits partitioned by key (after a join) and that early cut would be skipped."""
    if salt is not None:
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALT_BUCKETS)))
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn", "_salt")
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop("_rn")


def ordered_list(value: str | Column, order: str | Column) -> Column:
    """Aggregate: values as an array in order. Only for groups already cut to a fixed size."""
    v = F.col(value) if isinstance(value, str) else value
    o = F.col(order) if isinstance(order, str) else order
    return F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), v.alias("v")))), lambda s: s["v"])
