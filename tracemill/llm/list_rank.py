"""Ranks of the elements of one linked list, whose rows lie anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import discard, materialize

#: A list of at most so many rows is walked by one task.
BASE_ROWS = 16_384


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    following = dict(zip(rows["id"], zip(rows["next"], rows["weight"], strict=True), strict=True))
    here = (set(following) - set(rows["next"].dropna())).pop()
    at, out = 0, []
    while here in following:
        out.append((here, at))
        here, weight = following[here]
        at += weight
    return pd.DataFrame(out, columns=["id", "rank"])


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if parts := list(batches):
        yield _walk(pd.concat(parts))


def ranks(links: DataFrame, base_rows: int = BASE_ROWS) -> DataFrame:
    """id and rank (the weights before it) of each element of a list given as id (string), next (string, null at the end) and weight (long).

    Elements flip coins by a hash of id and round. One with a zero takes in its follower if that has a one: it adds the weight and points past it,
    and the follower remembers who took it and how far behind it lies. A round is one join and leaves about three quarters of the rows, so
    all rounds together move a few times the list. When at most `base_rows` are left, one task walks them; then the rounds are
    undone in turn, each by one join. An empty list gives none.
    """
    live = materialize(links.select("id", "next", F.col("weight").cast("long")), "list")
    rounds: list[DataFrame] = []
    while live.count() > base_rows:
        coin = lambda c: F.pmod(F.xxhash64(F.lit(len(rounds)), F.col(c)), F.lit(2))  # noqa: B023, E731
        takes = (coin("id") == 0) & F.col("next").isNotNull() & (coin("next") == 1)
        takers = live.where(takes).select(F.col("id").alias("taker"), F.col("next").alias("taken"), F.col("weight").alias("skip"))
        met = materialize(live.withColumn("takes", F.coalesce(takes, F.lit(False))).join(takers, F.col("id") == F.col("taken"), "left").drop("taken"), "round")
        rounds.append(met)
        shorter = met.where("NOT takes").select(F.coalesce("taker", "id").alias("id"), "next", (F.col("weight") + F.coalesce("skip", F.lit(0))).alias("weight"))
        before, live = live, materialize(shorter, "list")
        discard(before)
    found = materialize(live.coalesce(1).mapInPandas(_walked, "id string, rank long"), "ranks")
    discard(live)
    while rounds:
        met = rounds.pop()
        taken = met.where("taker IS NOT NULL").select("id", "taker", "skip")
        behind = taken.join(found.select(F.col("id").alias("taker"), "rank"), "taker").select("id", (F.col("rank") + F.col("skip")).alias("rank"))
        before, found = found, materialize(found.unionByName(behind), "ranks")
        discard(before)
        discard(met)
    return found
