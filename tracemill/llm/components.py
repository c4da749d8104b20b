"""Connected components of links by repeated hooking and pointer jumping, in narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for each node of (a, b) links; links run both ways. Nulls are not linked.

    Each round every node takes the smallest root among its neighbours, summed up before the shuffle; its old root is hooked to that, and
    roots are followed one step. A round works on links whose ends still differ, and the tables are stored, so lineage stays short.
    Rounds grow with the logarithm of the longest chain.
    """
    edges = materialize(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # The first labels: each node's smallest neighbour or itself.
    first = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").groupBy("node").agg(F.min("other").alias("low"))
    labels = materialize(nodes.join(first, "node").select("node", F.least("node", "low").alias("root")), "labels")
    live = edges
    while True:
        labels = _jumped(labels)
        live_next = materialize(_contracted(live, labels), "edges")
        if live is not edges:
            discard(live)
        live = live_next
        if live.isEmpty():
            discard(live)
            discard(edges)
            return labels
        # Roots that are linked: each takes the smallest root next to it, and their nodes follow.
        hooks = live.select("a", "b").union(live.select("b", "a")).toDF("root", "other").groupBy("root").agg(F.min("other").alias("low")).select("root", F.least("root", "low").alias("low"))
        before = labels
        labels = materialize(before.join(hooks, "root", "left").select("node", F.coalesce("low", "root").alias("root")), "labels")
        discard(before)


def _jumped(labels: DataFrame) -> DataFrame:
    """Follows roots until every root is its own."""
    while True:
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = labels.where("node <> root").join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), (F.col("top") != F.col("root")).alias("changed"))
        after = materialize(moved.union(labels.where("node = root").select("node", "root", F.lit(False))), "labels")
        more = not after.where("changed").isEmpty()
        discard(labels)
        labels = after.select("node", "root")
        if not more:
            return labels


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between different roots, each once."""
    at = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    bt = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    pairs = edges.join(at, "a").join(bt, "b").where("ra <> rb")
    return pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
