"""Connected components of an undirected graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import settle


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``parent`` to its end by doubling; parents are smaller than their nodes."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = settle(
            parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")),
            "roots",
        )
        again = parents.select(F.col("node").alias("parent"))
        if parents.join(again, "parent", "left_semi").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node that has a link; component is its smallest reachable node.

    ``links`` holds two integer columns ``a`` and ``b``.  Each round hooks every node to
    its smallest neighbour, follows these pointers to their ends and merges; only nodes
    that are the smallest among their neighbours remain, so at least half go each round.
    A hub is combined before the shuffle; no neighbourhood is held by a task.
    """
    links = settle(links.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        parents = _roots(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        if labels is None:
            labels = parents
        else:
            step = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            moved = labels.join(step, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
            labels = settle(moved.unionByName(parents.join(moved.select("node"), "node", "left_anti")), "labels")
        for side in ("a", "b"):
            renamed = parents.select(F.col("node").alias(side), F.col("parent").alias("root"))
            links = links.join(renamed, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        links = settle(links.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    own = labels.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return labels.select("node", F.col("parent").alias("component")).unionByName(
        own.join(labels.select("node"), "node", "left_anti")
    )
