"""Connected components by contraction: hook each node to its smallest neighbour, flatten, relabel the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import cut


def _above(parent: DataFrame) -> DataFrame:
    """Parents one step further up, twice as far as before."""
    up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))


def _flatten(parent: DataFrame) -> DataFrame:
    """Parents replaced by the roots above them; each table written reaches four times as far."""
    while True:
        parent = cut(_above(_above(parent)), "parents")
        if parent.where("moved").isEmpty():
            return parent.select("node", "root")


def _relabelled(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The links between different roots."""
    for side in ("a", "b"):
        edges = edges.join(label.select(F.col("node").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(links: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """(node, root) of every node that a link (a, b) or ``label`` names; root is the smallest node reachable, itself included.

    ``label`` is the result for earlier links, which count besides.  Links may repeat and run either way; loops and
    nulls are ignored.  Rounds go on until no link joins two roots.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = cut(edges if label is None else _relabelled(edges, label), "edges")
    while not edges.isEmpty():
        root = _flatten(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        edges = cut(_relabelled(edges, root), "edges")
        tops = root.select("root").distinct().select(F.col("root").alias("node"), "root")
        root = root.unionByName(tops)
        if label is None:
            label = root
        else:
            up = root.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = label.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            label = moved.unionByName(root.join(label.select("node"), "node", "left_anti"))
        label = cut(label, "labels")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if label is None else label
