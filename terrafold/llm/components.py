"""Connected components of an edge table, wholly as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b); label is the smallest node of its component.

    Each round takes the least label among neighbours and then the label's own label
    (pointer jumping), so the rounds grow with the logarithm of the diameter. Minima are
    combined before the shuffle, so a node with very many neighbours is no hot group.
    Labels are written to the shared folder each round. Empty edges give an empty table;
    a null end drops its edge; loops keep their node.
    """
    edges = edges.where("a is not null and b is not null")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        own = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        after = stored(
            stepped.join(own, stepped.label == own["at"], "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")),
            "labels",
        )
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels
