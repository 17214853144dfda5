"""Connected components of an edge list by least-label propagation and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the bigint ``edges`` (a, b); the root is the component's least node.

    A round takes the least label of a node's neighbours and then the label of its label, so chains shorten by half
    a round.  Labels are written to the shared folder each round.  A label that very many nodes carry is looked up by
    broadcast, so a giant component makes no hot task.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both)
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(
            F.min("root").alias("least"))
        moved = materialise(labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("old"), F.least("root", "least").alias("root")))
        if moved.where(F.col("old") != F.col("root")).isEmpty():
            return labels
        carried = moved.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        ahead = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
        ahead = materialise(carried.join(ahead, "root").select("root", "next", "n"))
        jumped = lookup(moved.select("node", "root"), ahead, "root", "n", F.col("node"))
        labels = materialise(jumped.select("node", F.least("root", "next").alias("root")))
