"""Connected components of a link table by least labels and pointer jumping; every round is staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.staging import stage


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs to (node, label): the least node of each component, for every node that has a link.

    Aggregation by node combines on the map side, so that a node with very many links costs one row per task; the
    joins on nodes are plain equi-joins, whose large partitions adaptive execution splits.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = stage(both, "edges")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        lower = stage(lower, "lower")
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = stage(lower.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"), "old"), "labels")
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.drop("old")
        if not changed:
            return labels
