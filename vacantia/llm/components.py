"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vacantia.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component), where a component is named by its smallest node.

    Each round gives a node the smallest label among itself and its neighbours and then its label's label, until no label
    changes; the number of rounds grows with the logarithm of the longest path. Aggregates combine before their
    shuffle, so a node with very many links costs one row per task. Each round is a written table.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = labels.join(target, "label").select("node", F.col("further").alias("label"))
        old = labels.select("node", "label", F.col("label").alias("old"))
        none = F.lit(None).cast("long").alias("old")
        offered = old.unionByName(near.select("node", "label", none)).unionByName(jumped.select("node", "label", none))
        # Labels are nodes and name themselves, or the smaller node that a later round finds.
        moved = written(offered.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
