"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.tables import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of undirected edges (a, b); the label is
    the smallest node of the component.

    Each round every node takes the smallest label among its neighbours
    and then the label of its label, so paths halve; the rounds end when
    no label changes. Rounds are stored, so lineage stays short.
    """
    both = kept(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
                .filter("a <> b").distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                  .select("node", F.least("node", "m").alias("label")))
    while True:
        # labels of labels
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = labels.join(up, "label").select("node", F.col("label").alias("old"), "higher")
        offered = (both.join(jumped.select(F.col("node").alias("b"), F.col("higher").alias("offer")), "b")
                   .select(F.col("a").alias("node"), "offer"))
        # the root of a node is offered what the node is offered
        hooked = (offered.join(jumped.select("node", F.col("higher").alias("root")), "node")
                  .select(F.col("root").alias("node"), "offer"))
        best = offered.union(hooked).groupBy("node").agg(F.min("offer").alias("offer"))
        step = kept(jumped.join(best, "node")
                    .select("node", "old", F.least("higher", "offer").alias("label")))
        labels = step.select("node", "label")
        if step.filter(F.col("old") != F.col("label")).isEmpty():
            return labels
