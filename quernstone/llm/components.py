"""Connected components of an edge table, as Spark joins; nothing of the graph comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b), label being the smallest node reachable.

    Each step takes the smallest label among the neighbours and then the label of that label, so paths halve.
    Every step's table is written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = written(step, "step")
        of = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = step.join(of, step.label == of["at"]).select("node", F.least("label", "further").alias("label"), "old")
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
