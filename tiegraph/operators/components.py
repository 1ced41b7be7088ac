"""Connected components as a loop of joins: contraction to the smallest neighbour, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiegraph.plans.lineage import materialize


def connected_components(edges: DataFrame, ego: str = "ego", alter: str = "alter") -> DataFrame:
    """(node, component) for every node with a tie; component is the smallest node of the weak component.

    Each round sends every label to the smallest label next to it (and on to its own), renames the ties and drops those
    inside a label, so that the tie list shrinks and the number of rounds is logarithmic. Minima combine before the
    shuffle, and hubs are joined, never gathered in one row. Ties with a missing end are ignored.
    """
    pairs = edges.select(F.col(ego).alias("a"), F.col(alter).alias("b")).where("a is not null and b is not null")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-ties")
    ties, steps = both.where("a <> b"), []
    while not ties.isEmpty():
        parent = materialize(ties.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "cc-parent")
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        step = parent.join(up, "p").select("a", F.col("q").alias("p"))
        steps.append(step)
        left = ties.join(step, "a").select(F.col("p").alias("a"), "b")
        right = left.join(step.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").select("a", F.col("q").alias("b"))
        ties = materialize(right.where("a <> b").distinct(), "cc-ties")
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    for step in steps:
        labels = labels.join(step.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    return materialize(labels, "cc-labels")
