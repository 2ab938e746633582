"""Connected components by the smallest label, with pointer jumps, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runoff.llm.common import durable, meet, round_end


def contract(ties: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what ties (u, v) connect, about one for each node.

    Each u has a bounded number of ties. All that it is tied to, and itself, become tied to the smallest of them, so
    ties of many nodes to the same few become equal and are dropped.
    """
    stars = ties.groupBy("u").agg(F.collect_set("v").alias("vs")).select(F.array_append("vs", F.col("u")).alias("all"))
    return stars.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where("u <> v").select("u", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (u, v): label is the smallest node of the component.

    A round takes the smallest label among a node and its neighbours, then that label's own label, so chains shorten
    by more than half and stars end at once. Minima are combined before each shuffle. The middle of a large star and
    the label of a large component are hot keys: `meet` leaves their rows spread.
    """
    both = durable(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = durable(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("degree")).select("node", "degree", F.least("node", "v").alias("label")))
    n_both, n_nodes = both.count(), labels.count()
    while True:
        there = labels.select(F.col("node").alias("v"), "label", "degree")
        near = meet(both, there, "v", "degree", n_both).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        better = round_end(labels.join(near, "node").select("node", "degree", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        held = better.groupBy("label").agg(F.count(F.lit(1)).alias("held"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further")).join(held, "label")
        now = round_end(meet(better, jump, "label", "held", n_nodes).select("node", "degree", "old", F.least("label", "further").alias("label")))
        changed = now.where("old <> label").limit(1).count()
        labels = now.select("node", "degree", "label")
        if not changed:
            return labels.select("node", "label")
