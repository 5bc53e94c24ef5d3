"""Connected components of a graph given by its edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written


def components(edges: DataFrame) -> DataFrame:
    """node, label for the end nodes of edges (a, b); label is the same for just the nodes that edges join, and one of them.

    Each round maps every node to the smallest of itself and its neighbours and draws the edges anew between what they map to;
    at least half of the nodes of each component go, so rounds grow with the logarithm of its size. Groupings have map-side
    minima; every round is a written table, so an executor's loss repeats one round at most.
    """
    with scratch(edges.sparkSession) as keep:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        rest = written(both.filter("u <> v").distinct(), "cc-edges")
        maps = []
        while rest.take(1):
            least = written(rest.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "cc-map")
            maps.append(least)
            left = rest.join(least, "u").select(F.col("m").alias("mu"), "v")
            moved = left.join(least.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v")
            rest = written(moved.filter("mu <> mv").select(F.col("mu").alias("u"), F.col("mv").alias("v")).distinct(), "cc-edges")
        if not maps:
            keep(rest)
            return rest.select(F.col("u").alias("node"), F.col("v").alias("label"))
        label = maps[0].select(F.col("u").alias("node"), F.col("m").alias("label"))
        for m in maps[1:]:
            step = m.select(F.col("u").alias("label"), F.col("m").alias("next"))
            label = label.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        label = written(label, "cc-labels")
        keep(label)
        return label
