"""Connected components of links between ids, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlabel.llm.common import store


def _state(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; a component is named by its smallest node.

    Alternates large-star and small-star steps: in the first, each node hands its larger neighbours its smallest
    neighbour; in the second, its smaller ones. Both keep the components and end in stars around the smallest nodes,
    after a number of rounds that grows with the logarithm of the longest path. Each round is grouped minima and a join
    per step, written to the shared folder; a node with very many links is split by skew join. Loops and nulls are
    ignored, repeated links count once.
    """
    u, v = F.col(a), F.col(b)
    edges = links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = store(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store(small.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "links")
        new = _state(edges)
        if new == state:
            break
        state = new
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
