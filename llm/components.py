"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stored, stored_in_turn


def connected(links: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``links`` (a, b): the smallest vertex reached.

    Large-star and small-star steps in turn: every vertex hands its larger neighbours, then
    its smaller ones, to the smallest vertex it knows, until nothing changes. The number
    of rounds grows with the logarithm of the graph; rows never exceed the links, and a
    vertex with many links is summed up before it is shuffled. Each round is stored, so
    lineage stays short; what it took to make the links leaves the disk with the first. Loops
    don't matter; without links there are no vertices.
    """
    edges = stored_in_turn(
        [
            links.where("a <> b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .distinct()
        ]
    )
    seen = None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != seen:
        seen = now
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        roots.select("v", F.col("v").alias("component"))
    )
