"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebase.llm.common import stash


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Rounds only take minima per node and join them back, so no neighbour list is collected; sizes of adjacency lists
    don't matter, and skewed joins are split by Spark. Every round is written to the shared folder.
    """
    pairs = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # Large star: each larger neighbour of u is tied to the least node of u's neighbourhood.
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        after = stash(small)
        # Stable when every node has one parent and no parent has one.
        row = after.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("d")).first()
        chained = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        pairs = after
        if row["n"] == row["d"] and not chained:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
