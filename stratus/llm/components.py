"""Connected components of a large edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import drop, staged


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the least node.

    Large-star and small-star rounds: each round links every node to the
    least node it sees, a grouped minimum (partially aggregated, so a hub is no
    hot task) joined back to the edges. The driver sees one row of checksums
    a round. Each round is staged, which cuts the lineage.
    """
    current = staged(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    while True:
        size = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(size) == before or size[0] == 0:
            break
        before = tuple(size)
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Every row of ``large`` points down already: v < u.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").union(lowest.select("u", F.col("m").alias("v"))).distinct())
        after = staged(small, label)
        drop(current)
        current = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
