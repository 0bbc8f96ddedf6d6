"""Connected components of links between 64-bit numbers, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtally.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); ``root`` is the smallest node of its component.

    Each round hooks every node's neighbours to the smallest node around it,
    first among larger, then among smaller neighbours, until nothing changes:
    the number of rounds grows with the logarithm of the longest chain. Each
    round is stored, so a lost executor never reaches back further than one.
    No links give no rows.
    """
    pairs = links.select("a", "b").where("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # Larger neighbours go to the smallest of all neighbours.
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        # Smaller neighbours, and the node itself, go to the smallest of them.
        own = low.select("a", F.col("low").alias("b"))
        small = large.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = stored(own.unionByName(small).distinct(), "links")
        # Both are sets of (a, b): equal when neither has a row of its own.
        sides = pairs.select("a", "b", F.lit(1).alias("s")).unionByName(after.select("a", "b", F.lit(2).alias("s")))
        same = sides.groupBy("a", "b").agg(F.sum("s").alias("s")).where("s <> 3").isEmpty()
        pairs = after
        if same:
            break
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
