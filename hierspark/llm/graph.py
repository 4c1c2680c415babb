"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hierspark.llm.util import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): the smallest node that it reaches.

    Alternating large and small stars; the number of rounds grows with the logarithm of the longest path.  Each round
    combines before it shuffles and is written to the shared folder, which cuts the lineage.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = large.where("u != v").distinct()
        low = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u != v").distinct(), "links")
        now = tuple(edges.select(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == state:
            break
        state = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
