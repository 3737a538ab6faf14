"""Connected components by alternating large-star and small-star."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge other than its component's smallest, which is
    the root. Loops, repeated edges and null ends count for nothing.

    Each step is a minimum per node, pre-aggregated before the shuffle, joined back to the
    edges; a hub's edges are never gathered, and a hub is a skewed join that AQE splits."""
    at = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
               .where("u is not null and v is not null and u > v").distinct(), "edges")
    seen = None
    while True:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # large-star leaves only edges from a node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        at = stage(small, "edges")
        state = at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
