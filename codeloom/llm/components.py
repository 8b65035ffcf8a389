"""Connected components by alternating large-star and small-star steps.

A step finds the least neighbour of every node by an aggregate that combines where the rows are and joins
it back to the edges (a hub's edges are split by adaptive execution; its aggregate is one row), so no node's
edges gather in one task. Rounds are cut into the shared folder; their number grows with the logarithm
of the number of nodes, not with the diameter.

Defined results: edges with a null end and loops are left out; repeated edges count once; no edges give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(u, v)``; root is the least node of its component."""
    def least(of: DataFrame) -> DataFrame:
        return of.join(of.groupBy("u").agg(F.min("v").alias("m")), "u")

    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        met = least(large)
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        now = cut(small.filter("u <> v").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
