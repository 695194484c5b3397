"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component, for every
    node of ``edges`` (a, b).

    Rounds of large and small stars: every node hands its larger neighbours,
    then its smaller ones, to the smallest node it knows.  A round is two
    aggregates and joins over the edges, written to the shared folder; the
    number of rounds grows with the logarithm of the nodes.  Pairs of a
    neighbour and a minimum are all that moves, never a node's neighbour list.
    """
    now = edges.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    now = written(now, "links")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where(F.col("b") > F.col("a")).join(least, "a").where(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())  # now a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct())
        now = written(small, "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
