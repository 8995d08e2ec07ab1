"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is two aggregations with partial sums and two equi-joins, and ends in a
checkpoint in the shared folder.  No vertex list or edge list reaches the driver, only a
count and a checksum.  A hub's edges aren't gathered: hubs go to their edges by broadcast,
and they are fewer than ``FEW`` by their definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A vertex of more than HUB edges, and more than a FEW-th of all, is a hub.
HUB, FEW = 100, 1_000


def _with_least(edges: DataFrame, low: DataFrame, most: int) -> DataFrame:
    """edges (u, v) -> (u, v, m), by low (u, m, n): n edges of u, m their least vertex."""
    hubs = low.where(F.col("n") > most).select("u", F.col("m").alias("of_hub"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    alone = marked.where(F.col("of_hub").isNull()).join(low.where(F.col("n") <= most), "u").select("u", "v", "m")
    return alone.unionByName(marked.where(F.col("of_hub").isNotNull()).select("u", "v", F.col("of_hub").alias("m")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) of longs -> (u, root): one row for each vertex that isn't the
    smallest of its component; a vertex without edges has none.  Loops, repeated and
    reversed edges make no difference."""
    u, v = F.col("u"), F.col("v")
    e = common.checkpointed(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(e)
    for _ in range(rounds):
        if not was[0]:
            break
        most = max(HUB, 2 * was[0] // FEW)
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, low, most).where(v > u).select(v.alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, most).where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        e = common.checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark(e)
        if now == was:
            return e.select("u", v.alias("root"))
        was = now
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    return e.select("u", v.alias("root"))
