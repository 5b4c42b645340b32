"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node sends its larger (large) or its other (small) neighbours to the smallest node around it.

    edges: (u, v) with u > v.  Every node's minimum is one aggregate, so no neighbour list is ever gathered.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        met = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = met.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node that can be reached.  Loops and repeats are ignored."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    before = None
    for _ in range(most_rounds):
        last, now = now, cut(_star(_star(now, True), False))
        release(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._stored = getattr(now, "_stored", None)  # release() of the result deletes its table
    return out
