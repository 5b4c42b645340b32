"""V8: hierarchical clustering by average cosine distance, cut at a wanted number of clusters.

Rounds of reciprocal nearest neighbours: in each, all pairs of clusters that are nearest to each other merge at once.
Average linkage never makes a merged cluster nearer to a third than both its parts, so this gives the tree that merging
one pair at a time gives.  What is kept per pair of clusters is the sum and number of the distances between their items,
so the work is that of the items' pairs: it is meant for labels, some thousands, not for documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _drop, _saved, components
from .search import pairs_above


def merges(items: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(a, b, height) of every merge of items (id, embedding): a < b are the smallest ids of the parts, height their average distance.

    Ties go to the smaller id.  A vector of norm 0 is at distance 2 from all others; a single item has no merge.
    """
    near = pairs_above(items, -1.0).where("query_id < id")
    pairs = _saved(near.select(F.col("query_id").alias("a"), F.col("id").alias("b"), (1 - F.col("score")).alias("s"), F.lit(1).cast("long").alias("n")))
    done = []
    for _ in range(most_rounds):
        if pairs.isEmpty():
            break
        far = F.round(F.col("s") / F.col("n"), 9)
        ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), far.alias("d")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), far.alias("d")))
        best = ends.groupBy("x").agg(F.min_by("y", F.struct("d", F.least("x", "y"), F.greatest("x", "y"))).alias("y"))
        mutual = best.join(best.toDF("y", "x"), ["x", "y"]).where("x < y")
        met = _saved(pairs.join(mutual.toDF("a", "b"), ["a", "b"]).select("a", "b", (F.col("s") / F.col("n")).alias("height")))
        done.append(met)
        into = met.select(F.col("b").alias("old"), F.col("a").alias("new"))
        left = pairs.join(met, ["a", "b"], "left_anti")
        left = left.join(into.toDF("a", "na"), "a", "left").join(into.toDF("b", "nb"), "b", "left").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "s", "n")
        now = _saved(left.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
        _drop(pairs)
        pairs = now
    out = pairs.select("a", "b", F.lit(0.0).alias("height")).limit(0)
    for met in done:
        out = out.unionByName(met)
    return out


def clusters(items: DataFrame, wanted: int, tree: DataFrame | None = None) -> DataFrame:
    """(id, cluster) of items (id, embedding) in `wanted` clusters (fewer items: one each); cluster is the smallest id in it.

    The tree's lowest merges are taken, as many as lead to that number; tree: merges() of the items, if there already.
    """
    number = items.select("id").distinct().count()
    tree = merges(items) if tree is None else tree
    low = tree.orderBy(F.round("height", 9), "a", "b").limit(max(0, number - max(1, wanted)))
    label = components(low.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return items.select("id").distinct().join(label.toDF("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
