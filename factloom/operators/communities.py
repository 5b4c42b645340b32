"""Communities by parallel Louvain moves, and the power-law fit of degrees.

Louvain as joins: in each round half of the nodes, drawn by a hash, look at the communities of their neighbours and move
to the one with the largest gain of modularity; when no node moves any more, communities become the nodes of a smaller
graph.  A level that does not raise the modularity is not taken, so it never falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _drop, _saved, node_degrees

_EPS = 1e-9


def _strengths(edges: DataFrame, loops: DataFrame) -> DataFrame:
    """(u, k): the weights of a node's edges, both ends of its own loops included."""
    return edges.select("u", "w").unionByName(loops.select("u", "w")).groupBy("u").agg(F.sum("w").alias("k"))


def _moved(edges: DataFrame, k: DataFrame, label: DataFrame, whole: float, turn: int) -> DataFrame:
    """label (u, c) after one round, with `old`: only nodes whose turn it is move."""
    joined = label.join(k, "u")
    total = joined.groupBy("c").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
    towards = edges.join(label.select(F.col("u").alias("v"), "c"), "v").select("u", "c", "w")
    towards = towards.unionByName(label.select("u", "c", F.lit(0.0).alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
    choice = towards.join(total, "c").join(joined.select("u", F.col("c").alias("own"), "k"), "u")
    stays = F.col("c") == F.col("own")
    rest = F.col("total") - F.when(stays, F.col("k")).otherwise(F.lit(0.0))
    choice = choice.withColumn("gain", F.round(F.col("w") - F.col("k") * rest / F.lit(whole), 9))
    best = choice.groupBy("u", "own").agg(F.max_by(F.struct("c", "gain", "size"), F.struct("gain", -F.col("c"))).alias("best"), F.max(F.when(stays, F.col("gain"))).alias("now"), F.max(F.when(stays, F.col("size"))).alias("alone"))
    # two single nodes would change places for ever: the one with the larger number moves
    swap = (F.col("alone") == 1) & (F.col("best.size") == 1) & (F.col("best.c") > F.col("own"))
    goes = (F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(2)) == 0) & (F.col("best.gain") > F.col("now") + _EPS) & ~swap
    return best.select("u", F.when(goes, F.col("best.c")).otherwise(F.col("own")).alias("c"), F.col("own").alias("old"))


def _quality(edges: DataFrame, loops: DataFrame, k: DataFrame, label: DataFrame, whole: float) -> float:
    """The modularity of labels (u, c)."""
    both = edges.join(label, "u").join(label.select(F.col("u").alias("v"), F.col("c").alias("d")), "v").where("c = d").select("w")
    inside = both.unionByName(loops.select("w")).agg(F.sum("w")).first()[0] or 0.0
    square = label.join(k, "u").groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.pow(F.col("t") / whole, F.lit(2)))).first()[0] or 0.0
    return inside / whole - square


def louvain(edges: DataFrame, most_rounds: int = 10, most_levels: int = 8, least: float = 1e-6) -> DataFrame:
    """(name, label) of edges (name_a, name_b, weight); label is the smallest name of the community.

    Loops count for their node; repeated edges add up.  No edge gives no row.
    """
    plain = edges.groupBy("name_a", "name_b").agg(F.sum("weight").cast("double").alias("w"))
    names = _saved(plain.select(F.explode(F.array("name_a", "name_b")).alias("name")).distinct().withColumn("u", F.monotonically_increasing_id()))
    a, b = (names.select(F.col("name").alias(f"name_{s}"), F.col("u").alias(x)) for s, x in (("a", "u"), ("b", "v")))
    numbered = _saved(plain.join(a, "name_a").join(b, "name_b").select("u", "v", "w"))
    e = _saved(numbered.where("u <> v").unionByName(numbered.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
    loops = _saved(numbered.where("u = v").groupBy("u").agg((2 * F.sum("w")).alias("w")))
    _drop(numbered)
    whole = (e.agg(F.sum("w")).first()[0] or 0.0) + (loops.agg(F.sum("w")).first()[0] or 0.0)
    member = names.select("name", F.col("u").alias("c"))
    if not whole:
        return member.select("name", F.col("name").alias("label"))
    best = None
    for level in range(most_levels):
        k = _saved(_strengths(e, loops))
        label = _saved(k.select("u", F.col("u").alias("c")))
        if best is None:
            best = _quality(e, loops, k, label, whole)
        quiet = 0
        for turn in range(most_rounds):
            new = _saved(_moved(e, k, label, whole, turn + 100 * level))
            moved = new.where("c <> old").count()
            _drop(label)
            label = new.select("u", "c")
            label._stored = new._stored
            quiet = 0 if moved else quiet + 1
            if quiet == 2:  # both halves have had their turn
                break
        now = _quality(e, loops, k, label, whole)
        if now < best + least:
            break
        best = now
        member = _saved(member.join(label.select(F.col("u").alias("c"), F.col("c").alias("d")), "c").select("name", F.col("d").alias("c")))
        across = e.join(label, "u").join(label.select(F.col("u").alias("v"), F.col("c").alias("d")), "v").groupBy("c", "d").agg(F.sum("w").alias("w"))
        across = _saved(across)
        own = across.where("c = d").select(F.col("c").alias("u"), "w").unionByName(loops.join(label, "u").select(F.col("c").alias("u"), "w"))
        old = e, loops, k, label
        e, loops = _saved(across.where("c <> d").select(F.col("c").alias("u"), F.col("d").alias("v"), "w")), _saved(own.groupBy("u").agg(F.sum("w").alias("w")))
        _drop(*old, across)
    smallest = member.groupBy("c").agg(F.min("name").alias("label"))
    return member.join(smallest, "c").select("name", "label")


def power_law(edges: DataFrame, least_tail: int = 2) -> DataFrame:
    """One row (n, low, alpha, sigma, distance, taxonomy): a discrete power law fitted to the degrees.

    The lower cut is the degree with the smallest Kolmogorov-Smirnov distance between the tail's degrees and its fit
    (ties: the smaller); alpha = 1 + n / sum ln(d / (low - 1/2)), sigma = (alpha - 1) / sqrt(n), over the n degrees from
    the cut on, of at least least_tail different values.  taxonomy grades sigma.  All null (taxonomy N/A) without two
    different degrees.  A graph of m edges has at most 2 sqrt(m) different degrees, so cuts times degrees are linear in m.
    """
    counts = _saved(node_degrees(edges).groupBy(F.col("degree").cast("double").alias("d")).agg(F.count(F.lit(1)).alias("n")))
    cuts = counts.agg(F.array_sort(F.collect_list("d")).alias("cuts"))  # one row
    tails = counts.crossJoin(F.broadcast(cuts)).select("d", "n", F.explode(F.filter("cuts", lambda c: c <= F.col("d"))).alias("low"))
    fits = tails.groupBy("low").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.ln(F.col("d") / (F.col("low") - 0.5))).alias("logs"), F.count(F.lit(1)).alias("values"))
    fits = fits.where(F.col("values") >= least_tail).withColumn("alpha", 1 + F.col("n") / F.col("logs"))
    above = Window.partitionBy("low").orderBy(F.desc("d"))  # a row a degree value
    seen = tails.select("low", "d", F.col("n").alias("here"), F.sum("n").over(above).alias("from"))
    gap = lambda share, at: F.abs(share / F.col("n") - F.pow(at / (F.col("low") - 0.5), 1 - F.col("alpha")))
    met = seen.join(fits, "low").withColumn("gap", F.greatest(gap(F.col("from"), F.col("d") - 0.5), gap(F.col("from") - F.col("here"), F.col("d") + 0.5)))
    chosen = met.groupBy("low").agg(F.max("gap").alias("distance"), F.first("n").alias("n"), F.first("alpha").alias("alpha")).agg(F.min_by(F.struct("low", "n", "alpha", "distance"), F.struct(F.round("distance", 9), "low")).alias("x"))
    sigma = (F.col("x.alpha") - 1) / F.sqrt("x.n")
    grade = F.when(sigma.isNull(), "N/A")
    # The bounds of the published taxonomy of scale-free evidence.
    for bound, name in ((0.5, "strongest"), (0.8, "strong"), (1.0, "moderate"), (1.3, "weak")):
        grade = grade.when(sigma < bound, name)
    return chosen.select(F.col("x.n").alias("n"), F.col("x.low").alias("low"), F.col("x.alpha").alias("alpha"), sigma.alias("sigma"), F.col("x.distance").alias("distance"), grade.otherwise("super-weak").alias("taxonomy"))
