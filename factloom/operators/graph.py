"""The concept graph, its null model and its measures.

Edges are (name_a, name_b, weight) with name_a < name_b; links are distinct (fact_id, name).
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Weight bands of the confounding table, thresholds of the graph measures, power-law labels.
BANDS = (("1", 1, 1), ("2-4", 2, 4), ("5-9", 5, 9), (">=10", 10, None))
THRESHOLDS = (1, 2, 5, 10)
_made: list[tuple] = []
_own_dirs: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """A new folder's path where all executors share one; deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + _own_dirs.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="factloom-"))
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _saved(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share and read back: lineage of a loop ends here."""
    spark = df.sparkSession
    path = _folder(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored = path
    return back


def _drop(*tables: DataFrame | None) -> None:
    """Delete the folders behind these results of _saved(), which no later plan reads; other tables are left alone."""
    for path in {getattr(df, "_stored", None) for df in tables}:
        for made in [m for m in _made if m[1] == path]:
            _made.remove(made)
            _delete(*made)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        return


@atexit.register
def _delete_saved() -> None:
    for made in _made:
        _delete(*made)


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root) of edges (u, v), root the smallest reachable node: minimum labels spread and jump until they rest."""
    both = edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = _saved(both)
    label = _saved(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    for _ in range(most):
        near = both.join(label.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        spread = label.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = spread.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = _saved(spread.join(jump, "root", "left").select("node", F.coalesce("far", "root").alias("root"), "old"))
        label = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def degrees(links: DataFrame) -> DataFrame:
    """G1: facts per name."""
    return links.select("fact_id", "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("k"))


def null_model(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges with k_a, k_b, expected = k_a k_b / G and z = (w - E) / sqrt(E)."""
    k = degrees(links)
    total = k.agg(F.sum("k").alias("g"))
    named = edges.join(k.select(F.col("name").alias("name_a"), F.col("k").alias("k_a")), "name_a").join(k.select(F.col("name").alias("name_b"), F.col("k").alias("k_b")), "name_b")
    e = named.crossJoin(F.broadcast(total)).withColumn("expected", F.col("k_a") * F.col("k_b") / F.col("g")).drop("g")  # one row
    sigma = F.when(F.col("expected") > 0, F.sqrt("expected")).otherwise(F.lit(1.0))
    return e.withColumn("z", (F.col("weight") - F.col("expected")) / sigma)


def poisson_tail(w: int, mean: float) -> float:
    """P(X >= w) for a Poisson variable, summed in log space on the shorter side."""
    if not math.isfinite(mean) or mean < 0:
        return 1.0
    if w <= 0:
        return 1.0
    if mean == 0:
        return 0.0
    log = math.log(mean)
    if w <= mean:
        return max(0.0, 1.0 - math.fsum(math.exp(i * log - mean - math.lgamma(i + 1)) for i in range(w)))
    terms, i = [], w
    while True:
        t = math.exp(i * log - mean - math.lgamma(i + 1))
        terms.append(t)
        if t < 1e-18 * max(terms[0], 1e-300) or i > w + 10_000:
            return min(1.0, math.fsum(terms))
        i += 1


def significance(model: DataFrame) -> DataFrame:
    """P of each edge under the null model; edges of a batch with one weight and expectation share the sum."""

    @F.pandas_udf("double")
    def tail(w: pd.Series, mean: pd.Series) -> pd.Series:
        which, pairs = pd.factorize(pd.MultiIndex.from_arrays([w, mean]))
        return pd.Series([poisson_tail(int(a), float(b)) for a, b in pairs], dtype="float64").take(which).reset_index(drop=True)

    return model.withColumn("p", tail("weight", "expected"))


def _running(counts: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """(column, _n) with _c, the running sum of _n in order of the column: per range of values, then over the ranges.

    The ranges come from quantiles of the values, so they hold alike many, wherever the values lie.
    """
    counts = _saved(counts)
    cuts = sorted(set(counts.approxQuantile(column, [i / parts for i in range(1, parts)], 0.001)))  # a fixed number of values
    which = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col(column).cast("double")))
    ranged = counts.withColumn("_r", which)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    heads = ranged.groupBy("_r").agg(F.sum("_n").alias("_t")).select("_r", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_own", F.sum("_n").over(Window.partitionBy("_r").orderBy(column)))
    return own.join(heads, "_r").withColumn("_c", F.col("_own") + F.col("_before")).drop("_own", "_before")


def benjamini_hochberg(edges: DataFrame, number: str | None = None) -> DataFrame:
    """Q values; ties of p share the value of the last of them.  number: a column that says how many edges a row stands for.

    p is rounded to 12 digits.  Ranks of distinct p values are running counts and q a running minimum from above, both
    per range of p values; only the ranges' totals meet.
    """
    many = F.lit(1) if number is None else F.col(number)
    counted = _saved(_running(edges.groupBy(F.round("p", 12).alias("_p")).agg(F.sum(many).alias("_n")), "_p"))
    total = counted.agg(F.sum("_n").alias("_all"))
    raw = _saved(counted.crossJoin(F.broadcast(total)).withColumn("_q", F.col("_p") * F.col("_all") / F.col("_c")))
    after = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    low = raw.groupBy("_r").agg(F.min("_q").alias("_m")).select("_r", F.min("_m").over(after).alias("_after"))
    q = F.least(F.min("_q").over(Window.partitionBy("_r").orderBy(F.desc("_p"))), F.coalesce("_after", F.lit(1.0)), F.lit(1.0))
    done = raw.join(low, "_r").select("_p", F.greatest(q, F.lit(0.0)).alias("q"))
    return edges.withColumn("_p", F.round("p", 12)).join(done, "_p").drop("_p")


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks from 1, the mean of the tied."""
    ranked = _running(df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")), column)
    return df.join(ranked.select(column, (F.col("_c") - (F.col("_n") - 1) / 2).alias(out)), column)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row with rho.  df is read once: equal (x, y) count together, and ranks and sums are taken over those."""
    pairs = _saved(df.groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_m")).where("_x is not null and _y is not null"))
    for c in ("_x", "_y"):
        ranked = _running(pairs.groupBy(c).agg(F.sum("_m").alias("_n")), c)
        mine = ranked.select(c, (F.col("_c") - (F.col("_n") - 1) / 2).alias(f"_r{c}"))
        pairs = pairs.join(mine, c)
    pairs = _saved(pairs)
    mean = pairs.agg(*[(F.sum(F.col("_m") * F.col(f"_r{c}")) / F.sum("_m")).alias(f"_a{c}") for c in ("_x", "_y")])
    d = lambda c: F.col(f"_r{c}") - F.col(f"_a{c}")
    met = pairs.crossJoin(F.broadcast(mean))  # one row
    sums = met.agg(F.sum(F.col("_m") * d("_x") * d("_y")).alias("xy"), *[F.sum(F.col("_m") * d(c) * d(c)).alias(c) for c in ("_x", "_y")])
    return sums.select(F.when((F.col("_x") > 0) & (F.col("_y") > 0), F.col("xy") / F.sqrt(F.col("_x")) / F.sqrt(F.col("_y"))).alias("rho"))


def confounded(model: DataFrame) -> DataFrame:
    """Per weight band and over all: edges and those with |z| < 1; empty bands do not show."""
    label = F.coalesce(*[F.when((F.col("weight") >= lo) & (F.lit(True) if hi is None else F.col("weight") <= hi), F.lit(name)) for name, lo, hi in BANDS])
    rows = model.select(F.explode(F.array(label, F.lit("all"))).alias("band"), "z").where("band is not null")
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.abs("z") < 1).alias("confounded"))


def survivors(tested: DataFrame, number: str | None = None) -> DataFrame:
    """One row of counts by p, q and weight; number: how many edges a row stands for."""
    many = F.lit(1) if number is None else F.col(number)
    count = lambda c: F.coalesce(F.sum(F.when(c, many)), F.lit(0)).cast("long")
    return tested.agg(
        count(F.col("p") < 0.05).alias("p_05"), count(F.col("p") < 0.01).alias("p_01"), count(F.col("q") < 0.05).alias("q_05"),
        count(F.col("weight") >= 2).alias("w_2"), count(F.col("weight") >= 5).alias("w_5"), count(F.col("weight") >= 10).alias("w_10"),
    )


def crosstab(tested: DataFrame, promoted: int = 5) -> DataFrame:
    return tested.groupBy((F.col("weight") >= promoted).alias("promoted"), (F.col("q") < 0.05).alias("significant"), (F.abs("z") < 1).alias("confounded")).agg(F.count(F.lit(1)).alias("n"))


def weight_sweep(model: DataFrame, most: int = 20) -> DataFrame:
    """Per W: edges at W or more, confounded ones, and those between two names of degree below 10; ends when none is left."""
    ranges = model.select("weight", "z", "k_a", "k_b", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("weight").cast("int")))).alias("w"))
    return ranges.groupBy("w").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.abs("z") < 1).alias("confounded"), F.count_if((F.col("k_a") < 10) & (F.col("k_b") < 10)).alias("low_degree"))


def recommended_weight(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.coalesce(F.min(F.when(F.col("confounded") == 0, F.col("w"))), F.lit(10)).alias("w"))


def top_edges(edges: DataFrame, n: int = 20) -> DataFrame:
    """G8"""
    return edges.orderBy(F.desc("weight"), "name_a", "name_b").limit(n)


def mid_band(edges: DataFrame, low: int, high: int, n: int = 20) -> DataFrame:
    """Some edges of weight in [low, high), in the order of a hash."""
    some = edges.where((F.col("weight") >= low) & (F.col("weight") < high))
    return some.orderBy(F.md5(F.concat_ws("-", F.col("name_a").cast("string"), F.col("name_b").cast("string"))), "name_a", "name_b").limit(n)


def hubs(links: DataFrame, n: int = 15) -> DataFrame:
    return degrees(links).orderBy(F.desc("k"), "name").limit(n)


def node_degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("name_a", "name_b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def at_threshold(edges: DataFrame, w: int, links: DataFrame) -> DataFrame:
    """Nodes with an edge of that weight, edges, and as isolated the rest of the names in links (name)."""
    kept = edges.where(F.col("weight") >= w)
    nodes = node_degrees(kept).agg(F.count(F.lit(1)).alias("nodes"))
    total = links.agg(F.count_distinct("name").alias("total"))
    both = nodes.crossJoin(kept.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(total)  # one row each
    return both.select(F.lit(w).alias("w"), "nodes", "edges", (F.col("total") - F.col("nodes")).alias("isolated"))


def degree_distribution(edges: DataFrame, low: int = 1) -> DataFrame:
    """Mean, max, median and alpha_mle, the discrete maximum-likelihood exponent (an approximation, not a library's fit)."""
    d = node_degrees(edges)
    return d.agg(
        F.avg("degree").alias("mean"), F.max("degree").alias("max"), F.percentile("degree", 0.5).alias("median"),
        (1 + F.count_if(F.col("degree") >= low) / F.sum(F.when(F.col("degree") >= low, F.ln(F.col("degree") / (low - 0.5))))).alias("alpha_mle"),
    )


def component_sizes(edges: DataFrame) -> DataFrame:
    return components(edges.select(F.col("name_a").alias("u"), F.col("name_b").alias("v"))).groupBy("root").agg(F.count(F.lit(1)).alias("size"))


def communities_lpa(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(name, label) by synchronous weighted label propagation, ties to the smaller label; not Louvain."""
    both = _saved(edges.select("name_a", "name_b", "weight").unionByName(edges.select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), "weight")))
    label = both.select(F.col("name_a").alias("name")).distinct().withColumn("label", F.col("name"))
    for _ in range(rounds):
        votes = both.join(label.select(F.col("name").alias("name_b"), "label"), "name_b").groupBy("name_a", "label").agg(F.sum("weight").alias("v"))
        label = _saved(votes.groupBy(F.col("name_a").alias("name")).agg(F.min_by("label", F.struct(-F.col("v"), F.col("label"))).alias("label")))
    return label


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Weighted modularity of given labels (name, label): one row."""
    a, b = (labels.select(F.col("name").alias(f"name_{s}"), F.col("label").alias(f"l_{s}")) for s in "ab")
    e = edges.join(a, "name_a").join(b, "name_b")
    inside = e.where("l_a = l_b").groupBy(F.col("l_a").alias("label")).agg(F.sum("weight").alias("w_in"))
    ends = e.select("l_a", "weight").withColumnRenamed("l_a", "label").unionByName(e.select("l_b", "weight").withColumnRenamed("l_b", "label"))
    strength = ends.groupBy("label").agg(F.sum("weight").alias("s"))
    m = e.agg(F.sum("weight").alias("m"))
    parts = strength.join(inside, "label", "left").crossJoin(F.broadcast(m))
    return parts.agg(F.sum(F.coalesce("w_in", F.lit(0)) / F.col("m") - F.pow(F.col("s") / (2 * F.col("m")), F.lit(2))).alias("modularity"))


def nmi(labelled: DataFrame, x: str, y: str) -> DataFrame:
    """Normalised mutual information 2 I / (Hx + Hy) of two labels: one row; null with fewer than 10 rows."""
    pair = labelled.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    total = pair.agg(F.sum("n").alias("t"))
    px = pair.groupBy(x).agg(F.sum("n").alias("nx"))
    py = pair.groupBy(y).agg(F.sum("n").alias("ny"))
    info = pair.join(px, x).join(py, y).crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("i"), F.max("t").alias("t"))
    h = lambda d, c: d.crossJoin(F.broadcast(total)).agg(F.sum(-F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t"))).alias(f"h{c}"))
    both = info.crossJoin(h(px, "nx")).crossJoin(h(py, "ny"))
    return both.select(F.when(F.col("t") >= 10, F.coalesce(F.try_divide(2 * F.col("i"), F.col("hnx") + F.col("hny")), F.lit(0.0))).alias("nmi"))


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering of each name, by triangles; edges point from lower to higher degree, so hubs stay small."""
    d = node_degrees(edges)
    ranked = edges.join(d.select(F.col("name").alias("name_a"), F.col("degree").alias("da")), "name_a").join(d.select(F.col("name").alias("name_b"), F.col("degree").alias("db")), "name_b")
    swap = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("name_a") > F.col("name_b")))
    out = ranked.select(F.when(swap, F.col("name_b")).otherwise(F.col("name_a")).alias("s"), F.when(swap, F.col("name_a")).otherwise(F.col("name_b")).alias("t"))
    wedge = out.alias("x").join(out.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.t") < F.col("y.t"))).select(F.col("x.s").alias("c"), F.col("x.t").alias("a"), F.col("y.t").alias("b"))
    closed = wedge.join(edges.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")), ["a", "b"], "left_semi")
    triangles = closed.select(F.explode(F.array("a", "b", "c")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("t"))
    rows = d.join(triangles, "name", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    return rows.select("name", "degree", "t", F.when(F.col("degree") > 1, 2.0 * F.col("t") / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0)).alias("clustering"))


def path_starts(edges: DataFrame, whole: int = 2000, drawn: int = 500) -> DataFrame:
    """The names (name) of the giant component from which paths are measured: all of up to `whole`, else `drawn` of the smallest hashes."""
    label = components(edges.select(F.col("name_a").alias("u"), F.col("name_b").alias("v")))
    giant = label.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").limit(1)
    inside = _saved(label.join(F.broadcast(giant.select("root")), "root").select(F.col("node").alias("name")))
    if inside.count() <= whole:
        return inside
    return inside.orderBy(F.md5(F.col("name").cast("string")), "name").limit(drawn)


def path_lengths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Mean distance from some names (name) to all they reach, and the longest: breadth-first frontiers as joins; one row.

    A neighbour of a frontier lies in it, in the one before or in the next, so only these two are taken off.  Without a
    path both values are null.
    """
    both = _saved(edges.select(F.col("name_a").alias("u"), F.col("name_b").alias("v")).unionByName(edges.select(F.col("name_b").alias("u"), F.col("name_a").alias("v"))))
    last = _saved(starts.select(F.col("name").alias("start"), F.col("name").alias("u")))
    before, step, paths, total = last.limit(0), 0, 0, 0
    while True:
        new = last.join(both, "u").select("start", F.col("v").alias("u")).distinct()
        new = _saved(new.join(last, ["start", "u"], "left_anti").join(before, ["start", "u"], "left_anti"))
        n = new.count()
        if not n:
            break
        step += 1
        paths, total = paths + n, total + n * step
        before, last = last, new
    return edges.sparkSession.createDataFrame([(total / paths, step) if paths else (None, None)], "mean_path double, diameter int")


def small_world(nodes: int, edges: int, mean_clustering: float, mean_path: float) -> float | None:
    """sigma against a random graph of that size, with its analytic clustering k / n and path ln n / ln k."""
    k = 2 * edges / nodes if nodes else 0
    if k <= 1 or not mean_path:
        return None
    return (mean_clustering / (k / nodes)) / (mean_path / (math.log(nodes) / math.log(k)))


def weight_distribution(edges: DataFrame) -> DataFrame:
    """G14"""
    return edges.agg(
        F.min("weight").alias("min"), F.max("weight").alias("max"), F.avg("weight").alias("mean"), F.percentile("weight", 0.5).alias("median"),
        F.avg((F.col("weight") == 1).cast("int")).alias("frac_1"), F.avg((F.col("weight") >= 2).cast("int")).alias("frac_2"), F.avg((F.col("weight") >= 5).cast("int")).alias("frac_5"),
    )


def multi_context(links: DataFrame) -> DataFrame:
    """Names with more than one context."""
    return links.groupBy(F.lower("name").alias("name")).agg(F.count_distinct(F.lower("context")).alias("contexts")).where("contexts > 1")


def source_centrality(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Per source its facts and the mean degree of its names."""
    nodes = node_degrees(edges)
    return links.join(nodes, "name").groupBy("source_id").agg(F.count_distinct("fact_id").alias("facts"), F.avg("degree").alias("mean_degree"))


def centrality_correlations(per_source: DataFrame, least: int = 10) -> DataFrame:
    """(sources, pearson, spearman) of facts and mean degree over the sources; null below `least` sources.  Degrees tie by 9 digits."""
    per_source = _saved(per_source)
    plain = per_source.agg(F.count(F.lit(1)).alias("sources"), F.corr(F.col("facts").cast("double"), F.col("mean_degree")).alias("pearson"))
    ranks = spearman(per_source.select("facts", F.round("mean_degree", 9).alias("mean_degree")), "facts", "mean_degree")
    enough = lambda c: F.when(F.col("sources") >= least, F.col(c))
    return plain.crossJoin(ranks.select(F.col("rho").alias("spearman"))).select("sources", enough("pearson").alias("pearson"), enough("spearman").alias("spearman"))


def fragmentation(concepts: DataFrame, aliases: DataFrame, edges: DataFrame, qualifiers: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of names that may be one: (a, b, reason), a < b, the first reason that holds.

    1 shared_alias: an alias of 8 characters or more is common, and they share a fact or it is one's name.
    2 alias_is_name: a name is the other's alias.  3 prefix: b starts with "a ", a has 4 characters or more, b is at
    most half as long again, the rest is no qualifier, and they share no fact; found by an equi-join on word prefixes.
    """
    named = aliases.join(concepts.select("concept_id", F.lower("name").alias("name")), "concept_id").select("name", F.lower("alias").alias("alias")).distinct()
    names = concepts.select(F.lower("name").alias("name")).distinct()
    shares = edges.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.lit(True).alias("shares"))
    x, y = named.select(F.col("name").alias("a"), "alias"), named.select(F.col("name").alias("b"), "alias")
    common = x.join(y, "alias").where("a < b and length(alias) >= 8").join(shares, ["a", "b"], "left").where("shares or alias = a or alias = b").select("a", "b", F.lit(1).alias("o"), F.lit("shared_alias").alias("reason"))
    own = named.join(names.select(F.col("name").alias("alias")), "alias").where("alias <> name").select(F.least("name", "alias").alias("a"), F.greatest("name", "alias").alias("b"), F.lit(2).alias("o"), F.lit("alias_is_name").alias("reason"))
    words = names.select(F.col("name").alias("b"), F.split("name", " ").alias("w")).where(F.size("w") > 1)
    heads = words.select("b", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", F.lit(1), i), " "))).alias("a"))
    rest = F.substr(F.col("b"), F.length("a") + 2)
    near = heads.join(names.select(F.col("name").alias("a")), "a").where(F.expr("length(a) >= 4 and length(b) <= 1.5 * length(a)"))
    near = (near.where(~rest.isin(*qualifiers)) if qualifiers else near).join(shares.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    near = near.select("a", "b", F.lit(3).alias("o"), F.lit("prefix").alias("reason"))
    both = common.unionByName(own).unionByName(near)
    return both.groupBy("a", "b").agg(F.min_by("reason", "o").alias("reason"))


def mention_rates(links: DataFrame, facts: DataFrame, terms: DataFrame, minimum: int = 20, most: int = 200) -> DataFrame:
    """For the `most` names with more than `minimum` facts, the share of facts whose text has a term of 2 or more characters."""
    top = degrees(links).where(F.col("k") > minimum).orderBy(F.desc("k"), "name").limit(most)
    spelled = terms.where(F.length("term") >= 2).groupBy("name").agg(F.collect_set(F.lower("term")).alias("terms"))
    rows = links.select("fact_id", "name").distinct().join(F.broadcast(top.join(spelled, "name")), "name").join(facts.select("fact_id", F.lower("text").alias("text")), "fact_id")
    hit = F.exists("terms", lambda t: F.contains(F.col("text"), t))
    rates = rows.groupBy("name").agg(F.count(F.lit(1)).alias("facts"), F.avg(hit.cast("int")).alias("rate"))
    return rates.withColumn("suspect", F.col("rate") < 0.5)


def recall_audit(audit: DataFrame) -> DataFrame:
    """Raw and noise-adjusted recall per item (item, matched, total, noise)."""
    return audit.select("item", F.try_divide("matched", "total").alias("raw"), F.try_divide(F.col("matched"), F.col("total") - F.col("noise")).alias("adjusted"))
