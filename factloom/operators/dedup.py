"""Near-duplicate facts by their vectors.

The pass is a fold in a fixed order (stable before new, then id), in which an earlier winner may lose later, so it is
not a plain grouping.  Spark finds each fact's top neighbour; only facts that have one above the threshold take part.
What a fact does at its turn depends on few earlier ones: those whose neighbour it is, those with the same neighbour, and
its neighbour.  So the pass runs in rounds of joins, each of which settles all facts whose earlier ones are settled;
neither a component of near facts nor the facts with one neighbour ever meet in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _drop, _saved, components
from .search import neighbours, pairs_above

THRESHOLD = 0.94
STALE_HOURS = 168


def top_neighbour(vectors: DataFrame, threshold: float = THRESHOLD, repository: str | None = "repository_id") -> DataFrame:
    """(id, hit, score): the closest other fact at or above the threshold, whatever its status; ties by id."""
    found = neighbours(vectors, vectors, 1, threshold, True, repository)
    return found.select(F.col("query_id").alias("id"), F.col("id").alias("hit"), "score")


def fold(rows: pd.DataFrame) -> pd.DataFrame:
    """The sequential pass over (id, status, hit) of one component: gives (id, new_status, winner)."""
    status = dict(zip(rows["id"], rows["status"], strict=True))
    hit_of = {i: h for i, h in zip(rows["id"], rows["hit"], strict=True) if h is not None and h == h}
    winner: dict = {}
    for fact in sorted(status, key=lambda i: (status[i] != "stable", i)):
        if status[fact] != "new" or fact not in hit_of:
            continue
        hit = hit_of[fact]
        if status.get(hit) == "stable":
            status[fact], winner[fact] = "to_delete", hit
        elif status.get(hit) == "new":
            status[hit], winner[hit] = "to_delete", fact

    def last(i):
        while i in winner:
            i = winner[i]
        return i

    out = [(i, "stable" if s == "new" else s, last(i) if i in winner else None) for i, s in status.items()]
    return pd.DataFrame(out, columns=["id", "new_status", "winner"])


def _settled(state: DataFrame) -> DataFrame:
    """state (id, hit, own: is the hit a new fact, alive, acts) after one round; null is not known yet.

    alive: was the fact still there at its turn?  acts: did it then take out its neighbour (own) or give way to it (not own)?
    """
    met = state.where("own").groupBy(F.col("hit").alias("id")).agg(F.min(F.when(F.col("acts"), F.col("id"))).alias("first"), F.min(F.when(F.col("acts").isNull(), F.col("id"))).alias("open"))
    met = _saved(met)
    gives_way = state.where("not own").select(F.col("id").alias("hit"), F.col("alive").alias("left"), F.lit(True).alias("leaves"))
    rows = state.join(met, "id", "left").join(met.toDF("hit", "hit_first", "hit_open"), "hit", "left").join(gives_way, "hit", "left")
    earlier = lambda c: F.coalesce(F.col(c) < F.col("id"), F.lit(False))
    alive = F.coalesce(F.col("alive"), F.when(earlier("first"), False).when(~earlier("open"), True))
    gone_before = F.coalesce(F.col("leaves") & (F.col("hit") < F.col("id")), F.lit(False))  # the neighbour gives way at its own, earlier turn, if it is alive then
    acts = (
        F.when(~F.col("now"), False).when(~F.col("own"), F.col("now")).when(earlier("hit_first"), False).when(gone_before & F.col("left"), False)
        .when(earlier("hit_open") | (gone_before & F.col("left").isNull()), F.lit(None).cast("boolean")).otherwise(F.col("now"))
    )
    return rows.withColumn("now", alive).select("id", "hit", "own", F.col("now").alias("alive"), F.coalesce(F.col("acts"), acts).alias("acts"))


def deduplicate(facts: DataFrame, top: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(id, new_status, winner) of every new or stable fact; `winner` is the last survivor of a loser's chain.

    facts: (id, status); top: (id, hit, score) of top_neighbour().  Facts without a vector or a hit become stable.  The
    result is that of fold() on the whole table; the number of rounds is that of the longest chain of facts with falling
    ids in which each is the neighbour of the next.
    """
    live = _saved(facts.where(F.col("status").isin("new", "stable")).groupBy("id").agg(F.max("status").alias("status")))
    kind = live.schema["id"].dataType.simpleString()
    edges = top.join(live.where("status = 'new'").select("id"), "id", "left_semi").groupBy("id").agg(F.min_by("hit", F.struct(-F.col("score"), "hit")).alias("hit"))
    inside = edges.join(live.select(F.col("id").alias("hit"), (F.col("status") == "new").alias("own")), "hit").where("id <> hit")
    none = F.lit(None).cast("boolean")
    state = _saved(inside.select("id", "hit", "own", none.alias("alive"), none.alias("acts")))
    for _ in range(most_rounds):
        if state.where("acts is null").isEmpty():
            break
        last, state = state, _saved(_settled(state))
        _drop(last)
    else:
        raise RuntimeError("the pass did not settle")
    acted = state.where("acts")
    lost = _saved(acted.select(F.when(F.col("own"), F.col("hit")).otherwise(F.col("id")).alias("id"), F.when(F.col("own"), F.col("id")).otherwise(F.col("hit")).alias("winner")))
    while True:  # a winner that lost later hands on to its own: pointers jump
        jump = lost.select(F.col("id").alias("winner"), F.col("winner").alias("far"))
        new = _saved(lost.join(jump, "winner", "left").select("id", F.coalesce("far", "winner").alias("winner"), F.col("far").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        lost = new.select("id", "winner")
        if not moved:
            break
    out = live.join(lost, "id", "left")
    return out.select("id", F.when(F.col("winner").isNull(), "stable").otherwise("to_delete").alias("new_status"), F.col("winner").cast(kind).alias("winner"))


def stable_sweep(facts: DataFrame, top: DataFrame) -> DataFrame:
    """(id, new_status, winner) of the stable facts after a sweep over them alone, in order of id.

    The smaller id wins of two that are near; a fact whose neighbour is not stable is left to the ordinary pass.
    """
    stable = facts.where("status = 'stable'").select("id", F.lit("new").alias("status"))
    return deduplicate(stable, top)


def merge_sources(fact_sources: DataFrame, verdict: DataFrame, as_of: str) -> DataFrame:
    """A loser's sources go to its winner, with `as_of` as first_seen_at; the winner's own rows stay."""
    lost = verdict.where("winner is not null").select(F.col("id").alias("fact_id"), "winner")
    own = fact_sources.join(lost, "fact_id", "left_anti")
    moved = fact_sources.join(lost, "fact_id").select(F.col("winner").alias("fact_id"), *[F.lit(as_of).cast("timestamp").alias(c) if c == "first_seen_at" else F.col(c) for c in fact_sources.columns if c != "fact_id"])
    new = moved.dropDuplicates(["fact_id", "source_id"]).join(own.select("fact_id", "source_id"), ["fact_id", "source_id"], "left_anti")
    return own.unionByName(new.select(*fact_sources.columns))


def merge_references(references: DataFrame, verdict: DataFrame) -> DataFrame:
    """A loser's citations go to its winner; one for a (source, sentence) the winner cites already goes."""
    lost = verdict.where("winner is not null").select(F.col("id").alias("fact_id"), "winner")
    key = ["fact_id", "source_id", "sentence_index"]
    own = references.join(lost, "fact_id", "left_anti")
    moved = references.join(lost, "fact_id").drop("fact_id").withColumnRenamed("winner", "fact_id").dropDuplicates(key)
    return own.unionByName(moved.join(own.select(*key), key, "left_anti").select(*references.columns))


def merge_links(links: DataFrame, verdict: DataFrame) -> DataFrame:
    lost = verdict.where("winner is not null").select(F.col("id").alias("fact_id"), "winner")
    joined = links.join(lost, "fact_id", "left")
    return joined.withColumn("fact_id", F.coalesce("winner", "fact_id")).drop("winner").dropDuplicates(["fact_id", "concept_id"])


def cleanup(facts: DataFrame, as_of: str, hours: int = STALE_HOURS) -> DataFrame:
    """What is left once to_delete goes, and new facts older than some hours."""
    old = F.col("created_at") < F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return facts.where((F.col("status") != "to_delete") & ~((F.col("status") == "new") & old))


def embed_pass(facts: DataFrame, vectors: DataFrame, model: str, as_of: str) -> DataFrame:
    """New facts that got a vector are marked with the time and the model; without all vectors of a source none is."""
    need = facts.where((F.col("status") == "new") & F.col("embedded_at").isNull())
    missing = need.join(vectors.select("id"), "id", "left_anti").select("source_id").distinct()
    ready = need.join(missing, "source_id", "left_anti").select("id", F.lit(True).alias("ready"))
    joined = facts.join(ready, "id", "left")
    return joined.withColumns({
        "embedded_at": F.when(F.col("ready"), F.lit(as_of).cast("timestamp")).otherwise(F.col("embedded_at")),
        "embedded_model": F.when(F.col("ready"), F.lit(model)).otherwise(F.col("embedded_model")),
    }).drop("ready")


def forest(pairs: pd.DataFrame, cross: pd.Series) -> pd.DataFrame:
    """Of (query_id, id, score) what a sweep needs: a spanning forest of the largest scores, which connects at every
    threshold what all pairs connect, and each fact's best pair that is cross."""
    root: dict = {}

    def top(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    order = np.argsort(-pairs["score"].to_numpy(), kind="stable")
    pairs, cross = pairs.iloc[order], cross.to_numpy(bool)[order]
    keep, crossed = np.zeros(len(pairs), bool), set()
    for n, (a, b, c) in enumerate(zip(pairs["query_id"].tolist(), pairs["id"].tolist(), cross.tolist(), strict=True)):
        x, y = top(a), top(b)
        if x != y:
            root[y] = x
            keep[n] = True
        if c and not (a in crossed and b in crossed):
            crossed.update((a, b))
            keep[n] = True
    return pairs[keep]


def sweep_pairs(vectors: DataFrame, least: float, cross: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """(a, b, score, cross) for threshold_sweep() at thresholds from `least` on: of each pair of blocks its forest() alone,
    so what is kept grows with the facts and not with the pairs; the sweep's figures are those of all pairs."""
    found = pairs_above(vectors, least, thin=lambda df: forest(df, cross(df["query_id"], df["id"])))

    @F.pandas_udf("boolean")
    def is_cross(a: pd.Series, b: pd.Series) -> pd.Series:
        return cross(a, b)

    return found.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score", is_cross("query_id", "id").alias("cross"))


def threshold_sweep(pairs: DataFrame, thresholds: list[float], n_facts: int) -> DataFrame:
    """Per threshold: facts with a neighbour, those with one of other sources, clusters, survivors, reduction.

    pairs: (a, b, score, cross) once per unordered pair, cross: no common source.
    """
    spark = pairs.sparkSession
    pairs, out = _saved(pairs), None
    for t in thresholds:  # a handful of parameters, one plan each
        at = pairs.where(F.col("score") >= t)
        ends = at.select(F.explode(F.array("a", "b")).alias("id"), "cross").groupBy("id").agg(F.bool_or("cross").alias("cross"))
        seen = ends.agg(F.count(F.lit(1)).alias("any_neighbour"), F.count_if("cross").alias("cross_source"))
        clusters = components(at.select(F.col("a").alias("u"), F.col("b").alias("v"))).select("root").distinct().agg(F.count(F.lit(1)).alias("clusters"))
        row = seen.crossJoin(clusters).select(F.lit(float(t)).alias("threshold"), "any_neighbour", "cross_source", "clusters", (F.lit(n_facts) - F.col("any_neighbour") + F.col("clusters")).alias("survivors"))
        row = row.withColumn("reduction_pct", F.round((n_facts - F.col("survivors")) * 100.0 / n_facts, 4))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "threshold double, any_neighbour long, cross_source long, clusters long, survivors long, reduction_pct double")


def score_histogram(top: DataFrame, edges: list[float]) -> DataFrame:
    """Counts per bin [lo, hi); the last is closed."""
    cases = [(F.col("score") >= lo) & ((F.col("score") <= hi) if i == len(edges) - 2 else (F.col("score") < hi)) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    chosen = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(cases)])
    return top.select(chosen.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def examples(pairs: DataFrame, thresholds: list[float], per_band: int = 5) -> DataFrame:
    """Some pairs of each band [t, next), in the order of the MD5 of their ids."""
    bands = list(zip(thresholds, [*thresholds[1:], 1.01], strict=True))
    which = F.coalesce(*[F.when((F.col("score") >= lo) & (F.col("score") < hi), F.lit(float(lo))) for lo, hi in bands])
    w = Window.partitionBy("band").orderBy(F.md5(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))), "a", "b")
    return pairs.withColumn("band", which).where("band is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_band).drop("r")


def band_examples(vectors: DataFrame, thresholds: list[float], per_band: int = 5) -> DataFrame:
    """examples() of all pairs of facts at or above the lowest threshold: each pair of blocks hands on only its own examples."""
    ends = np.array([*thresholds, 1.01])

    def thin(pairs: pd.DataFrame) -> pd.DataFrame:
        order = [hashlib.md5(f"{a}-{b}".encode()).hexdigest() for a, b in zip(pairs["query_id"].tolist(), pairs["id"].tolist(), strict=True)]
        rows = pairs.assign(_o=order, _b=np.searchsorted(ends, pairs["score"].to_numpy(), side="right")).sort_values(["_b", "_o", "query_id", "id"])
        return rows.groupby("_b").head(per_band)[["query_id", "id", "score"]]

    found = pairs_above(vectors, min(thresholds), thin=thin)
    return examples(found.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score"), thresholds, per_band)
