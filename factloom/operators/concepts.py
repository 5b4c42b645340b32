"""Concept groups, relations, provenance, intersections, aliases, candidates, contexts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import band
from ..functions.vectors import cosine
from .graph import _saved
from .relational import latest

# ---- J6, U2, U3, T21, T22: co-occurrence ----------------------------------------------------------------------------


def relations(links: DataFrame, fact: str = "fact_id", name: str = "name", block: int = 256, most: int = 1_000_000) -> DataFrame:
    """Pairs of names with the number of facts they share: (name_a, name_b, weight), name_a < name_b.

    Each fact's names meet once as a sorted array, so the pairs are made within a row and the only shuffles are those
    by fact and by pair; a name that many facts have never meets itself in a join.  The names of a
    fact with more than `block` are cut into blocks, and each pair of blocks goes to a task of its own.  The arrays are
    made once and dealt to tasks that make about `most` pairs each; tasks that count get half as many, as
    they hold them twice; neither grows with the input.  Most pairs are rare, so they are dealt by pair without a count before.
    """
    names = _saved(links.groupBy(fact).agg(F.array_sort(F.collect_set(name)).alias("names")).where(F.size("names") > 1))
    n, cuts = F.size("names").cast("long"), F.ceil(F.size("names") / block)
    small, big = F.when(n <= block, n * (n - 1) / 2), F.when(n > block, cuts * (cuts + 1) / 2 * block * block)
    made = names.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for c, k in ((small, "small"), (big, "big"))]).first()
    cores = links.sparkSession.sparkContext.defaultParallelism
    tasks = lambda pairs: max(1, -(-pairs // most), min(cores, -(-pairs // 50_000)))
    within = lambda a: F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y: F.struct(x.alias("name_a"), y.alias("name_b")))))
    pairs = names.where(F.size("names") <= block).repartition(tasks(made["small"]), fact).select(F.inline(within(F.col("names"))))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / block).cast("int")), lambda b: F.slice("names", b * block + 1, block))
    blocks = names.where(F.size("names") > block).select(fact, F.posexplode(cut).alias("b", "some"), F.floor((F.size("names") - 1) / block).cast("int").alias("last"))
    first = blocks.select(fact, F.col("b").alias("a"), F.col("some").alias("low"), F.explode(F.sequence("b", "last")).alias("b"))
    met = first.join(blocks.select(fact, "b", "some"), [fact, "b"]).repartition(tasks(made["big"]), fact, "a", "b")
    across = F.flatten(F.transform("low", lambda x: F.transform("some", lambda y: F.struct(x.alias("name_a"), y.alias("name_b")))))
    large = met.select(F.inline(F.when(F.col("a") == F.col("b"), within(F.col("low"))).otherwise(across)))
    both = pairs.unionByName(large).repartition(tasks(2 * (made["small"] + made["big"])), "name_a", "name_b")
    return both.groupBy("name_a", "name_b").agg(F.count(F.lit(1)).alias("weight"))


def relation_list(relation: DataFrame, name, minimum: int = 3, stable: int = 6) -> DataFrame:
    """Both directions of a name's relations with their band."""
    ahead = relation.where(F.col("name_a") == F.lit(name)).select(F.col("name_b").alias("other"), "weight")
    back = relation.where(F.col("name_b") == F.lit(name)).select(F.col("name_a").alias("other"), "weight")
    return ahead.unionByName(back).withColumn("band", band(F.col("weight"), minimum, stable))


def relation_count(relation: DataFrame, name, minimum: int = 1) -> DataFrame:
    both = relation_list(relation, name).where(F.col("weight") >= minimum).select("other").distinct()
    return both.agg(F.count(F.lit(1)).alias("n"))


def relation_detail(links: DataFrame, a, b) -> DataFrame:
    """Per context of `a` the number of facts shared with `b` and their ids."""
    mine = links.where(F.col("name") == F.lit(a)).select("fact_id", "context").distinct()
    theirs = links.where(F.col("name") == F.lit(b)).select("fact_id").distinct()
    return mine.join(theirs, "fact_id").groupBy("context").agg(F.count_distinct("fact_id").alias("shared"), F.sort_array(F.collect_set("fact_id")).alias("fact_ids"))


# ---- A8, A11, P19, T20: groups --------------------------------------------------------------------------------------


def concepts_of(links: DataFrame) -> DataFrame:
    """One concept per (name, context): its id, its facts."""
    return links.groupBy("name", "context").agg(F.count(F.lit(1)).alias("fact_count")).withColumn("concept_id", F.concat_ws("|", "name", "context"))


def groups(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """Per lower-cased name: smallest name, number of contexts, links, and whether any is embedded.

    context_count is the number of concepts; context_count_compat that of rows after the left join to links, which the
    stored summary calls context_count.  concepts: (concept_id, name, embedded); links: (concept_id, fact_id).
    """
    per = links.groupBy("concept_id").agg(F.count(F.lit(1)).alias("links"))
    rows = concepts.join(per, "concept_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return rows.groupBy(F.lower("name").alias("name_key")).agg(
        F.min("name").alias("canonical_name"), F.count(F.lit(1)).alias("context_count"), F.sum(F.greatest("links", F.lit(1))).alias("context_count_compat"),
        F.sum("links").alias("total_fact_count"), F.bool_or("embedded").alias("any_embedded"),
    )


def floor(grouped: DataFrame, minimum: int = 5) -> DataFrame:
    """Small groups go; a minimum of 0 or less keeps all."""
    return grouped if minimum <= 0 else grouped.where(F.col("total_fact_count") >= minimum)


def grouped_hits(hits: DataFrame) -> DataFrame:
    """Search hits (name, context, fact_count, rank, pos) as groups: display name of the first hit, best rank, contexts in order.

    Order by rank desc, total_fact_count desc, name asc.
    """
    contexts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "context"))), lambda x: x["context"])
    return hits.groupBy(F.lower("name").alias("name_key")).agg(F.min_by("name", "pos").alias("name"), F.sum("fact_count").alias("total_fact_count"), F.max("rank").alias("rank"), contexts.alias("contexts"))


def refresh_groups(old: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Touched keys are recomputed, those without a concept vanish.  touched: (name_key)."""
    kept = old.join(touched, "name_key", "left_anti")
    return kept.unionByName(fresh.join(touched, "name_key", "left_semi"))


# ---- A4, A5, A9, A10: provenance and intersections ------------------------------------------------------------------


def source_counts(facts: DataFrame, fact_sources: DataFrame, repository: str | None = None) -> DataFrame:
    """Facts with the number of their sources; within the repository, or over all where it is None."""
    seen = fact_sources if repository is None else fact_sources.where(F.col("repository_id") == repository)
    per = seen.groupBy("fact_id").agg(F.count_distinct("source_id").alias("source_count"))
    return facts.join(per, "fact_id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def provenance(links: DataFrame, name) -> DataFrame:
    """A5: per source the distinct facts of a concept."""
    return links.where(F.col("name") == F.lit(name)).groupBy("source_id").agg(F.count_distinct("fact_id").alias("facts"), F.min("fact_id").alias("first_fact"))


def intersection(links: DataFrame, wanted: list[list]) -> DataFrame:
    """Facts that have a name of every group: (fact_id)."""
    spark = links.sparkSession
    pairs = [(name, g) for g, names in enumerate(wanted) for name in dict.fromkeys(names)]
    named = spark.createDataFrame(pairs, f"name {links.schema['name'].dataType.simpleString()}, grp int")
    met = links.select("fact_id", "name").join(F.broadcast(named), "name")  # as many rows as names were asked for
    return met.groupBy("fact_id").agg(F.count_distinct("grp").alias("n")).where(F.col("n") == len(wanted)).select("fact_id")


def unlinked(facts: DataFrame, links: DataFrame, skips: DataFrame, most_attempts: int) -> DataFrame:
    """Facts without a concept, without a pending candidate and not given up on."""
    given_up = skips.where(F.col("attempts") >= most_attempts).select("fact_id")
    return facts.join(links.select("fact_id"), "fact_id", "left_anti").join(given_up, "fact_id", "left_anti")


def record_skips(skips: DataFrame, failures: DataFrame) -> DataFrame:
    """Attempts add up per fact; the last error stays.  failures: (fact_id, error, at)."""
    old = skips.select("fact_id", F.col("last_error").alias("error"), F.col("last_attempt_at").alias("at"), "attempts")
    rows = old.unionByName(failures.withColumn("attempts", F.lit(1)))
    return rows.groupBy("fact_id").agg(F.max_by("error", "at").alias("last_error"), F.sum("attempts").cast("int").alias("attempts"), F.max("at").alias("last_attempt_at"))


# ---- T14 - T18, T23, T24: aliases, routing, refinement, contexts ----------------------------------------------------


def add_aliases(aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """(concept_id, alias) unique by lower case; what is there stays."""
    both = aliases.select("concept_id", "alias", F.lit(0).alias("o")).unionByName(rows.select("concept_id", "alias", F.lit(1).alias("o")))
    return latest(both.withColumn("key", F.lower("alias")), ["concept_id", "key"], F.col("o"), F.col("alias")).select("concept_id", "alias")


def prune_aliases(aliases: DataFrame, unwanted: DataFrame) -> DataFrame:
    key = unwanted.select("concept_id", F.lower("alias").alias("key")).distinct()
    return aliases.withColumn("key", F.lower("alias")).join(key, ["concept_id", "key"], "left_anti").drop("key")


def named_concepts(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every spelling of every concept: (repository_id, context_key, key, concept_id, created_at, canonical)."""
    base = concepts.select("repository_id", F.lower("context").alias("context_key"), "concept_id", "created_at", "name")
    own = base.select("*", F.lower("name").alias("key"), F.lit(True).alias("canonical")).drop("name")
    more = base.drop("name").join(aliases, "concept_id").select("repository_id", "context_key", "concept_id", "created_at", F.lower("alias").alias("key"), F.lit(False).alias("canonical"))
    both = own.unionByName(more)
    return both.groupBy("repository_id", "context_key", "key", "concept_id", "created_at").agg(F.bool_or("canonical").alias("canonical"))


def _candidates(mentions: DataFrame, names: DataFrame, concept_vectors: DataFrame, fact_vectors: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """mentions (fact_id, repository_id, context, mention, more columns) with those of their fact and mention: n concepts, whether the fact
    has a vector, and the hit (score, created_at, concept_id) that is best.

    A fact's rows are sent once, to one task, which also groups them by anything that holds fact_id.  Spellings of up to most_bytes
    are broadcast, more meet the mentions by a shuffle before.
    """
    keys = ["repository_id", "context_key", "key"]
    spelling = F.to_json(F.struct(*keys)).alias("spelling")
    listed = names.where(" and ".join(f"{k} is not null" for k in keys)).select(spelling, "concept_id", "created_at").where("concept_id is not null")
    spelled = _saved(listed.groupBy("spelling").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("created_at", "concept_id")).alias("first")))
    small = (spelled.agg(F.sum(F.octet_length("spelling") + F.octet_length(F.col("first.concept_id").cast("string")) + 32)).first()[0] or 0) <= most_bytes
    spell = lambda df: df.withColumns({"context_key": F.lower("context"), "key": F.lower(F.trim("mention"))}).withColumn("spelling", spelling).drop("context_key", "key")
    if small:
        met = spell(mentions.repartition("fact_id")).join(F.broadcast(spelled), "spelling", "left")
    else:
        met = spell(mentions).join(spelled, "spelling", "left").repartition("fact_id")
    met, each = met.withColumn("n", F.coalesce("n", F.lit(0))), Window.partitionBy("fact_id", "mention")
    known = fact_vectors.where("embedding is not null")
    best = F.when(F.col("n") > 0, F.struct(F.lit(-1.0).alias("score"), "first.created_at", "first.concept_id"))
    if known.isEmpty():  # nothing is near anything
        met = met.withColumns({"all": F.sum("n").over(each), "has": F.lit(False)})
    else:
        known = known.select("fact_id", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(7), "embedding").alias("g"), F.col("embedding").alias("fv"))  # a vector is known by 128 bits
        met = met.join(known, "fact_id", "left").withColumn("all", F.sum("n").over(each))
        asked = met.where("all > 1 and n > 0 and fv is not null").groupBy("spelling", "h", "g").agg(F.first("fv").alias("fv"))
        some = listed.join(concept_vectors.select("concept_id", F.col("embedding").alias("cv")), "concept_id", "left")
        closest = _closest(asked, some.groupBy("spelling", "cv").agg(F.min(F.struct("created_at", "concept_id")).alias("c")).select("spelling", "cv", "c.*"))
        met = met.drop("fv").join(closest, ["spelling", "h", "g"], "left").repartition("fact_id").withColumn("has", F.bool_or(F.col("h").isNotNull()).over(each))
        best = F.coalesce(F.col("best"), best)
    order = F.struct(F.col("hit").isNull(), -F.col("hit.score"), F.col("hit.created_at"), F.col("hit.concept_id"))
    met = met.withColumn("hit", best).withColumn("hit", F.min_by("hit", order).over(each))
    return met.select(*mentions.columns, F.col("all").alias("n"), "has", "hit")


def route(mentions: DataFrame, names: DataFrame, concept_vectors: DataFrame, fact_vectors: DataFrame) -> DataFrame:
    """(fact_id, mention, concept_id, outcome) of each mention (fact_id, repository_id, context, mention).

    No concept with that spelling: miss.  One: it.  Several: the one closest to the fact, ties by (created_at, id);
    without the fact's vector the mention is deferred.

    A mention meets its spelling once, with the number of its concepts and the first of them.  Only where there are
    several do the different vectors of facts meet those of the concepts, in blocks (_closest).
    """
    met = _candidates(mentions.select("fact_id", "repository_id", "context", "mention"), names, concept_vectors, fact_vectors)
    top = met.groupBy("fact_id", "mention").agg(*[F.first(c).alias(c) for c in ("n", "has", "hit")])  # the same in all rows
    defer = (F.col("n") > 1) & ~F.col("has")
    outcome = F.when(F.col("n") == 0, "miss").when(defer, "deferred").otherwise("linked")
    return top.select("fact_id", "mention", F.when(~defer, F.col("hit.concept_id")).alias("concept_id"), outcome.alias("outcome"))


def _closest(asked: DataFrame, some: DataFrame, block: int = 8192, buckets: int = 1024) -> DataFrame:
    """(spelling, h, g, best): for each asked vector (spelling, h, g, fv) the closest of its spelling's concepts (spelling, cv, created_at, concept_id).

    A spelling with many vectors is cut into blocks on both sides, whose products are matrices; the small ones share a
    task's group.  A concept without a vector, or with one of norm 0 or another length, scores -1.
    """
    parts = lambda df, c: df.groupBy("spelling").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(c))
    sizes = parts(asked, "qs").join(parts(some, "cs"), "spelling")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    bucket = F.pmod(F.xxhash64("spelling"), F.lit(buckets)).alias("u")
    q = asked.join(sizes, "spelling").select("spelling", "h", "g", "fv", bucket, F.pmod("h", F.col("qs").cast("long")).cast("int").alias("qb"), every("cs").alias("cb"))
    c = some.join(sizes, "spelling").select("spelling", "cv", "created_at", "concept_id", bucket, F.pmod(F.xxhash64("concept_id"), F.col("cs").cast("long")).cast("int").alias("cb"), every("qs").alias("qb"))
    kinds = {n: some.schema[n].dataType.simpleString() for n in ("created_at", "concept_id")}

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right = right.sort_values(["created_at", "concept_id"], kind="stable", na_position="first")  # the first of equal scores wins
        at = right.groupby("spelling", sort=False).indices
        for spelling, mine in left.groupby("spelling", sort=False).indices.items():
            if spelling not in at:
                continue
            there = right.iloc[np.sort(at[spelling])]
            here = left.iloc[mine]
            widths = np.array([len(v) for v in here["fv"]])
            vectors = [() if v is None else v for v in there["cv"]]
            lengths = np.array([len(v) for v in vectors])
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                like = np.flatnonzero(lengths == width) if width else np.array([], int)
                b = np.array([vectors[i] for i in like], np.float64).reshape(len(like), width)
                nb = np.linalg.norm(b, axis=1)
                for start in range(0, len(rows), 512):
                    some_rows = rows[start : start + 512]
                    a = np.array([here["fv"].iloc[i] for i in some_rows], np.float64).reshape(len(some_rows), width)
                    score = np.full((len(some_rows), len(vectors)), -1.0)
                    n = np.linalg.norm(a, axis=1)[:, None] * nb[None]
                    score[:, like] = np.divide(a @ b.T, n, out=np.full(n.shape, -1.0), where=n > 0)
                    first = score.argmax(1)
                    got = here.iloc[some_rows][["spelling", "h", "g"]].reset_index(drop=True)
                    out.append(got.assign(score=score[np.arange(len(some_rows)), first], created_at=there["created_at"].to_numpy()[first], concept_id=there["concept_id"].to_numpy()[first]))
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in ("spelling", "h", "g", "score", "created_at", "concept_id")})

    named = [F.col(n).alias(f"{n}_") for n in ("u", "qb", "cb")]
    right = c.select("spelling", "cv", "created_at", "concept_id", *named).groupBy("u_", "qb_", "cb_")
    found = q.groupBy("u", "qb", "cb").cogroup(right).applyInPandas(meet, f"spelling string, h long, g long, score double, created_at {kinds['created_at']}, concept_id {kinds['concept_id']}")
    return found.groupBy("spelling", "h", "g").agg(F.min_by(F.struct("score", "created_at", "concept_id"), F.struct(-F.col("score"), F.col("created_at"), F.col("concept_id"))).alias("best"))


def route_direct(mentions: DataFrame, names: DataFrame, concept_vectors: DataFrame, fact_vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Routing without refinement, all mentions at once: (links, created, aliases).

    mentions: (fact_id, repository_id, context, mention, seeds).  A mention that route() links goes to that concept and
    hands it its seed aliases; any other, deferred ones included, finds or creates the concept of its repository, context
    and spelling (without regard to case): one id for one key, however many facts ask for it, so nothing races.  links:
    (fact_id, concept_id, created) once per pair; created: (concept_id, repository_id, context, name), the name as the
    smallest fact_id spells it; aliases: (concept_id, alias) of seeds, and of created concepts their name.  Empty seeds
    and blank mentions do not count.
    """
    asked = mentions.where("trim(mention) <> ''").select("fact_id", "repository_id", "context", "mention", "seeds")
    linked = (F.col("n") > 0) & ((F.col("n") == 1) | F.col("has")) & F.col("fact_id").isNotNull()
    found = _candidates(asked, names, concept_vectors, fact_vectors).withColumn("concept_id", F.when(linked, F.col("hit.concept_id")))
    new_id = F.md5(F.to_json(F.struct("repository_id", F.lower("context").alias("context_key"), F.lower(F.trim("mention")).alias("key"))))
    found = found.withColumn("created", F.col("concept_id").isNull()).withColumn("concept_id", F.coalesce(F.col("concept_id").cast("string"), new_id))
    links = found.groupBy("fact_id", "concept_id").agg(F.bool_and("created").alias("created"))
    first = F.min_by(F.struct("context", F.trim("mention").alias("name")), F.struct("fact_id", "mention"))
    made = found.where("created").groupBy("concept_id", "repository_id").agg(first.alias("first"))
    created = made.select("concept_id", "repository_id", "first.context", "first.name")
    # seeds and names in one pass over the rows: of a created concept a row without alias, whose smallest gives the name
    spelled = F.struct(F.lit(None).cast("string").alias("alias"), F.struct("fact_id", "mention").alias("at"))
    seeded = F.transform(F.filter("seeds", lambda x: x != ""), lambda x: F.struct(x.alias("alias"), F.lit(None).cast(found.select(F.struct("fact_id", "mention").alias("at")).schema["at"].dataType).alias("at")))
    given = F.concat(F.coalesce(seeded, F.array().cast(found.select(F.array(spelled).alias("x")).schema["x"].dataType)), F.when(F.col("created"), F.array(spelled)).otherwise(F.array()))
    each = found.select("concept_id", F.when(F.col("created"), F.col("repository_id")).alias("repository_id"), F.inline(given))
    each = each.groupBy("concept_id", "repository_id", "alias").agg(F.min("at").alias("at"))
    return links, created, each.select("concept_id", F.coalesce("alias", F.trim("at.mention")).alias("alias")).distinct()


def refine(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """(candidate_id, concept_id, how): by name, then alias, then each seed alias (name, alias), else to be created.

    candidates: (candidate_id, repository_id, context, text, seeds).
    """
    spelled = candidates.select("candidate_id", "repository_id", F.lower("context").alias("context_key"), F.posexplode(F.concat(F.array("text"), F.coalesce("seeds", F.array().cast("array<string>")))).alias("i", "s"))
    met = spelled.withColumn("key", F.lower(F.trim("s"))).join(names, ["repository_id", "context_key", "key"])
    best = F.min_by(F.struct("concept_id", "i", "canonical"), F.struct("i", ~F.col("canonical"), "created_at", "concept_id"))
    found = met.groupBy("candidate_id").agg(best.alias("b"))
    how = F.when(F.col("b").isNull(), "create").when(F.col("b.i") > 0, "seed").when(F.col("b.canonical"), "canonical").otherwise("alias")
    return candidates.select("candidate_id").join(found, "candidate_id", "left").select("candidate_id", F.col("b.concept_id").alias("concept_id"), how.alias("how"))


def new_candidates(candidates: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions that no candidate covers, each (repository, lower text, lower context) once with all seed aliases."""
    key = ["repository_id", "text_key", "context_key"]
    old = candidates.select("repository_id", F.lower("text").alias("text_key"), F.lower("context").alias("context_key")).distinct()
    rows = mentions.withColumns({"text_key": F.lower("text"), "context_key": F.lower("context")}).join(old, key, "left_anti")
    return rows.groupBy(*key).agg(F.min("text").alias("text"), F.min("context").alias("context"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("seeds")))).alias("seeds"))


def migrate_context(concepts: DataFrame, links: DataFrame, aliases: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts of a context move to another.

    Where the name is there already, links and aliases go to that concept, the moved one goes and the target's
    embedding is reset; otherwise the concept changes its context.
    """
    fold = lambda c: F.lower(F.col(c))
    here, there = concepts.where(fold("context") == old.lower()), concepts.where(fold("context") == new.lower())
    merged = here.select("repository_id", fold("name").alias("k"), F.col("concept_id").alias("loser")).join(there.select("repository_id", fold("name").alias("k"), F.col("concept_id").alias("winner")), ["repository_id", "k"]).select("loser", "winner")
    out = concepts.join(merged.select(F.col("loser").alias("concept_id")), "concept_id", "left_anti")
    reset = merged.select(F.col("winner").alias("concept_id"), F.lit(True).alias("reset")).distinct()
    out = out.join(reset, "concept_id", "left").withColumn("embedded", F.col("embedded") & F.col("reset").isNull()).drop("reset")
    out = out.withColumn("context", F.when(fold("context") == old.lower(), F.lit(new)).otherwise(F.col("context")))
    moved = links.join(merged, links["concept_id"] == merged["loser"], "left").select(links["fact_id"], F.coalesce("winner", links["concept_id"]).alias("concept_id")).distinct()
    spelled = aliases.join(merged, aliases["concept_id"] == merged["loser"], "left").select(F.coalesce("winner", aliases["concept_id"]).alias("concept_id"), "alias")
    return out, moved, latest(spelled.withColumn("k", F.lower("alias")), ["concept_id", "k"], F.col("alias")).drop("k")


def map_outbound(rows: DataFrame, mapping: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Contexts leave by the mapping, else verbatim where the vocabulary is empty or has them, else the row goes."""
    m = mapping.select(F.lower("local").alias("k"), "remote")
    joined = rows.withColumn("k", F.lower("context")).join(m, "k", "left")
    keep = F.when(F.lit(not vocabulary) | F.col("k").isin([v.lower() for v in vocabulary]), F.col("context"))
    return joined.withColumn("context", F.coalesce("remote", keep)).drop("k", "remote").where("context is not null")


def map_inbound(rows: DataFrame, mapping: DataFrame, local: DataFrame, policy: str, catch_all: str = "general") -> DataFrame:
    """Mapping first, then a local context of that name (in its own case), then the policy: skip, auto_add or catch_all."""
    m = mapping.select(F.lower("remote").alias("k"), F.col("local").alias("mapped"))
    own = local.groupBy(F.lower("context").alias("k")).agg(F.min("context").alias("own"))
    joined = rows.withColumn("k", F.lower("context")).join(m, "k", "left").join(own, "k", "left")
    rest = {"skip": F.lit(None).cast("string"), "auto_add": F.col("context"), "catch_all": F.lit(catch_all)}[policy]
    return joined.withColumn("context", F.coalesce("mapped", "own", rest)).drop("k", "mapped", "own").where("context is not null")


def resolve_aliases(names: DataFrame, repository, context: str, name: str) -> DataFrame:
    """Concepts whose name or alias is this, oldest first."""
    hit = (F.col("repository_id") == F.lit(repository)) & (F.col("context_key") == context.lower()) & (F.col("key") == name.lower())
    return names.where(hit).select("concept_id", "created_at").distinct().orderBy("created_at", "concept_id")


def top_names(hits: DataFrame, n: int) -> DataFrame:
    """Each lower-cased name with its largest count, the n largest of them."""
    best = hits.groupBy(F.lower("name").alias("name")).agg(F.max("fact_count").alias("fact_count"))
    return best.orderBy(F.desc("fact_count"), "name").limit(n)


def is_valid_name(name: Column) -> Column:
    """A concept's name has a letter or digit."""
    return name.rlike("[A-Za-z0-9]")
