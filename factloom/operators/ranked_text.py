"""a positional index with field labels, cover density from its postings, and the search rank of concepts.

The index is a table of (key, lexeme, pos, label), one row an occurrence, exploded from each row alone (no shuffle).
A query reads the postings of its own lexemes, which a table partitioned or bucketed by lexeme prunes; covers are found by
windows over one key's hits, so nothing of a text that the query does not name is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _saved
from .search import LABEL_WEIGHTS, Tree, lexemes, matches, parse_query


def labelled_lexemes(*fields: tuple[Column, str], stem: bool = False) -> Column:
    """array<struct<lexeme, pos, label>> of several texts in order; positions of a field follow on the last one of the fields before it."""
    out = None
    for text, label in fields:
        own = F.transform(lexemes(text, stem), lambda x: F.struct(x["lexeme"].alias("lexeme"), x["pos"].cast("int").alias("pos"), F.lit(label).alias("label")))
        if out is None:
            out = own
        else:
            last = F.coalesce(F.array_max(F.transform(out, lambda x: x["pos"])), F.lit(0))
            out = F.concat(out, F.transform(own, lambda x: F.struct(x["lexeme"].alias("lexeme"), (x["pos"] + last).alias("pos"), x["label"].alias("label"))))
    return out


def occurrences(df: DataFrame, key: str, *fields: tuple[Column, str], stem: bool = False) -> DataFrame:
    """the index (key, lexeme, pos, label) of labelled texts; a null text has none, repeated keys come out each."""
    return _exploded(df.select(key, labelled_lexemes(*fields, stem=stem).alias("l")), key)


def _exploded(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode("l").alias("l")).select(key, "l.lexeme", "l.pos", "l.label")


def groups_of(tree: Tree | None) -> list[list[str]]:
    """What a cover must hold: for each clause of a query one of its words (of a phrase each); excluded words do not count."""
    if tree is None or tree[0] == "not":
        return []
    kind, arg = tree
    if kind == "word":
        return [[arg]]
    if kind == "phrase":
        return [[w] for _, w in arg]
    parts = [groups_of(t) for t in arg]
    return [g for p in parts for g in p] if kind == "and" else [[w for p in parts for g in p for w in g]]


def cover_density(index: DataFrame, key: str, groups: list[list[str]]) -> DataFrame:
    """(key, rank): over the minimal covers of all groups the sum of (hits / sum of inverse label weights) / (1 + words between that are none).

    Keys that lack a group do not show; without groups nothing does.
    """
    groups = [sorted(set(g)) for g in groups if g]
    if not groups:
        return index.select(key, F.lit(0.0).alias("rank")).limit(0)
    words = sorted({w for g in groups for w in g})
    hits = index.where(F.col("lexeme").isin(words)).groupBy(key, "pos", "lexeme").agg(F.max(_weight()).alias("weight"))
    order = Window.partitionBy(key).orderBy("pos", "lexeme")  # one text's hits of the query
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("lexeme").isin(g), F.col("pos"))).over(upto) for g in groups]
    at = hits.select(key, "pos", F.sum(F.lit(1)).over(upto).alias("number"), F.sum(1 / F.col("weight")).over(upto).alias("inverse"), _least(last).alias("begin"))
    # the last hit of a position counts all of them; a cover ends where the latest possible beginning moves on
    at = at.groupBy(key, "pos").agg(F.max("number").alias("number"), F.max("inverse").alias("inverse"), F.max("begin").alias("begin"))
    by_pos = Window.partitionBy(key).orderBy("pos")
    ends = at.withColumn("before", F.lag("begin").over(by_pos)).where("begin is not null and (before is null or begin > before)")
    first = at.select(key, F.col("pos").alias("begin"), F.col("number").alias("n0"), F.col("inverse").alias("i0"))
    own = hits.groupBy(key, F.col("pos").alias("begin")).agg(F.count(F.lit(1)).alias("n1"), F.sum(1 / F.col("weight")).alias("i1"))
    covers = ends.join(first, [key, "begin"]).join(own, [key, "begin"])
    number, inverse = F.col("number") - F.col("n0") + F.col("n1"), F.col("inverse") - F.col("i0") + F.col("i1")
    noise = F.col("pos") - F.col("begin") - (number - 1)
    noise = F.when(noise < 0, F.floor((number - 1) / 2)).otherwise(noise)
    return covers.groupBy(key).agg(F.sum(number / inverse / (1 + noise)).alias("rank"))


def _weight() -> Column:
    return F.coalesce(*[F.when(F.col("label") == label, F.lit(w)) for label, w in LABEL_WEIGHTS.items()])


def _least(columns: list[Column]) -> Column:
    """The least of all; null if one is null."""
    some = columns[0]
    for c in columns[1:]:
        some = F.when(some.isNull() | c.isNull(), F.lit(None)).otherwise(F.least(some, c))
    return some


def search_rank(concepts: DataFrame, aliases: DataFrame, q: str, stem: bool = False) -> DataFrame:
    """(concept_id, name_rank, alias_rank, search_rank) of concepts (concept_id, name, description) that fulfil q.

    A concept does by its name (label A) and description (D) together, or by one of its aliases (concept_id, alias; A).
    name_rank is the cover density of the former, alias_rank the largest of its aliases', 0 where they do not match;
    search_rank is the greater.  An empty query (or one of stop words) gives all concepts with ranks 0.
    """
    tree = parse_query(q)
    if tree is None:
        return concepts.select("concept_id", *[F.lit(0.0).alias(c) for c in ("name_rank", "alias_rank", "search_rank")])
    groups, fields = groups_of(tree), ((F.col("name"), "A"), (F.col("description"), "D"))
    words = sorted({w for g in groups for w in g})
    # what both ranks need of the texts, written once: the hits of those that match (null: does not), as the plans below read it some times
    hits = lambda lex: F.when(matches(lex, tree, stem), F.filter(lex, lambda x: x["lexeme"].isin(words)))
    every = _saved(concepts.select("concept_id", hits(labelled_lexemes(*fields, stem=stem)).alias("l")))
    found = every.where("l is not null")
    own = cover_density(_exploded(found, "concept_id"), "concept_id", groups).withColumnRenamed("rank", "name_rank")
    each = aliases.select("concept_id", "alias", hits(labelled_lexemes((F.col("alias"), "A"), stem=stem)).alias("l")).where("l is not null")
    each = _saved(each.groupBy("concept_id", "alias").agg(F.first("l").alias("l")).select("concept_id", "l", F.monotonically_increasing_id().alias("one")))
    other = cover_density(_exploded(each, "one"), "one", groups)
    other = each.select("concept_id", "one").join(other, "one").groupBy("concept_id").agg(F.max("rank").alias("alias_rank"))
    met = found.select("concept_id").unionByName(each.select("concept_id")).distinct().join(every.select("concept_id").distinct(), "concept_id", "left_semi")
    rows = met.join(own, "concept_id", "left").join(other, "concept_id", "left").select("concept_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("name_rank", "alias_rank")])
    return rows.withColumn("search_rank", F.greatest("name_rank", "alias_rank"))
