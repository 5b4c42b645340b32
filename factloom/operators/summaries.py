"""Summary slices, coverage and synthesis enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Facts of a concept from which on a slice holds so many.
TIERS = ((10_000, 200), (1_000, 100), (100, 50), (0, 20))


def slice_size(total: Column) -> Column:
    out = F.lit(TIERS[-1][1])
    for least, size in reversed(TIERS[:-1]):
        out = F.when(total >= least, F.lit(size)).otherwise(out)
    return out


def slices(links: DataFrame) -> DataFrame:
    """T25, from scratch: (concept_id, sequence_num, fact_ids, is_complete) in order of first_seen_at, then fact_id.

    Full slices are frozen.  An open rest is a slice only while the concept has no complete one.
    """
    w = Window.partitionBy("concept_id")
    rows = links.withColumns({"total": F.count(F.lit(1)).over(w), "rn": F.row_number().over(w.orderBy("first_seen_at", "fact_id"))})
    rows = rows.withColumn("size", slice_size(F.col("total"))).withColumn("sequence_num", F.ceil(F.col("rn") / F.col("size")).cast("int"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rn", "fact_id"))), lambda x: x["fact_id"])
    out = rows.groupBy("concept_id", "sequence_num").agg(ids.alias("fact_ids"), (F.count(F.lit(1)) == F.first("size")).alias("is_complete"))
    return out.where(F.col("is_complete") | (F.col("sequence_num") == 1))


def extend_slices(old: DataFrame, links: DataFrame) -> DataFrame:
    """T25, incremental: complete slices stay; what they do not cover is sliced anew behind them."""
    frozen = old.where("is_complete")
    rest = uncovered(links, frozen)
    base = frozen.groupBy("concept_id").agg(F.max("sequence_num").alias("base"))
    totals = links.groupBy("concept_id").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("concept_id").orderBy("first_seen_at", "fact_id")
    rows = rest.join(totals, "concept_id").join(base, "concept_id", "left").withColumn("rn", F.row_number().over(w)).withColumn("size", slice_size(F.col("total")))
    rows = rows.withColumn("sequence_num", (F.coalesce("base", F.lit(0)) + F.ceil(F.col("rn") / F.col("size"))).cast("int"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rn", "fact_id"))), lambda x: x["fact_id"])
    new = rows.groupBy("concept_id", "sequence_num").agg(ids.alias("fact_ids"), (F.count(F.lit(1)) == F.first("size")).alias("is_complete"), F.max("base").alias("base"))
    new = new.where(F.col("is_complete") | (F.col("base").isNull() & (F.col("sequence_num") == 1))).drop("base")
    return frozen.select("concept_id", "sequence_num", "fact_ids", "is_complete").unionByName(new)


def uncovered(links: DataFrame, summaries: DataFrame) -> DataFrame:
    """Links whose fact no summary of the concept covers."""
    covered = summaries.select("concept_id", F.explode("fact_ids").alias("fact_id"))
    return links.join(covered, ["concept_id", "fact_id"], "left_anti")


def is_stale(covered: Column, current: Column) -> Column:
    """A synthesis is current while it covers all slices there are."""
    return F.size(F.array_except(current, F.coalesce(covered, F.array().cast("array<string>")))) > 0


def enrichment(relation: DataFrame, contexts: DataFrame, name, most: int = 10, with_text: int = 3, most_contexts: int = 5) -> DataFrame:
    """The strongest relations of a name: (other, weight, with_text, contexts).  contexts: (name, context)."""
    ahead = relation.where(F.col("name_a") == F.lit(name)).select(F.col("name_b").alias("other"), "weight")
    back = relation.where(F.col("name_b") == F.lit(name)).select(F.col("name_a").alias("other"), "weight")
    top = ahead.unionByName(back).orderBy(F.desc("weight"), "other").limit(most)
    top = top.withColumn("with_text", F.row_number().over(Window.orderBy(F.desc("weight"), "other")) <= with_text)  # at most `most` rows
    per = contexts.join(F.broadcast(top.select(F.col("other").alias("name"))), "name").groupBy(F.col("name").alias("other")).agg(F.slice(F.sort_array(F.collect_set("context")), 1, most_contexts).alias("contexts"))
    return top.join(per, "other", "left")


def next_sequence(summaries: DataFrame, concept) -> DataFrame:
    """The largest sequence number of a concept, 0 without one."""
    return summaries.where(F.col("concept_id") == F.lit(concept)).agg(F.coalesce(F.max("sequence_num"), F.lit(0)).alias("sequence_num"))
