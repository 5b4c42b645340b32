"""Scoring of answers and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The abstention without its final dot, and the mark of a failed call.
ABSTENTIONS = ("insufficient information",)
LLM_ERROR = "[llm error]"


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != ""))


def answer_match(prediction: Column, gold: Column) -> Column:
    """Any common lower-cased token."""
    return F.coalesce(F.arrays_overlap(words(prediction), words(gold)), F.lit(False))


def score(predictions: DataFrame, abstentions: tuple[str, ...] = ABSTENTIONS) -> DataFrame:
    """Per question_type and over all ("all"): n, correct, refused, substantive, hallucinated, accuracy.  Failed calls do not count."""
    low = F.lower(F.trim(F.coalesce("prediction", F.lit(""))))
    bare = F.regexp_replace(low, r"\.+$", "")
    rows = predictions.where(low != LLM_ERROR).select(
        F.explode(F.array(F.coalesce("question_type", F.lit("unknown")), F.lit("all"))).alias("question_type"), answer_match(F.col("prediction"), F.col("gold")).alias("ok"),
        ((bare == "") | bare.isin(*abstentions)).alias("refused"),
    )
    return rows.groupBy("question_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("correct"), F.count_if("refused").alias("refused"), F.count_if(~F.col("refused")).alias("substantive"),
        F.count_if(~F.col("refused") & ~F.col("ok")).alias("hallucinated"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"),
    )


def bootstrap_poisson(rows: DataFrame, value: str, resamples: int = 2000, alpha: float = 0.025, seed: int = 42) -> DataFrame:
    """(lo, hi) of the mean by Poisson bootstrap.

    In a resample every row counts Poisson(1) times, so n rows of one value count Poisson(n) times: rows are grouped by
    value first and each value draws one count a resample, from hashes; above 64 rows as a rounded normal variable.
    The draws are not those of a particular random generator.  Rows without a value do not count; without any, both are null.
    """
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    uniform = lambda *key: (F.pmod(F.xxhash64(F.lit(seed), "x", "b", *key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    one = lambda j: sum((F.when(uniform(j) >= c, 1).otherwise(0) for c in cdf), F.lit(0))
    few = F.aggregate(F.transform(F.sequence(F.lit(1), F.least("n", F.lit(64))), one), F.lit(0), lambda a, k: a + k).cast("double")
    normal = F.sqrt(-2 * F.ln(uniform(F.lit(-1)))) * F.cos(2 * F.pi() * uniform(F.lit(-2)))
    k = F.when(F.col("n") <= 64, few).otherwise(F.greatest(F.lit(0.0), F.round(F.col("n") + F.sqrt("n") * normal)))
    values = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    drawn = values.select("x", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).withColumn("k", k)
    means = drawn.groupBy("b").agg(F.try_divide(F.sum(F.col("x") * F.col("k")), F.sum("k")).alias("m"))
    ordered = means.agg(F.array_sort(F.collect_list("m")).alias("s"))  # a value a resample
    return ordered.select(F.get("s", F.lit(int(alpha * resamples))).alias("lo"), F.get("s", F.lit(min(int((1 - alpha) * resamples), resamples - 1))).alias("hi"))


def recall_at(predictions: DataFrame, ks: list[int]) -> DataFrame:
    """Mean share of gold evidence among the first k hits; questions without gold are left out.

    predictions: (id, hits array<struct<title,source>>, gold array<struct<title,source>>).
    """
    key = lambda x: F.concat_ws("\u0001", F.lower(x["title"]), F.lower(x["source"]))
    rows = predictions.select(F.transform("hits", key).alias("h"), F.array_distinct(F.transform("gold", key)).alias("g")).where(F.size("g") > 0)
    return rows.agg(*[F.round(F.avg(F.size(F.array_intersect(F.slice("h", 1, k), "g")) / F.size("g")), 6).alias(f"recall_{k}") for k in ks])


def source_coverage(predictions: DataFrame, column: str = "source_ids") -> DataFrame:
    """E5"""
    return predictions.agg(F.avg((F.size(F.coalesce(column, F.array().cast("array<string>"))) > 0).cast("int")).alias("coverage"))


def triples_with(triples: DataFrame, keyword: str) -> DataFrame:
    """Triples with the keyword in subject, relation or object."""
    k = keyword.lower()
    return triples.where(F.contains(F.lower("s"), F.lit(k)) | F.contains(F.lower("r"), F.lit(k)) | F.contains(F.lower("o"), F.lit(k)))
