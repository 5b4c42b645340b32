"""V1 - V9: vectors as array<float>, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, undefined: float = -1.0) -> Column:
    """Cosine; `undefined` (-1 when routing, 0 when gating) for empty, zero or unlike vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(undefined))


def centroid(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each key: (key, centroid)."""
    parts = vectors.select(key, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.groupBy(key).agg(ordered.alias("centroid"))


def representatives(vectors: DataFrame, key: str, item: str, vector: str = "embedding") -> DataFrame:
    """V7: per key the item whose vector is closest to the key's mean, ties by item."""
    scored = vectors.join(centroid(vectors, key, vector), key).select(key, item, F.round(cosine(F.col(vector), F.col("centroid")), 6).alias("score"))
    best = F.min_by(F.struct(F.col(item), F.col("score")), F.struct(-F.col("score"), F.col(item)))
    return scored.groupBy(key).agg(best.alias("b")).select(key, F.col(f"b.{item}").alias(item), F.col("b.score").alias("score"))


def pooled(tokens: DataFrame, key: str, vector: str = "embedding", keep: str = "mask") -> DataFrame:
    """V9: the mean of the token vectors that the mask keeps, with length one."""
    mean = centroid(tokens.where(F.col(keep)), key, vector)
    n = norm(F.col("centroid"))
    return mean.select(key, F.transform("centroid", lambda x: F.when(n > 0, x / n).otherwise(x)).alias("pooled"))


def concept_text(name: Column, context: Column) -> Column:
    """V6: what is embedded for a concept."""
    return F.trim(F.concat_ws(" ", name, context))
