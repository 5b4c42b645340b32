"""Usage, cost, job and audit rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import in_range, scan

BUCKETS = ("day", "week", "month")


def _sums():
    return [F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens")]


def summary(usage: DataFrame, *by: str, start=None, end=None, repository=None) -> DataFrame:
    """Calls and tokens per key, in the half-open range [start, end)."""
    rows = scan(in_range(usage, "created_at", start, end), repository_id=repository)
    return rows.groupBy(*by).agg(*_sums())


def by_bucket(usage: DataFrame, bucket: str, start=None, end=None, repository=None) -> DataFrame:
    """Per day, week (from Monday) or month and model; any other bucket is an error."""
    if bucket not in BUCKETS:
        raise ValueError(f"bucket must be one of {', '.join(BUCKETS)}")
    rows = scan(in_range(usage, "created_at", start, end), repository_id=repository)
    return rows.groupBy(F.date_trunc(bucket, "created_at").alias("bucket"), "model").agg(*_sums())


def priced(rollup: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each row; prices: (model, input, output) a million tokens; an unknown model costs nothing."""
    cost = F.col("prompt_tokens") / 1e6 * F.coalesce("input", F.lit(0.0)) + F.col("completion_tokens") / 1e6 * F.coalesce("output", F.lit(0.0))
    return rollup.join(prices, "model", "left").withColumn("cost", cost).drop("input", "output")


def total_cost(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.sum("calls").alias("calls"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost").alias("cost"))


def job_states(jobs: DataFrame, *by: str) -> DataFrame:
    """Jobs per (queue, state) or (kind, state)."""
    return jobs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def audit_events(audit: DataFrame, action: str | None = None, actor=None, obj: str | None = None, start=None, end=None) -> DataFrame:
    """The closed range [start, end]."""
    return scan(in_range(audit, "occurred_at", start, end, closed=True), action=action, actor=actor, object=obj)


def audit_actions(audit: DataFrame) -> DataFrame:
    return audit.select("action").distinct()


def audit_expired(audit: DataFrame, before) -> DataFrame:
    """What is left after events older than `before` are deleted."""
    return audit.where(F.col("occurred_at") >= F.lit(before))
