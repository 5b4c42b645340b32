"""What fetch attempts say about hosts and providers.

Host statistics count sources with at least one matching attempt, not attempts; a source may count as failure and as
success.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statistics(attempts: DataFrame, *by: str) -> DataFrame:
    """Per key: sources seen, with a success, with a failure.  attempts: (source_id, provider, host, success)."""
    per = attempts.groupBy(*by, "source_id").agg(F.bool_or("success").alias("ok"), F.bool_or(~F.col("success")).alias("bad"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("successes"), F.count_if("bad").alias("failures"))


def failing(attempts: DataFrame, provider: str, minimum: int) -> DataFrame:
    """Hosts with at least `minimum` sources that this provider failed on."""
    return statistics(attempts.where(F.col("provider") == provider), "host").where(F.col("failures") >= minimum)


def by_provider(attempts: DataFrame, providers: list[str]) -> DataFrame:
    """Per provider of the list and host; providers without an attempt do not show."""
    return statistics(attempts.where(F.col("provider").isin(providers)), "provider", "host")


def percentages(stats: DataFrame) -> DataFrame:
    """Failures and successes in percent of total, to one digit; null for no sources."""
    share = lambda c: F.round(F.try_divide(F.lit(100.0) * F.col(c), F.col("total")), 1)
    return stats.withColumns({"fail_pct": share("failures"), "success_pct": share("successes")})


def learn_skips(stats: DataFrame, skips: DataFrame, as_of: str, minimum: int = 100, threshold: float = 0.85, hours: int = 24) -> DataFrame:
    """The new skip table (host, provider, failure_rate, sample_size, expires_at, manual).

    A host with enough sources and a failure rate at the threshold or above is skipped for some hours; one with a
    success and a lower rate loses what was learned.  What was set by hand stays.
    """
    rate = F.col("failures") / F.col("total")
    learned = stats.where((F.col("total") >= minimum) & (rate >= threshold)).select(
        "host", "provider", rate.alias("failure_rate"), F.col("total").alias("sample_size"),
        (F.lit(as_of).cast("timestamp") + F.make_interval(hours=F.lit(hours))).alias("expires_at"), F.lit(False).alias("manual"),
    )
    freed = stats.where((F.col("successes") > 0) & (rate < threshold)).select("host", "provider")
    manual = skips.where("manual")
    kept = skips.where("not manual").join(freed, ["host", "provider"], "left_anti").join(learned, ["host", "provider"], "left_anti")
    return manual.unionByName(kept).unionByName(learned.join(manual, ["host", "provider"], "left_anti"))


def active_skips(skips: DataFrame, as_of: str) -> DataFrame:
    return skips.where(F.col("manual") | (F.col("expires_at") > F.lit(as_of).cast("timestamp")))


def provider_chain(hosts: DataFrame, order: list[str], skips: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """Per host its providers: the pinned one first, the others in order, skipped ones left out."""
    skipped = skips.groupBy("host").agg(F.collect_set("provider").alias("skipped"))
    rows = hosts.select("host").distinct().join(skipped, "host", "left")
    rows = rows.join(pinned.select("host", F.col("provider").alias("pin")), "host", "left") if pinned is not None else rows.withColumn("pin", F.lit(None).cast("string"))
    chain = F.array_distinct(F.array_compact(F.concat(F.array("pin"), F.array(*[F.lit(p) for p in order]))))
    return rows.select("host", F.array_except(chain, F.coalesce("skipped", F.array().cast("array<string>"))).alias("providers"))
