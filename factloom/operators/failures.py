"""Stages in which a row may fail, and the account of what failed per source."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(run: Callable, kind: str) -> Callable[..., Column]:
    """A row function as a column function that gives struct<value, error> and never fails the job: error is the exception's text, null on success.

    Rows come in Arrow batches; one row's failure leaves the others of its batch alone.
    """

    @F.pandas_udf(f"value {kind}, error string")
    def attempt(*columns: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for row in zip(*columns, strict=True):
            try:
                values.append(run(*row))
                errors.append(None)
            except Exception as error:  # noqa: BLE001 - whatever it is, it is this row's result
                values.append(None)
                errors.append(f"{type(error).__name__}: {error}")
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    return attempt


def chunk_account(chunks: DataFrame, as_of: str) -> DataFrame:
    """Per source of (source_id, type, index, error, attempts): chunk_failures, chunk_errors (JSON array in order, null without one), first_error, last_chunk_failure_at.

    A source without a failed chunk is there with 0 and nulls: applying the account clears what an earlier run left.
    """
    failed = F.col("error").isNotNull()
    errors = F.array_sort(F.collect_list(F.when(failed, F.struct(F.col("index").cast("long").alias("index"), "type", "error", F.col("attempts").cast("long").alias("attempts")))))
    per = chunks.groupBy("source_id").agg(F.count_if(failed).alias("chunk_failures"), errors.alias("e"))
    some = F.col("chunk_failures") > 0
    return per.select(
        "source_id", "chunk_failures", F.when(some, F.to_json("e")).alias("chunk_errors"), F.when(some, F.col("e")[0]["error"]).alias("first_error"),
        F.when(some, F.lit(as_of).cast("timestamp")).alias("last_chunk_failure_at"),
    )


def apply_account(sources: DataFrame, account: DataFrame) -> DataFrame:
    """sources (source_id, status, chunk_failures, chunk_errors, last_chunk_failure_at) after a run.

    A source of the account gets its figures; it becomes `processed` only if it has no failure left and was `fetched`.
    Sources that the run did not touch stay as they are.
    """
    new = account.select("source_id", F.lit(True).alias("_ran"), *[F.col(c).alias(f"_{c}") for c in ("chunk_failures", "chunk_errors", "last_chunk_failure_at")])
    rows = sources.join(new, "source_id", "left")
    ran = F.coalesce("_ran", F.lit(False))
    status = F.when(ran & (F.col("_chunk_failures") == 0) & (F.col("status") == "fetched"), "processed").otherwise(F.col("status"))
    kept = {c: F.when(ran, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("chunk_failures", "chunk_errors", "last_chunk_failure_at")}
    return rows.withColumns({"status": status, **kept}).select(*sources.columns)
