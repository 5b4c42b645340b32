"""The bootstrap interval against the one that theory gives."""

import math

import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluate


@pytest.mark.parametrize("kind", ["share", "few", "spread"])
def test_interval_of_the_mean(spark, kind):
    if kind == "share":  # many rows of two values
        rows, mean, sd, n = spark.range(10_000).select("id", (F.col("id") % 10 < 3).cast("int").alias("v")), 0.3, math.sqrt(0.21), 10_000
    elif kind == "few":  # under 64 rows of each value
        rows, mean, sd, n = spark.range(100).select("id", (F.col("id") % 2).alias("v")), 0.5, 0.5, 100
    else:  # every row its own value
        rows, mean, sd, n = spark.range(400).select("id", F.col("id").cast("double").alias("v")), 199.5, 400 / math.sqrt(12), 400
    got = evaluate.bootstrap_poisson(rows, "v").first()
    half = 1.96 * sd / math.sqrt(n)
    assert abs(got["lo"] - (mean - half)) < 0.15 * half and abs(got["hi"] - (mean + half)) < 0.15 * half


def test_without_rows(spark):
    got = evaluate.bootstrap_poisson(spark.createDataFrame([(1, None)], "id int, v double"), "v", resamples=50).first()
    assert got["lo"] is None and got["hi"] is None
