"""Micro-batches leave the same tables as one pass over all rows."""

import datetime

from pyspark.sql import functions as F

from factloom.operators import concepts
from factloom.streaming.incremental import keep_concepts, keep_relations, keep_sums, keep_upserted, version, windowed_usage


def test_batches_upsert_the_newest_rows(spark, tmp_path):
    folder, shape = f"file://{tmp_path}", "k int, at int, v string"
    one = [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    two = [(2, 5, "d"), (2, 4, "e"), (3, 1, None)]
    for part in (one, two):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(shape).parquet(f"{folder}/in")
        keep_upserted(stream, f"{folder}/out", ["k"], F.desc("at"), checkpoint=f"{folder}/state").awaitTermination(120)
    got = sorted(tuple(r) for r in version(spark, f"{folder}/out", 1).select("k", "at", "v").collect())
    assert got == [(1, 2, "b"), (2, 5, "d"), (3, 1, None)]
    assert version(spark, f"{folder}/out", 0).count() == 2


def test_windows_of_usage(spark, tmp_path):
    folder, shape = f"file://{tmp_path}", "created_at timestamp, model string, prompt_tokens long, completion_tokens long"
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    spark.createDataFrame([(day(1), "m", 1, 2), (day(1, 5), "m", 3, 4), (day(2), "n", 5, 6), (day(4), "n", 0, 0)], shape).write.parquet(f"{folder}/in")
    rollup = windowed_usage(spark.readStream.schema(shape).parquet(f"{folder}/in"))
    query = rollup.writeStream.format("memory").queryName("usage_windows").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.bucket, r.model, r.calls, r.prompt_tokens, r.completion_tokens) for r in spark.table("usage_windows").collect())
    assert got == [(day(1), "m", 2, 4, 6), (day(2), "n", 1, 5, 6)]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    folder, shape = f"file://{tmp_path}", "k int, at int"
    for n, part in enumerate(([(k, 1) for k in range(300)], [(5, 2)], [(5, 3), (1000, 3)])):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        keep_upserted(spark.readStream.schema(shape).parquet(f"{folder}/in"), f"{folder}/out", ["k"], F.desc("at"), checkpoint=f"{folder}/state", buckets=16).awaitTermination(120)
        written = sorted(p.name for p in (tmp_path / "out" / "data" / f"version={n}").glob("bucket=*"))
        assert len(written) == (16 if n == 0 else 1 if n == 1 else len(written)) and len(written) <= 16
        if n == 0:
            files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "data" / "version=0").rglob("*.parquet")}
    assert files == {p: p.stat().st_mtime_ns for p in files} and len(written) <= 2
    got = {r["k"]: r["at"] for r in version(spark, f"{folder}/out", 2).collect()}
    assert got == {k: 1 for k in range(300)} | {5: 3, 1000: 3}
    assert {r["k"]: r["at"] for r in version(spark, f"{folder}/out", 1).collect()} == {k: 1 for k in range(300)} | {5: 2}


def test_relations_and_concepts_by_deltas(spark, tmp_path):
    folder, shape = f"file://{tmp_path}", "fact_id int, name string, context string"
    batches = [[(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (2, "b", "y")], [(3, "a", "x"), (3, "b", "x"), (3, "c", "x")], [(4, "c", "z")]]
    for part in batches:
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for kept, name in ((keep_relations, "pairs"), (keep_concepts, "concepts")):
            kept(spark.readStream.schema(shape).parquet(f"{folder}/in"), f"{folder}/{name}", checkpoint=f"{folder}/{name}-state").awaitTermination(120)
    whole = spark.createDataFrame([r for part in batches for r in part], shape)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(version(spark, f"{folder}/pairs", 2).select("name_a", "name_b", "weight")) == rows(concepts.relations(whole))
    assert rows(version(spark, f"{folder}/concepts", 2).select("name", "context", "fact_count")) == rows(concepts.concepts_of(whole).select("name", "context", "fact_count"))


def test_sums_that_become_zero_go(spark, tmp_path):
    folder, shape = f"file://{tmp_path}", "k string, n long"
    for part in ([("a", 2), ("b", 1)], [("a", -2)]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        keep_sums(spark.readStream.schema(shape).parquet(f"{folder}/in"), f"{folder}/out", ["k"], ["n"], lambda b: b, checkpoint=f"{folder}/state").awaitTermination(120)
    assert [tuple(r) for r in version(spark, f"{folder}/out", 1).collect()] == [("b", 1)]


def test_relations_of_a_fact_with_many_names(spark):
    links = spark.createDataFrame([(1, f"n{i:03}") for i in range(23)] + [(2, "n001"), (2, "n004"), (3, "n000")], "fact_id int, name string")
    rows = lambda block: sorted(map(tuple, concepts.relations(links, block=block).collect()))
    want = sorted((f"n{i:03}", f"n{j:03}", 2 if (i, j) == (1, 4) else 1) for i in range(23) for j in range(i + 1, 23))
    assert rows(5) == rows(1) == rows(256) == want
