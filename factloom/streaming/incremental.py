"""2.11: stored tables and rollups kept up to date by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import concepts, relational


BUCKETS = 64
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, folder: str, number: int) -> dict[int, int]:
    """Which version each bucket is at after micro-batch `number`: a row a bucket."""
    rows = spark.read.schema("bucket int, version long").parquet(f"{folder}/manifest/version={number}").select("bucket", "version").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _files(folder: str, at: dict[int, int]) -> list[str]:
    return [f"{folder}/data/version={v}/bucket={b}" for b, v in sorted(at.items())]


def version(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The table as micro-batch `number` left it; without a row before the first one came."""
    schema = spark.read.parquet(f"{folder}/schema").schema
    paths = _files(folder, _manifest(spark, folder, number))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def keep(stream: DataFrame, folder: str, keys: list[str], prepare: Callable[[DataFrame], DataFrame], merge: Merge, *, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """A stored table kept by micro-batches, in buckets of its keys: a batch rewrites only the buckets that its rows fall in.

    prepare makes rows of the table's kind from a batch; merge(old, new) makes the new content of the touched buckets
    (old is None for the first batch) and must keep each row in its bucket.  Batch N reads the buckets as batch N - 1 left
    them and writes its own version of those it touches and a manifest of all; a batch that runs again writes the same
    again, so no row counts twice however often a batch is lost.  folder and checkpoint lie where driver and executors see
    them; files that no manifest of the last two names are free to delete.  Stops when the input that is there has been read.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = prepare(batch).withColumn("bucket", _bucket(keys, buckets)).persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
            at = _manifest(spark, folder, number - 1) if number else {}
            before = {b: at[b] for b in touched if b in at}
            plain = new.drop("bucket")
            old = spark.read.schema(plain.schema).parquet(*_files(folder, before)) if before else None
            rows = merge(old, plain).select(*plain.columns).withColumn("bucket", _bucket(keys, buckets))
            rows.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={number}")
            if not number:
                plain.limit(0).write.mode("overwrite").parquet(f"{folder}/schema")
            left = spark.read.schema(rows.schema).parquet(f"{folder}/data/version={number}").select("bucket").distinct().collect() if touched else []
            now = {b: v for b, v in at.items() if b not in touched} | {r["bucket"]: number for r in left}
            spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={number}")
        finally:
            new.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_upserted(stream: DataFrame, folder: str, keys: list[str], *newest: Column, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """keep() of rows of which the newest batch's replace those with the same keys, of each key the first in the order `newest`."""
    merge = lambda old, new: new if old is None else relational.upsert(old, new, keys)
    return keep(stream, folder, keys, lambda batch: relational.latest(batch, keys, *newest), merge, checkpoint=checkpoint, buckets=buckets)


def keep_sums(stream: DataFrame, folder: str, keys: list[str], sums: list[str], prepare: Callable[[DataFrame], DataFrame], *, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """keep() of counts by key, to which each batch adds its own (negative ones take off); a key whose sums are all 0 goes."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new if old is None else old.unionByName(new)
        total = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        return total.where(" or ".join(f"`{c}` <> 0" for c in sums))

    return keep(stream, folder, keys, prepare, merge, checkpoint=checkpoint, buckets=buckets)


def keep_relations(links: DataFrame, folder: str, *, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Relation weights by deltas from a stream of links (fact_id, name); all links of a fact come in one batch, once."""
    return keep_sums(links, folder, ["name_a", "name_b"], ["weight"], concepts.relations, checkpoint=checkpoint, buckets=buckets)


def keep_concepts(links: DataFrame, folder: str, *, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Facts per name and context by deltas from a stream of links (fact_id, name, context); groups follow by name."""
    count = lambda batch: batch.groupBy("name", "context").agg(F.count(F.lit(1)).alias("fact_count"))
    return keep_sums(links, folder, ["name", "context"], ["fact_count"], count, checkpoint=checkpoint, buckets=buckets)


def windowed_usage(usage: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """A2 over a stream: calls and tokens per window of time and model.

    Rows later than `late` behind the newest are dropped once their window is closed, so the state stays bounded.
    """
    per = usage.withWatermark("created_at", late).groupBy(F.window("created_at", width).alias("bucket"), "model")
    sums = per.agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return sums.withColumn("bucket", F.col("bucket.start"))
