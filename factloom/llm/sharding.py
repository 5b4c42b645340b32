"""Sharding by a two-pass external shuffle, with DataFrame functions alone.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash, one partition a bucket.  Pass two
shuffles each bucket (Spark's seeded shuffle() is a Fisher-Yates pass over the bucket's array, which is sorted before)
and deals the resulting global order to the shards like cards: position p goes to shard p mod n as its record p div n,
so counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LAW = "rows"


def record_size(text: Column) -> Column:
    """UTF-8 bytes and one more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _starts(counts: DataFrame, chunk: int = 4096) -> DataFrame:
    """(bucket, start): how many records come before each bucket, by running sums within chunks of buckets and over the chunks."""
    part = F.floor(F.col("bucket") / chunk)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    chunks = counts.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("part", part).withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return own.join(chunks, "part").select("bucket", (F.col("base") + F.col("own")).alias("start"))


def shuffled(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, bucket_bytes: int = 16 << 20, bucket_rows: int = 16_384, seed: int = 20_177) -> DataFrame:
    """df with `shard` and `slot`; every row of df comes out once, with all its columns.

    A row's bucket follows from its key and text, so neither equal texts nor rows without a key meet in one bucket;
    where so many rows repeat key and text that they would swell one, these are dealt on by their place in the input.
    Buckets are sized by both bytes and rows from one aggregate over df.  A bucket is sorted by key, text hash and the
    other columns before its shuffle, which is seeded by its partition, so neither a lost executor, nor the input's
    order or the session's number of shuffle partitions changes the result (only rows alike in key and text can swap).
    An empty df gives an empty result; columns named shard or slot in df are replaced; null keys and texts are ordinary
    values; columns of map type cannot be sorted and are refused by Spark.
    """
    df = df.drop("shard", "slot")
    names = [f"_{i}" for i in range(len(df.columns))]
    back = [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)]
    own_key, own_text = (F.col(names[df.columns.index(c)]) for c in (key, text))
    rows = df.toDF(*names).withColumn("h", F.xxhash64(F.lit(seed), own_key, own_text))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(record_size(own_text)).alias("bytes")).first()
    buckets = max(1, math.ceil((total["bytes"] or 0) / bucket_bytes), math.ceil(total["n"] / bucket_rows))
    hot = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(2, bucket_rows // 16)).select("h", F.lit(True).alias("hot"))
    number = hot.count()
    if number:  # of n rows at most 16 n / bucket_rows are hot hashes
        hot = F.broadcast(hot) if number <= 1_000_000 else hot
        again = F.xxhash64(F.lit(seed), "h", F.monotonically_increasing_id())
        rows = rows.withColumn("again", again).join(hot, "h", "left").withColumn("h", F.when(F.col("hot"), F.col("again")).otherwise(F.col("h"))).drop("hot", "again")
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    starts = _starts(cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))))  # one row per bucket, read twice
    record = F.struct(own_key.alias("key"), F.xxhash64(own_text).alias("order"), F.struct(*names).alias("row"))
    dealt = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.collect_list(record).alias("records"))
    # one bucket a partition; sorted all the same, as the random numbers go on within a partition
    drawn = dealt.sortWithinPartitions("bucket").select("bucket", F.shuffle(F.sort_array("records"), seed).alias("records"))
    at = F.col("start") + F.col("pos")
    return (
        drawn.join(starts, "bucket")
        .select("start", F.posexplode("records").alias("pos", "record"))
        .select("start", "pos", "record.row.*")
        .select(*back, (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))
    )


def write_shards(df: DataFrame, path: str, files_per_shard: int = 1, **how) -> None:
    """Write the shards of df as one folder each, in slot order within each file; an empty df writes none.  Options are those of shuffled()."""
    out = shuffled(df, **how)
    n = how.get("shards", 8) * files_per_shard
    out.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(df: DataFrame, shards: int = 8, **how) -> DataFrame:
    """Per record of the shuffled table: doc_id, size, text_crc32, law, shard, slot and grown_shard (null: rows is the law)."""
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")).cast("long")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shuffled(rows, shards=shards, **how).select(
        "doc_id", record_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
