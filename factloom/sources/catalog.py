"""A catalog stored in buckets of its ids, with lookups, keyset pages and search; S12: corpora as JSON lines and Markdown files.

The catalog is a folder of two tables: rows, in buckets by a hash of the id, and keys (kind, key, id), in buckets by a hash
of the key, through which a row is found by url, DOI or content hash.  A lookup reads one bucket of each, a page reads rows
after its cursor, and a batch of changes rewrites only the buckets it touches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import front_matter

KEYS = ("url", "doi", "content_hash")


def _bucket(column: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column) if isinstance(column, str) else column), F.lit(buckets)).cast("int")


@dataclass
class Catalog:
    """A stored catalog: its folder, number of buckets and the schema of its rows (id and any of url, doi, content_hash among others)."""

    spark: SparkSession
    folder: str
    buckets: int

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def rows(self) -> DataFrame:
        """All rows; a filter on `bucket` prunes folders."""
        return self._table("rows")

    def get(self, *ids: int | str) -> DataFrame:
        """The rows of some ids, from their buckets alone; unknown ids give none."""
        kind = self.rows.schema["id"].dataType
        asked = [r["b"] for r in self.spark.createDataFrame([(i,) for i in ids], "id " + kind.simpleString()).select(_bucket("id", self.buckets).alias("b")).distinct().collect()]
        return self.rows.where(F.col("bucket").isin(asked) & F.col("id").isin(list(ids))).drop("bucket")

    def find(self, asked: DataFrame) -> DataFrame:
        """(row_id, id, how) of rows to be placed (row_id and any of url, doi, content_hash): the first of url, DOI and hash that is known; null if none is.

        Both sides are dealt by kind and key, so however many rows ask for one key they meet a single row of the index.
        """
        keys = [k for k in KEYS if k in asked.columns]
        each = asked.select("row_id", F.explode(F.array(*[F.struct(F.lit(i).alias("order"), F.lit(k).alias("kind"), F.col(k).alias("key")) for i, k in enumerate(keys)])).alias("k")).select("row_id", "k.*").where("key <> ''")
        met = each.withColumn("bucket", _bucket("key", self.buckets)).join(self._table("keys"), ["bucket", "kind", "key"])
        best = met.groupBy("row_id").agg(F.min_by(F.struct("id", F.col("kind").alias("how")), F.struct("order", "id")).alias("b")).select("row_id", "b.id", "b.how")
        return asked.select("row_id").join(best, "row_id", "left")

    def page(self, *order: str, limit: int, after: tuple | None = None, where: Column | None = None) -> DataFrame:
        """Up to `limit` rows in ascending order of the columns, which must tell rows apart and hold no null, after a cursor of their values.

        A page costs the same wherever it lies: rows before the cursor are filtered at the scan, not counted off.
        """
        rows = self.rows.drop("bucket")
        rows = rows if where is None else rows.where(where)
        if after is not None:
            later = F.lit(False)
            for i in reversed(range(len(order))):
                c = F.col(order[i])
                later = (c > F.lit(after[i])) | ((c == F.lit(after[i])) & later)
            rows = rows.where((F.col(order[0]) >= F.lit(after[0])) & later)
        return rows.orderBy(*order).limit(max(0, limit))

    def search(self, text: str, *columns: str) -> Column:
        """A condition for page(): one of the columns contains the text, without regard to case; an empty text fits all."""
        some = F.lit(text == "")
        for c in columns:
            some = some | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
        return some

    def put(self, changes: DataFrame) -> None:
        """Rows by id: new ones are added, known ones replaced, of several with one id that with the smallest text.  Only buckets that are touched are rewritten.

        Buckets are replaced one table after the other, rows first; a run that is repeated after a loss gives the same.
        """
        new = changes.groupBy("id").agg(F.min_by(F.struct(*changes.columns), F.to_json(F.struct(*changes.columns))).alias("r")).select("r.*").withColumn("bucket", _bucket("id", self.buckets)).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        before = self.rows.where(F.col("bucket").isin(touched)).join(new.select("id"), "id", "left_anti").select(*new.columns)
        keys = _keys(new.drop("bucket"), self.buckets)
        old = _keys(self.rows.where(F.col("bucket").isin(touched)).join(new.select("id"), "id", "left_semi").drop("bucket"), self.buckets)
        changed = sorted({r["bucket"] for df in (keys, old) for r in df.select("bucket").distinct().collect()})  # before the rows are written
        _replace(before.unionByName(new), f"{self.folder}/rows", len(touched))
        left = self._table("keys").where(F.col("bucket").isin(changed)).join(new.select("id"), "id", "left_anti").select(*keys.columns)
        empty = self.spark.createDataFrame([("", "", b) for b in changed], "kind string, key string, bucket int")  # a bucket that loses its last key is rewritten too
        empty = empty.select("kind", "key", F.lit(None).cast(keys.schema["id"].dataType).alias("id"), "bucket")
        _replace(left.unionByName(keys).where("key <> ''").unionByName(empty), f"{self.folder}/keys", len(changed))
        new.unpersist()


def _keys(rows: DataFrame, buckets: int) -> DataFrame:
    keys = [k for k in KEYS if k in rows.columns]
    each = rows.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in keys])).alias("k")).select("k.kind", "k.key", "id").where("key <> ''")
    return each.groupBy("kind", "key").agg(F.min("id").alias("id")).withColumn("bucket", _bucket("key", buckets))


def _replace(rows: DataFrame, folder: str, parts: int) -> None:
    """Write the buckets that rows has; others in the folder stay.  What is read of them is computed first."""
    kept = rows.persist()
    kept.count()
    kept.repartition(max(1, parts), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    kept.unpersist()


def store(rows: DataFrame, folder: str, buckets: int = 64) -> Catalog:
    """A new catalog of rows with unique ids; of rows with one url, DOI or content hash the smallest id has the key."""
    rows.withColumn("bucket", _bucket("id", buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{folder}/rows")
    _keys(rows, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "key").write.partitionBy("bucket").parquet(f"{folder}/keys")
    return Catalog(rows.sparkSession, folder, buckets)


def json_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines (value), and the lines that are none, as (value); blank lines count as neither.

    A line whose value does not fit the schema is bad as a whole; missing fields are null.
    """
    parsed = lines.where("trim(value) <> ''").withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("value")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, body) of Markdown files, whole, with what their front matter says; without one the body is the whole text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    body = F.regexp_replace("value", r"(?s)\A---\s*\n.*?\n---[ \t]*\n?", "")
    return files.select("path", front_matter(F.col("value")).alias("meta"), body.alias("body"))
