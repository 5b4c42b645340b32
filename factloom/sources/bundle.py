"""Graph bundles (interchange JSON, version 2), content hashes, admission and push rules.

A bundle is a folder of JSON lines, one per section, or one JSON document; ids are dense indexes within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 2


def fact_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def source_hash(url: Column, text: Column, markdown: Column, title: Column) -> Column:
    """S11"""
    return F.sha2(F.concat(*[F.coalesce(c, F.lit("")) for c in (url, text, markdown, title)]), 256)


def dense(df: DataFrame, key: str, idx: str) -> DataFrame:
    """Df with an index from 0 in the order of its key.

    Rows are range-partitioned by the key; each partition numbers its own, and only the partitions' counts are summed.
    """
    ordered = df.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    within = ordered.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    counts = within.groupBy("_part").agg(F.max("_n").alias("_c"))
    before = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return within.join(before, "_part").withColumn(idx, (F.col("_b") + F.col("_n") - 1).cast("long")).drop("_part", "_n", "_b")


def export(tables: dict[str, DataFrame], path: str) -> None:
    """Sources, facts, fact_sources, concepts, fact_concepts as sections with dense indexes.

    sources (source_id, url, text, title), facts (fact_id, text), fact_sources (fact_id, source_id), concepts
    (concept_id, name, context), fact_concepts (fact_id, concept_id).
    """
    ids = {"sources": "source_id", "facts": "fact_id", "concepts": "concept_id"}
    numbered = {name: dense(tables[name], key, "idx") for name, key in ids.items()}
    maps = {name: numbered[name].select(key, F.col("idx").alias(f"{name}_idx")) for name, key in ids.items()}
    out = {name: df.drop(ids[name]) for name, df in numbered.items()}
    out["facts"] = out["facts"].withColumn("content_hash", fact_hash(F.col("text")))
    out["fact_sources"] = tables["fact_sources"].join(maps["facts"], "fact_id").join(maps["sources"], "source_id").select("facts_idx", "sources_idx")
    out["fact_concepts"] = tables["fact_concepts"].join(maps["facts"], "fact_id").join(maps["concepts"], "concept_id").select("facts_idx", "concepts_idx")
    for name, df in out.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
    spark = tables["facts"].sparkSession
    spark.createDataFrame([(VERSION,)], "schema_version int").coalesce(1).write.mode("overwrite").json(f"{path}/header")


SCHEMAS = {
    "header": "schema_version int",
    "sources": "idx long, url string, text string, title string",
    "facts": "idx long, text string, content_hash string",
    "concepts": "idx long, name string, context string",
    "fact_sources": "facts_idx long, sources_idx long",
    "fact_concepts": "facts_idx long, concepts_idx long",
}


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sections of a bundle; a newer version is an error."""
    version = spark.read.schema(SCHEMAS["header"]).json(f"{path}/header").first()["schema_version"]
    if version > VERSION:
        raise ValueError(f"bundle version {version} is newer than {VERSION}")
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in SCHEMAS.items() if name != "header"}


def import_bundle(tables: dict[str, DataFrame], bundle: dict[str, DataFrame], tag: str, existing: bool = True) -> dict[str, DataFrame]:
    """The tables with a bundle's rows.

    Fresh ids are `tag` and the index.  With existing, a source of a known url, a fact of a known text and a concept of
    a known (name, context) are the known ones; junctions that are there already are left alone.
    """

    def resolve(name: str, key: str, match: list[Column], names: list[str]) -> tuple[DataFrame, DataFrame]:
        rows = bundle[name].withColumn("_fresh", F.concat(F.lit(f"{tag}-{name}-"), F.col("idx").cast("string")))
        for n, c in zip(names, match, strict=True):
            rows = rows.withColumn(n, c)
        if not existing:
            ids = rows.select("idx", F.col("_fresh").alias(key), F.lit(True).alias("_new"))
        else:
            own = tables[name]
            for n, c in zip(names, match, strict=True):
                own = own.withColumn(n, c)
            known = own.groupBy(*names).agg(F.min(key).alias("_known"))
            first = rows.groupBy(*names).agg(F.min("_fresh").alias("_first"))
            joined = rows.join(known, names, "left").join(first, names)
            ids = joined.select("idx", F.coalesce("_known", "_first").alias(key), (F.col("_known").isNull() & (F.col("_first") == F.col("_fresh"))).alias("_new"))
        fresh = rows.drop("_fresh", *names).join(ids.where("_new").select("idx", key), "idx").drop("idx")
        return ids.select("idx", key), tables[name].unionByName(fresh.select(*[c for c in fresh.columns if c in tables[name].columns]), allowMissingColumns=True)

    s_ids, sources = resolve("sources", "source_id", [F.col("url")], ["_u"])
    f_ids, facts = resolve("facts", "fact_id", [fact_hash(F.col("text"))], ["_h"])
    c_ids, concepts = resolve("concepts", "concept_id", [F.lower("name"), F.lower("context")], ["_n", "_c"])
    f, s, c = (ids.withColumnRenamed("idx", n) for ids, n in ((f_ids, "facts_idx"), (s_ids, "sources_idx"), (c_ids, "concepts_idx")))
    fs = bundle["fact_sources"].join(f, "facts_idx").join(s, "sources_idx").select("fact_id", "source_id").distinct()
    fc = bundle["fact_concepts"].join(f, "facts_idx").join(c, "concepts_idx").select("fact_id", "concept_id").distinct()
    more = lambda old, new, key: old.unionByName(new.join(old.select(*key), key, "left_anti"), allowMissingColumns=True)
    return {
        "sources": sources, "facts": facts, "concepts": concepts,
        "fact_sources": more(tables["fact_sources"], fs, ["fact_id", "source_id"]), "fact_concepts": more(tables["fact_concepts"], fc, ["fact_id", "concept_id"]),
    }


def remap_covered(summaries: DataFrame, ids: DataFrame) -> DataFrame:
    """Covered ids by their new ones (idx, id); what cannot be resolved goes."""
    rows = summaries.select("summary_id", F.posexplode("covered").alias("pos", "idx")).join(ids, "idx")
    kept = rows.groupBy("summary_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("covered"))
    return summaries.drop("covered").join(kept, "summary_id", "left")


def push_match(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """(row_id, source_id, how) of each row by url, else doi, else content hash."""
    out = rows.select("row_id", "url", "doi", "content_hash")
    for column in ("url", "doi", "content_hash"):
        known = catalog.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.min("source_id").alias(f"by_{column}"))
        out = out.join(known, column, "left")
    how = F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_content_hash").isNotNull(), "hash")
    return out.select("row_id", F.coalesce("by_url", "by_doi", "by_content_hash").alias("source_id"), how.alias("how"))


def reconcile_plan(new_rows: Column, model: Column, dim: Column, own_model: str, own_dim: int) -> Column:
    """T39"""
    return F.when(new_rows == 0, "nothing").when((model != own_model) | (dim != own_dim), "reembed").otherwise("dedup")


def sync_level(bundle: dict[str, DataFrame], level: str) -> dict[str, DataFrame]:
    """At level `facts` concepts and their links are emptied."""
    return {n: df.limit(0) if level == "facts" and n in ("concepts", "fact_concepts") else df for n, df in bundle.items()}


def sync_vectors(embeddings: Column, level: str) -> Column:
    """T40 on the map of vectors: only `fact:` keys stay at level `facts`."""
    return F.map_filter(embeddings, lambda k, _: k.startswith("fact:")) if level == "facts" else embeddings


def admitted(rows: DataFrame, column: str, allowed: list[str] | None, default: str | None = None) -> DataFrame:
    """P20: `*` admits all, an empty list none; a row without a hash is always admitted; the default is allowed, too."""
    value = F.coalesce(F.col(column), F.lit(""))
    if allowed is None or "*" in allowed:
        return rows
    names = [*allowed, *([default] if default else [])]
    return rows.where((value == "") | (value.isin(names) if names else F.lit(False)))
