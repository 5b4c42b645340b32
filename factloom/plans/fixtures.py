"""The domain tables, derived from the flat test tables by the same rules in Spark and in SQL.

facts: sentences of documents; concepts: long words of a fact with the document's language as context; a repository is a
document's source; usage and fetch attempts come from events; reports from conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazily derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read(self.spark, self.dir, name)

    @property
    def sources(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(F.col("doc_id").alias("source_id"), F.col("source").alias("repository_id"), "lang", "text", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"))

    @property
    def facts(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", r"[.!?]\s+")).alias("sidx", "raw"))
        d = d.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("sidx").cast("string")).alias("fact_id"), F.col("doc_id").alias("source_id"), F.col("source").alias("repository_id"), "lang", "sidx", F.trim("raw").alias("text"))
        return d.where(F.length("text") >= 10)

    @property
    def fact_concepts(self) -> DataFrame:
        words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{7,})"), 1))
        return self.facts.select("fact_id", "source_id", "repository_id", F.col("lang").alias("context"), F.explode(words).alias("name"))

    @property
    def usage(self) -> DataFrame:
        """Calls: model, provider, operation, tokens, source and time."""
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("id"), F.col("event_type").alias("model"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"),
            F.concat(F.lit("op"), (F.col("event_id") % 4).cast("string")).alias("operation"), (F.col("user_id") % 7).alias("repository_id"), F.col("user_id").alias("source_id"),
            (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 77).alias("completion_tokens"), F.col("ts").alias("created_at"),
        )

    @property
    def attempts(self) -> DataFrame:
        """Fetch attempts: one source per user, its host, provider and success."""
        e = self.raw("events")
        return e.select(
            F.col("user_id").alias("source_id"), F.concat(F.lit("h"), (F.col("user_id") % 13).cast("string"), F.lit(".example.com")).alias("host"),
            F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("provider"), (F.col("event_type") != "error").alias("success"), "ts",
        )

    @property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

    @property
    def orders_parts(self) -> DataFrame:
        """A second co-occurrence graph with integers: orders as facts, parts as names."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("name")).distinct()

    @property
    def order_suppliers(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_suppkey").alias("name")).distinct()

    @property
    def audit(self) -> DataFrame:
        e = self.raw("events")
        return e.select(F.col("event_id").alias("id"), F.col("ts").alias("occurred_at"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.get_json_object("props", "$.k").alias("object"))

    @property
    def reports(self) -> DataFrame:
        c = self.raw("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
        return c.select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") > 0, F.floor(F.col("conv_id") / 2)).cast("long").alias("parent_id"), "body")


#: The same tables as common table expressions for DuckDB.
SQL = {
    "facts": r"""facts AS (SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(i - 1 AS VARCHAR) AS fact_id, doc_id AS source_id, source AS repository_id, lang, i - 1 AS sidx, trim(raw) AS text
      FROM (SELECT doc_id, source, lang, unnest(p) AS raw, generate_subscripts(p, 1) AS i FROM (SELECT *, regexp_split_to_array(text, '[.!?]\s+') AS p FROM documents)) WHERE length(trim(raw)) >= 10)""",
    "fact_concepts": """fact_concepts AS (SELECT fact_id, source_id, repository_id, lang AS context, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}'))) AS name FROM facts)""",
    "usage": """usage AS (SELECT event_id AS id, event_type AS model, 'p' || (user_id % 3) AS provider, 'op' || (event_id % 4) AS operation, user_id % 7 AS repository_id, user_id AS source_id,
      event_id % 1000 AS prompt_tokens, event_id % 77 AS completion_tokens, ts AS created_at FROM events)""",
    "attempts": """attempts AS (SELECT user_id AS source_id, 'h' || (user_id % 13) || '.example.com' AS host, 'p' || (event_id % 3) AS provider, event_type <> 'error' AS success, ts FROM events)""",
    "vectors": """vectors AS (SELECT vec_id AS id, embedding, label FROM embeddings)""",
    "op": """op AS (SELECT DISTINCT l_orderkey AS fact_id, l_partkey AS name FROM lineitem)""",
    "os": """os AS (SELECT DISTINCT l_orderkey AS fact_id, l_suppkey AS name FROM lineitem)""",
    "sources": """sources AS (SELECT doc_id AS source_id, source AS repository_id, lang, text, 'https://' || source || '.example.org/' || doc_id AS url FROM documents)""",
    "audit": """audit AS (SELECT event_id AS id, ts AS occurred_at, user_id AS actor, event_type AS action, json_extract_string(props, '$.k') AS object FROM events)""",
}


def with_tables(*names: str) -> str:
    """A WITH clause for these tables and those they stand on."""
    order = ["sources", "facts", "fact_concepts", "usage", "attempts", "vectors", "op", "os", "audit"]
    wanted = set(names) | ({"facts"} if "fact_concepts" in names else set())
    return "WITH " + ",\n".join(SQL[n] for n in order if n in wanted) + "\n"
