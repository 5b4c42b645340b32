"""Queries of stages that create and account: direct routing, partial failures, label clusters, tree and sequence checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import clustering, concepts, dedup, failures, graph, relational, summaries
from ..sources import catalog, pages
from .fixtures import Tables
from .queries import _NEAR, NAME_A, NEAR, ORACLES, query

_KEY = """md5('{"repository_id":"r","context_key":"' || lower(context) || '","key":"' || lower(name) || '"}')"""


def _routed(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts with names of even length are known; each mention brings the first three letters and an empty text as seed aliases."""
    links = t.fact_concepts
    known = concepts.concepts_of(links).where("length(name) % 2 = 0").withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("repository_id", F.lit("r"))
    names = concepts.named_concepts(known, t.spark.createDataFrame([], "concept_id string, alias string"))
    mentions = links.select("fact_id", F.lit("r").alias("repository_id"), "context", F.col("name").alias("mention"), F.array(F.substring("name", 1, 3), F.lit("")).alias("seeds"))
    none = t.spark.createDataFrame([], "concept_id string, embedding array<float>")
    return concepts.route_direct(mentions, names, none, none.withColumnRenamed("concept_id", "fact_id"))


@query("fact_concepts", sql=f"SELECT DISTINCT fact_id, CASE WHEN length(name) % 2 = 0 THEN name || '|' || context ELSE {_KEY} END AS concept_id, length(name) % 2 <> 0 AS created FROM fact_concepts")
def t15_direct_links(t: Tables) -> DataFrame:
    return _routed(t)[0]


@query("fact_concepts", sql=f"SELECT DISTINCT {_KEY} AS concept_id, 'r' AS repository_id, context, name FROM fact_concepts WHERE length(name) % 2 <> 0")
def t15_created_concepts(t: Tables) -> DataFrame:
    return _routed(t)[1]


@query("fact_concepts", sql=f"SELECT DISTINCT CASE WHEN length(name) % 2 = 0 THEN name || '|' || context ELSE {_KEY} END AS concept_id, unnest(CASE WHEN length(name) % 2 = 0 THEN [name[1:3]] ELSE [name[1:3], name] END) AS alias FROM fact_concepts")
def t15_merged_aliases(t: Tables) -> DataFrame:
    return _routed(t)[2]


def _balanced(part: str) -> int:
    if part.count("<") != part.count(">"):
        raise ValueError("unbalanced")
    return part.count("<")


_PARTS = "parts AS (SELECT page_id, i, p, length(replace(p, '>', '')) <> length(replace(p, '<', '')) AS failed FROM (SELECT page_id, i, substr(html, i * 1000 + 1, 1000) AS p FROM (SELECT page_id, html, unnest(range(0, CAST(ceil(length(html) / 1000.0) AS BIGINT))) AS i FROM pages)))"


@query(
    sql=f"""WITH {_PARTS} SELECT page_id AS source_id, count(*) FILTER (failed) AS chunk_failures, CASE WHEN count(*) FILTER (failed) > 0 THEN 'ValueError: unbalanced' END AS first_error,
CASE WHEN count(*) FILTER (failed) > 0 THEN '[' || string_agg('{{"index":' || i || ',"type":"text","error":"ValueError: unbalanced","attempts":' || (i % 3 + 1) || '}}', ',' ORDER BY i) FILTER (failed) || ']' END AS chunk_errors FROM parts GROUP BY page_id"""
)
def t45_chunk_failures(t: Tables) -> DataFrame:
    """Parts of pages, of which those fail that cut a tag in two; the others' results stand."""
    parts = t.raw("pages").select(F.col("page_id").alias("source_id"), F.posexplode(tx.hard_split(F.col("html"), 1000)).alias("index", "part"))
    tried = parts.withColumn("r", failures.guarded(_balanced, "long")(F.col("part")))
    chunks = tried.select("source_id", F.lit("text").alias("type"), "index", "r.error", (F.col("index") % 3 + 1).alias("attempts"))
    return failures.chunk_account(chunks, "2024-01-01").drop("last_chunk_failure_at")


@query(
    sql=f"""WITH {_PARTS}, a AS (SELECT page_id, count(*) FILTER (failed) AS n FROM parts WHERE page_id % 3 <> 0 GROUP BY 1)
SELECT page_id AS source_id, CASE WHEN n = 0 THEN 'processed' ELSE 'fetched' END AS status, coalesce(n, 9) AS chunk_failures FROM pages LEFT JOIN a USING (page_id)"""
)
def t45_sources_after_run(t: Tables) -> DataFrame:
    """Two of three sources run again: those without a failure are processed, the others keep or get their figures."""
    parts = t.raw("pages").where("page_id % 3 <> 0").select(F.col("page_id").alias("source_id"), F.posexplode(tx.hard_split(F.col("html"), 1000)).alias("index", "part"))
    tried = parts.withColumn("r", failures.guarded(_balanced, "long")(F.col("part")))
    account = failures.chunk_account(tried.select("source_id", F.lit("text").alias("type"), "index", "r.error", F.lit(1).alias("attempts")), "2024-01-01")
    before = t.raw("pages").select(F.col("page_id").alias("source_id"), F.lit("fetched").alias("status"), F.lit(9).cast("long").alias("chunk_failures"), F.lit("[]").alias("chunk_errors"), F.lit(None).cast("timestamp").alias("last_chunk_failure_at"))
    return failures.apply_account(before, account).select("source_id", "status", "chunk_failures")


@query()
def v8_label_clusters(t: Tables) -> DataFrame:
    """Centroids of four parts of each label in ten clusters."""
    parts = t.vectors.withColumn("label", F.col("label") * 4 + F.col("id") % 4)
    items = vec.centroid(parts, "label").select(F.col("label").cast("long").alias("id"), F.col("centroid").alias("embedding"))
    return clustering.clusters(items, 10)


def _catalog(t: Tables) -> catalog.Catalog:
    rows = t.sources.select(F.col("source_id").alias("id"), "url", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    return catalog.store(rows, graph._folder(t.spark), buckets=16)


@query("sources", sql="SELECT source_id AS id, url, lang, length(coalesce(text, '')) AS n_chars FROM sources WHERE contains(lower(lang), 'e') AND (length(coalesce(text, '')), source_id) > (500, 7) ORDER BY n_chars, id LIMIT 50")
def s18_catalog_page(t: Tables) -> DataFrame:
    """A page of the stored catalog after a cursor, of the languages with an e."""
    stored = _catalog(t)
    return stored.page("n_chars", "id", limit=50, after=(500, 7), where=stored.search("E", "lang")).select("id", "url", "lang", "n_chars")


@query("sources", sql="""SELECT source_id AS row_id, CASE WHEN source_id % 3 = 0 THEN source_id ELSE first END AS id, CASE WHEN source_id % 3 = 0 THEN 'url' ELSE 'content_hash' END AS how
FROM (SELECT source_id, min(source_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM sources)""")
def s18_catalog_find(t: Tables) -> DataFrame:
    """Every source looked up in the stored catalog: a third by its url, the others by their content."""
    asked = t.sources.select(F.col("source_id").alias("row_id"), F.when(F.col("source_id") % 3 == 0, F.col("url")).otherwise("").alias("url"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return _catalog(t).find(asked)


def _lines(t: Tables) -> DataFrame:
    whole = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"kind":"'), "event_type", F.lit('","p":'), "props", F.lit("}"))
    return t.raw("events").select(F.when(F.col("event_id") % 10 == 3, F.substring(whole, 1, 12)).when(F.col("event_id") % 10 == 4, "  ").otherwise(whole).alias("value"))


@query(sql="SELECT event_id AS id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 NOT IN (3, 4)")
def s12_json_lines(t: Tables) -> DataFrame:
    return catalog.json_lines(_lines(t), "id long, kind string, p struct<k: long>")[0].select("id", "kind", "p.k")


@query(sql="""SELECT left('{"id":' || event_id || ',"kind":"' || event_type, 12) AS value, count(*) AS n FROM events WHERE event_id % 10 = 3 GROUP BY 1""")
def s12_bad_lines(t: Tables) -> DataFrame:
    return catalog.json_lines(_lines(t), "id long, kind string, p struct<k: long>")[1].groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# ---- sweeps, bands, trees, windows, front matter ---------------------------------------------------------------------


@query(
    "vectors",
    sql=f""", top AS (SELECT query_id AS id, id AS hit FROM ({_NEAR}) WHERE s >= {NEAR} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) = 1),
turns AS (SELECT row_number() OVER (ORDER BY id) AS n, id, hit FROM top WHERE id % 3 > 0 AND hit % 3 > 0),
pass(n, gone, winners) AS (SELECT CAST(0 AS BIGINT), []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT t.n, CASE WHEN list_contains(gone, id) OR list_contains(gone, hit) THEN gone ELSE list_append(gone, hit) END, CASE WHEN list_contains(gone, id) OR list_contains(gone, hit) THEN winners ELSE list_append(winners, id) END FROM pass p JOIN turns t ON t.n = p.n + 1),
lost AS (SELECT unnest(gone) AS id, unnest(winners) AS winner FROM (SELECT * FROM pass ORDER BY n DESC LIMIT 1)),
chain(id, winner) AS (SELECT id, winner FROM lost UNION SELECT c.id, l.winner FROM chain c JOIN lost l ON l.id = c.winner)
SELECT v.id, CASE WHEN c.id IS NULL THEN 'stable' ELSE 'to_delete' END AS new_status, c.winner FROM vectors v LEFT JOIN (SELECT * FROM chain WHERE winner NOT IN (SELECT id FROM lost)) c USING (id) WHERE v.id % 3 > 0""",
)
def t12_stable_sweep(t: Tables) -> DataFrame:
    facts = t.vectors.select("id", F.when(F.col("id") % 3 == 0, "new").otherwise("stable").alias("status"))
    return dedup.stable_sweep(facts, dedup.top_neighbour(t.vectors, NEAR, None))


ORACLES["t12_stable_sweep"] = ORACLES["t12_stable_sweep"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("vectors", sql=f"SELECT a, b, round(s, 6) AS score, band FROM (SELECT query_id AS a, id AS b, s, CASE WHEN s >= 0.4 THEN 0.4 WHEN s >= 0.36 THEN 0.36 ELSE 0.3 END AS band FROM ({_NEAR}) WHERE s >= 0.3 AND query_id < id) QUALIFY row_number() OVER (PARTITION BY band ORDER BY md5(a || '-' || b), a, b) <= 5")
def g22_example_pairs(t: Tables) -> DataFrame:
    return dedup.band_examples(t.vectors, [0.3, 0.36, 0.4]).select("a", "b", F.round("score", 6).alias("score"), "band")


@query("fact_concepts", sql=f"SELECT CAST(coalesce(max(CASE WHEN n >= size THEN n // size END), CASE WHEN max(n) > 0 THEN 1 END, 0) AS INTEGER) AS sequence_num FROM (SELECT count(*) AS n, CASE WHEN count(*) >= 10000 THEN 200 WHEN count(*) >= 1000 THEN 100 WHEN count(*) >= 100 THEN 50 ELSE 20 END AS size FROM fact_concepts WHERE name = '{NAME_A}')")
def a15_last_sequence(t: Tables) -> DataFrame:
    made = summaries.slices(t.fact_concepts.select(F.col("name").alias("concept_id"), "fact_id", F.col("source_id").alias("first_seen_at")))
    return summaries.next_sequence(made, NAME_A)


@query(sql="""WITH RECURSIVE tree AS (SELECT DISTINCT conv_id AS id, CASE WHEN conv_id > 0 THEN conv_id // 2 END AS parent_id FROM conversations),
moves AS (SELECT id AS node, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN id * 2 WHEN 2 THEN id WHEN 3 THEN id + 1000000 ELSE (id + 1) // 3 END AS parent FROM tree),
up(id, anc) AS (SELECT id, id FROM tree UNION SELECT u.id, t.parent_id FROM up u JOIN tree t ON t.id = u.anc WHERE t.parent_id IS NOT NULL)
SELECT node, parent, parent IS NULL OR (parent IN (SELECT id FROM tree) AND NOT EXISTS (SELECT 1 FROM up WHERE up.id = parent AND anc = node)) AS valid FROM moves""")
def t44_valid_parents(t: Tables) -> DataFrame:
    """A move of every report: to none, to its child, to itself, to nowhere, to another."""
    tree = t.reports.select("id", "parent_id")
    node = F.col("id")
    kind = node % 5
    parent = F.when(kind == 1, node * 2).when(kind == 2, node).when(kind == 3, node + 1_000_000).when(kind == 4, F.floor((node + 1) / 3).cast("long"))
    return relational.valid_parents(tree, tree.select(node.alias("node"), parent.alias("parent")))


@query(sql=r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, i AS idx, array_to_string(w[i * 100 + 1:i * 100 + 100], ' ') AS part FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 100.0) AS BIGINT))) AS i FROM w)")
def t8_windows(t: Tables) -> DataFrame:
    """Windows of 100 tokens that do not overlap."""
    return t.raw("documents").select("doc_id", F.posexplode(tx.passages(F.col("text"), 100, 0)).alias("idx", "part")).withColumn("idx", F.col("idx").cast("long"))


@query(sql="""SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN nullif(trim(regexp_replace(left(text, 20), '[^A-Za-z ]', '', 'g')), '') END AS title, CASE WHEN doc_id % 4 > 1 THEN 'Writer & ' || lang END AS author,
CASE WHEN doc_id % 4 > 0 THEN source END AS site, CASE WHEN doc_id % 4 > 2 THEN DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) END AS date FROM documents""")
def s7_front_matter(t: Tables) -> DataFrame:
    """Documents with front matter made of their own fields, some without."""
    d = t.raw("documents")
    title = F.trim(F.regexp_replace(F.left("text", F.lit(20)), "[^A-Za-z ]", ""))
    lines = [
        F.concat(F.lit("title: "), title), F.when(F.col("doc_id") % 4 > 1, F.concat(F.lit('author: "Writer &amp; '), "lang", F.lit('"'))), F.concat(F.lit("sitename: "), "source"),
        F.when(F.col("doc_id") % 4 > 2, F.concat(F.lit("published: "), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).cast("string"))),
    ]
    head = F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))
    body = F.when(F.col("doc_id") % 4 > 0, F.concat(head, "text")).otherwise(F.col("text"))
    return d.select("doc_id", pages.front_matter(body).alias("m")).select("doc_id", "m.*")
