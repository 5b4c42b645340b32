"""Named queries over the domain tables, each with the SQL it must agree with wherever SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import concepts, dedup, evaluate, graph, hosts, relational, reports, search, summaries, usage
from ..sources import bundle, pages
from .fixtures import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NAME_A, NAME_B, NAME_C, NAME_D = "thanedble", "tiontion", "onbleea", "onanshat"
PROBE = [((i * 7) % 11 - 5) / 5 for i in range(64)]  # a query vector
NEAR = 0.4  # the test vectors have no pair above 0.51


def query(*tables: str, sql: str | None = None):
    """Register a function of the domain tables; sql may use the tables named."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = (with_tables(*tables) if tables else "") + sql
        return f

    return add


def _fact(df: DataFrame) -> DataFrame:
    return df.select("fact_id", "source_id", F.col("sidx").cast("long").alias("sidx"), "text")


_FACT = "fact_id, source_id, CAST(sidx AS BIGINT) AS sidx, text"


# ---- scans, filters, paging, writes ----------------------------------------------------------------------------------


@query("facts", sql=f"SELECT {_FACT} FROM facts WHERE repository_id = 'src1'")
def s1_facts_of_repository(t: Tables) -> DataFrame:
    return _fact(relational.scan(t.facts, repository_id="src1"))


@query("facts", sql=f"SELECT {_FACT} FROM facts WHERE source_id IN (1, 2, 3, 50)")
def s2_facts_by_source(t: Tables) -> DataFrame:
    return _fact(relational.lookup(t.facts, "source_id", [1, 2, 3, 50]))


@query("usage", sql="SELECT id, model, provider FROM usage WHERE created_at >= TIMESTAMP '2024-01-08' AND created_at < TIMESTAMP '2024-01-15'")
def p2_half_open_range(t: Tables) -> DataFrame:
    return relational.in_range(t.usage, "created_at", "2024-01-08", "2024-01-15").select("id", "model", "provider")


@query("audit", sql="SELECT id, action, actor FROM audit WHERE occurred_at >= TIMESTAMP '2024-01-08' AND occurred_at <= TIMESTAMP '2024-01-15' AND action = 'click'")
def p3_audit_closed_range(t: Tables) -> DataFrame:
    return usage.audit_events(t.audit, action="click", start="2024-01-08", end="2024-01-15").select("id", "action", "actor")


@query("facts", sql=f"SELECT {_FACT} FROM facts WHERE lower(text) = lower('The then.') OR text ILIKE '%than%the%'")
def p5_substring(t: Tables) -> DataFrame:
    return _fact(t.facts.where(relational.equal_fold(F.col("text"), F.lit("The then.")) | relational.contains_fold(F.col("text"), "than%the")))


@query("sources", sql="SELECT source_id, url FROM sources WHERE lang = 'fr'")
def p7_tag(t: Tables) -> DataFrame:
    tagged = t.sources.withColumn("tags", F.to_json(F.array("lang", "repository_id")))
    return tagged.where(relational.has_tag(F.col("tags"), "fr")).select("source_id", "url")


@query("facts", sql=f"SELECT {_FACT} FROM facts ORDER BY length(text) DESC, fact_id LIMIT 25 OFFSET 50")
def r3_page(t: Tables) -> DataFrame:
    return _fact(relational.page(t.facts, F.desc(F.length("text")), "fact_id", limit=25, offset=50))


@query("usage", sql="SELECT id, model, provider FROM usage QUALIFY row_number() OVER (PARTITION BY model, provider ORDER BY created_at DESC, id) = 1")
def r4_latest(t: Tables) -> DataFrame:
    return relational.latest(t.usage, ["model", "provider"], F.desc("created_at"), F.col("id")).select("id", "model", "provider")


@query(sql="SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS v FROM orders UNION ALL SELECT -c_custkey, c_nationkey FROM customer WHERE -c_custkey NOT IN (SELECT o_orderkey FROM orders)")
def w1_upsert_and_insert(t: Tables) -> DataFrame:
    table = t.raw("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    new = table.where("k % 3 = 0").withColumn("v", F.lit(-1).cast("long"))
    more = t.raw("customer").select((-F.col("c_custkey")).alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    return relational.insert_ignore(relational.upsert(table, new, ["k"]), more, ["k"])


@query(sql="SELECT o_orderkey AS k, CAST(CASE WHEN o_custkey % 2 = 0 THEN o_custkey * 10 ELSE o_custkey END AS BIGINT) AS v FROM orders WHERE o_custkey % 5 <> 0")
def j12_delete_and_update_from(t: Tables) -> DataFrame:
    table = t.raw("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("long").alias("v"))
    left = relational.delete(table, table.where("v % 5 = 0").select("k"))
    return relational.update_from(left, table.where("v % 2 = 0").select("k", (F.col("v") * 10).alias("v")), ["k"])


@query("facts", sql="SELECT a, b FROM (SELECT unnest(list(fact_id ORDER BY sidx)) AS a, CAST(unnest(list(length(text) ORDER BY sidx)) AS BIGINT) AS b FROM facts GROUP BY source_id)")
def j14_zipped_arrays(t: Tables) -> DataFrame:
    rows = t.facts.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("sidx", "fact_id", F.length("text").alias("n")))).alias("s"))
    return relational.zip_rows(rows.select(F.col("s.fact_id").alias("a"), F.col("s.n").cast("array<long>").alias("b")), "a", "b")


@query("facts", "fact_concepts", sql="SELECT DISTINCT id, CASE WHEN id IN (SELECT fact_id FROM facts) THEN 'fact' ELSE 'concept' END AS kind FROM (SELECT fact_id AS id FROM facts UNION ALL SELECT name FROM fact_concepts)")
def u1_kind_of_ids(t: Tables) -> DataFrame:
    ids = t.facts.select(F.col("fact_id").alias("id")).unionByName(t.fact_concepts.select(F.col("name").alias("id")))
    return relational.id_kinds(ids, t.facts, t.fact_concepts.select(F.col("name").alias("concept_id")))


@query(sql="WITH RECURSIVE tree AS (SELECT DISTINCT conv_id AS id, CASE WHEN conv_id > 0 THEN conv_id // 2 END AS parent_id FROM conversations), up(id, parent_id, depth) AS (SELECT id, parent_id, 0 FROM tree WHERE id = 37 UNION ALL SELECT t.id, t.parent_id, u.depth + 1 FROM up u JOIN tree t ON t.id = u.parent_id) SELECT id, depth FROM up")
def u5_ancestors(t: Tables) -> DataFrame:
    return relational.ancestors(t.reports.select("id", "parent_id"), 37)


# ---- usage, jobs, audit ----------------------------------------------------------------------------------------------

_SUMS = "count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens"


@query("usage", sql=f"SELECT provider, model, operation, {_SUMS} FROM usage GROUP BY ALL")
def a1_usage_rollup(t: Tables) -> DataFrame:
    return usage.summary(t.usage, "provider", "model", "operation")


@query("usage", sql=f"SELECT strftime(date_trunc('week', created_at), '%Y-%m-%d') AS bucket, model, {_SUMS} FROM usage GROUP BY ALL")
def a2_usage_by_week(t: Tables) -> DataFrame:
    return usage.by_bucket(t.usage, "week").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("usage", sql=f"SELECT source_id, {_SUMS} FROM usage WHERE repository_id = 3 GROUP BY ALL")
def a3_usage_by_source(t: Tables) -> DataFrame:
    return usage.summary(t.usage, "source_id", repository=3)


_PRICES = [("view", 0.12, 0.4), ("click", 1.0, 2.0)]


@query("usage", sql=f"SELECT model, calls, round(prompt_tokens / 1e6 * coalesce(p.i, 0) + completion_tokens / 1e6 * coalesce(p.o, 0), 6) AS cost FROM (SELECT model, {_SUMS} FROM usage GROUP BY ALL) LEFT JOIN (VALUES ('view', 0.12::DOUBLE, 0.4::DOUBLE), ('click', 1.0, 2.0)) p(m, i, o) ON p.m = model")
def a17_estimated_cost(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame(_PRICES, "model string, input double, output double")
    return usage.priced(usage.summary(t.usage, "model"), prices).select("model", "calls", F.round("cost", 6).alias("cost"))


@query("audit", sql="SELECT action, object, count(*) AS n FROM audit GROUP BY ALL")
def a12_job_states(t: Tables) -> DataFrame:
    return usage.job_states(t.audit, "action", "object")


# ---- hosts -----------------------------------------------------------------------------------------------------------

_STATS = "SELECT {by}, count(*) AS total, count(*) FILTER (ok) AS successes, count(*) FILTER (bad) AS failures FROM (SELECT {by}, source_id, bool_or(success) AS ok, bool_or(NOT success) AS bad FROM attempts GROUP BY ALL) GROUP BY {by}"


@query("attempts", sql=_STATS.format(by="host"))
def a6_host_statistics(t: Tables) -> DataFrame:
    return hosts.statistics(t.attempts, "host")


@query("attempts", sql="SELECT host, total, round(100.0 * failures / total, 1) AS fail_pct, round(100.0 * successes / total, 1) AS success_pct FROM (" + _STATS.format(by="host") + ")")
def a13_host_percentages(t: Tables) -> DataFrame:
    return hosts.percentages(hosts.statistics(t.attempts, "host")).select("host", "total", "fail_pct", "success_pct")


@query("attempts", sql="SELECT * FROM (" + _STATS.format(by="provider, host") + ") WHERE provider IN ('p0', 'p1')")
def a18_hosts_by_provider(t: Tables) -> DataFrame:
    return hosts.by_provider(t.attempts, ["p0", "p1"])


@query("attempts", sql="SELECT host, provider, round(failures / total, 6) AS failure_rate, total AS sample_size FROM (" + _STATS.format(by="provider, host") + ") WHERE total >= 10 AND failures / total >= 0.9")
def t34_skipped_hosts(t: Tables) -> DataFrame:
    none = t.spark.createDataFrame([], "host string, provider string, failure_rate double, sample_size long, expires_at timestamp, manual boolean")
    learned = hosts.learn_skips(hosts.statistics(t.attempts, "provider", "host"), none, "2024-02-01", minimum=10, threshold=0.9)
    return learned.select("host", "provider", F.round("failure_rate", 6).alias("failure_rate"), "sample_size")


# ---- concepts --------------------------------------------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS weight FROM (SELECT DISTINCT fact_id, name FROM fact_concepts) a JOIN (SELECT DISTINCT fact_id, name FROM fact_concepts) b ON a.fact_id = b.fact_id AND a.name < b.name GROUP BY ALL)"
_LINKS = with_tables("fact_concepts").rstrip() + ",\n" + _PAIRS + "\n"
_BAND = "CASE WHEN weight < 3 THEN 'insignificant' WHEN weight >= 6 THEN 'stable' ELSE 'weak' END AS band"
_EDGES = "WITH " + "op AS (SELECT DISTINCT l_orderkey AS fact_id, l_partkey AS name FROM lineitem), edges AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS weight FROM op a JOIN op b ON a.fact_id = b.fact_id AND a.name < b.name GROUP BY ALL)"


def _edges(t: Tables) -> DataFrame:
    return concepts.relations(t.orders_parts)


@query(sql=_LINKS + f"SELECT name_a, name_b, weight, {_BAND} FROM pairs WHERE weight >= 3")
def j6_relations(t: Tables) -> DataFrame:
    return concepts.relations(t.fact_concepts).where("weight >= 3").withColumn("band", tx.band(F.col("weight")))


@query(sql=_LINKS + f"SELECT CASE WHEN name_a = '{NAME_A}' THEN name_b ELSE name_a END AS other, weight, {_BAND} FROM pairs WHERE '{NAME_A}' IN (name_a, name_b)")
def p18_relations_of_a_name(t: Tables) -> DataFrame:
    return concepts.relation_list(concepts.relations(t.fact_concepts), NAME_A)


@query(sql=_LINKS + f"SELECT count(*) AS n FROM pairs WHERE '{NAME_A}' IN (name_a, name_b)")
def u3_relation_count(t: Tables) -> DataFrame:
    return concepts.relation_count(concepts.relations(t.fact_concepts), NAME_A)


@query("fact_concepts", sql=f"SELECT a.context, count(DISTINCT a.fact_id) AS shared, array_to_string(list(DISTINCT a.fact_id ORDER BY a.fact_id), ',') AS fact_ids FROM fact_concepts a JOIN fact_concepts b ON a.fact_id = b.fact_id AND a.name = '{NAME_D}' AND b.name = 'theaeati' GROUP BY ALL")
def t22_relation_detail(t: Tables) -> DataFrame:
    found = concepts.relation_detail(t.fact_concepts, NAME_D, "theaeati")
    return found.withColumn("fact_ids", F.array_join("fact_ids", ","))


_GROUPS = "SELECT lower(name) AS name_key, min(name) AS canonical_name, count(*) AS context_count, CAST(sum(greatest(links, 1)) AS BIGINT) AS context_count_compat, CAST(sum(links) AS BIGINT) AS total_fact_count, bool_or(embedded) AS any_embedded FROM (SELECT name, context, count(*) AS links, length(name) % 2 = 0 AS embedded FROM fact_concepts GROUP BY name, context) GROUP BY 1"


def _groups(t: Tables) -> DataFrame:
    links = t.fact_concepts.select(F.concat_ws("|", "name", "context").alias("concept_id"), "fact_id")
    return concepts.groups(concepts.concepts_of(t.fact_concepts).withColumn("embedded", F.length("name") % 2 == 0), links)


@query("fact_concepts", sql=_GROUPS)
def a8_concept_groups(t: Tables) -> DataFrame:
    return _groups(t)


@query("fact_concepts", sql=f"SELECT * FROM ({_GROUPS}) WHERE total_fact_count >= 5")
def p19_small_group_floor(t: Tables) -> DataFrame:
    return concepts.floor(_groups(t))


@query("facts", sql="SELECT text, count(DISTINCT source_id) AS source_count FROM facts GROUP BY text")
def j2_source_counts(t: Tables) -> DataFrame:
    seen = t.facts.select(F.col("text").alias("fact_id"), "source_id", "repository_id")
    return concepts.source_counts(seen.select("fact_id").distinct(), seen).select(F.col("fact_id").alias("text"), "source_count")


@query("fact_concepts", sql=f"SELECT source_id, count(DISTINCT fact_id) AS facts, min(fact_id) AS first_fact FROM fact_concepts WHERE name = '{NAME_A}' GROUP BY 1")
def a5_provenance(t: Tables) -> DataFrame:
    return concepts.provenance(t.fact_concepts, NAME_A)


@query("fact_concepts", sql=f"SELECT fact_id FROM fact_concepts WHERE name IN ('{NAME_A}', '{NAME_B}') INTERSECT SELECT fact_id FROM fact_concepts WHERE name IN ('{NAME_C}', 'thintion', 'thtionnt', 'thshing')")
def a10_intersection(t: Tables) -> DataFrame:
    return concepts.intersection(t.fact_concepts, [[NAME_A, NAME_B], [NAME_C, "thintion", "thtionnt", "thshing"]])


@query("facts", "fact_concepts", sql="SELECT fact_id FROM facts WHERE fact_id NOT IN (SELECT fact_id FROM fact_concepts) AND NOT (sidx % 4 = 0)")
def j4_unlinked_facts(t: Tables) -> DataFrame:
    skips = t.facts.where("sidx % 4 = 0").select("fact_id", F.lit(3).alias("attempts"))
    return concepts.unlinked(t.facts, t.fact_concepts, skips, 3).select("fact_id")


@query("fact_concepts", sql="SELECT name, fact_count FROM (SELECT name, max(n) AS fact_count FROM (SELECT lower(name) AS name, context, count(*) AS n FROM fact_concepts GROUP BY ALL) GROUP BY name) ORDER BY fact_count DESC, name LIMIT 50")
def r12_top_names(t: Tables) -> DataFrame:
    return concepts.top_names(concepts.concepts_of(t.fact_concepts), 50)


@query("fact_concepts", sql="SELECT name, context, count(*) AS n FROM fact_concepts WHERE context IN ('en', 'fr') GROUP BY ALL")
def t24_outbound_contexts(t: Tables) -> DataFrame:
    mapping = t.spark.createDataFrame([("EN", "en")], "local string, remote string")
    return concepts.map_outbound(t.fact_concepts.select("name", "context"), mapping, ["fr"]).groupBy("name", "context").agg(F.count(F.lit(1)).alias("n"))


@query("fact_concepts", sql="SELECT fact_id, name AS mention, CASE WHEN n = 0 THEN 'miss' WHEN n = 1 THEN 'linked' ELSE 'deferred' END AS outcome FROM (SELECT f.fact_id, f.name, (CASE WHEN length(f.name) % 2 = 0 THEN 1 ELSE 0 END) AS n FROM fact_concepts f)")
def t16_routing(t: Tables) -> DataFrame:
    links = t.fact_concepts
    known = concepts.concepts_of(links).where("length(name) % 2 = 0").withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("repository_id", F.lit("r"))
    names = concepts.named_concepts(known, t.spark.createDataFrame([], "concept_id string, alias string"))
    mentions = links.select("fact_id", F.lit("r").alias("repository_id"), "context", F.col("name").alias("mention"))
    none = t.spark.createDataFrame([], "concept_id string, embedding array<float>")
    return concepts.route(mentions, names, none, none.withColumnRenamed("concept_id", "fact_id")).select("fact_id", "mention", "outcome")


@query("fact_concepts", sql="""SELECT concept_id, CAST(seq AS INTEGER) AS sequence_num, count(*) AS facts, min(fact_id) AS first_fact, bool_and(n = size) AS is_complete FROM (
  SELECT *, count(*) OVER (PARTITION BY concept_id, seq) AS n FROM (
  SELECT concept_id, fact_id, size, ceil(rn / size) AS seq FROM (
  SELECT name AS concept_id, fact_id, row_number() OVER (PARTITION BY name ORDER BY source_id, fact_id) AS rn, CASE WHEN count(*) OVER (PARTITION BY name) >= 10000 THEN 200 WHEN count(*) OVER (PARTITION BY name) >= 1000 THEN 100 WHEN count(*) OVER (PARTITION BY name) >= 100 THEN 50 ELSE 20 END AS size FROM fact_concepts)))
  GROUP BY concept_id, seq HAVING bool_and(n = size) OR seq = 1""")
def t25_summary_slices(t: Tables) -> DataFrame:
    made = summaries.slices(t.fact_concepts.select(F.col("name").alias("concept_id"), "fact_id", F.col("source_id").alias("first_seen_at")))
    return made.select("concept_id", "sequence_num", F.size("fact_ids").cast("long").alias("facts"), F.array_min("fact_ids").alias("first_fact"), "is_complete")


@query("fact_concepts", sql="SELECT name AS concept_id, count(*) AS n FROM (SELECT name, fact_id, row_number() OVER (PARTITION BY name ORDER BY source_id, fact_id) AS rn, count(*) OVER (PARTITION BY name) AS total FROM fact_concepts) WHERE rn > greatest(floor(total / (CASE WHEN total >= 100 THEN 50 ELSE 20 END)) * (CASE WHEN total >= 100 THEN 50 ELSE 20 END), CASE WHEN total < 20 THEN total ELSE 0 END) GROUP BY 1")
def t26_uncovered_links(t: Tables) -> DataFrame:
    links = t.fact_concepts.select(F.col("name").alias("concept_id"), "fact_id", F.col("source_id").alias("first_seen_at"))
    return summaries.uncovered(links, summaries.slices(links)).groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql=_LINKS + f""", top AS (SELECT CASE WHEN name_a = '{NAME_A}' THEN name_b ELSE name_a END AS other, weight FROM pairs WHERE '{NAME_A}' IN (name_a, name_b) ORDER BY weight DESC, other LIMIT 10)
SELECT other, weight, row_number() OVER (ORDER BY weight DESC, other) <= 3 AS with_text, (SELECT array_to_string(list_sort(list(DISTINCT context))[1:5], ',') FROM fact_concepts WHERE name = other) AS contexts FROM top""")
def t28_enrichment(t: Tables) -> DataFrame:
    found = summaries.enrichment(concepts.relations(t.fact_concepts), t.fact_concepts.select("name", "context"), NAME_A)
    return found.withColumn("contexts", F.array_join("contexts", ","))


# ---- full text, vectors, fusion --------------------------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+')"


@query("facts", sql=f"SELECT fact_id, CAST(round(len(list_filter(w, lambda x: x = 'tion')) * 0.1, 6) AS DOUBLE) AS rank FROM (SELECT fact_id, {_TOKENS} AS w FROM facts) WHERE list_contains(w, 'tion') AND list_contains(w, 'thon') IS FALSE AND list_contains(w, 'thand') IS FALSE")
def f2_full_text(t: Tables) -> DataFrame:
    return search.full_text(t.facts, F.col("text"), "tion -thon -thand").select("fact_id", F.round("rank", 6).alias("rank"))


@query("facts", sql=f"SELECT fact_id FROM (SELECT fact_id, {_TOKENS} AS w FROM facts) WHERE list_contains(w, 'tion') AND (list_contains(w, 'erin') OR list_contains(w, 'eren'))")
def f2_full_text_or(t: Tables) -> DataFrame:
    return search.full_text(t.facts, F.col("text"), "tion erin or eren").select("fact_id")


@query("facts", sql=f"SELECT fact_id FROM (SELECT fact_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' AS w FROM facts) WHERE contains(w, ' inoran inoran ') OR contains(w, ' hehely hehely ')")
def f2_full_text_phrase(t: Tables) -> DataFrame:
    return search.full_text(t.facts, F.col("text"), '"inoran inoran" or "hehely hehely"').select("fact_id")


@query("facts", sql=f"SELECT fact_id, w AS lexeme, count(*) AS n FROM (SELECT fact_id, unnest({_TOKENS}) AS w FROM facts) WHERE w NOT IN ({', '.join(repr(w) for w in search.STOP_WORDS)}) GROUP BY ALL")
def f1_index(t: Tables) -> DataFrame:
    return search.postings(t.facts, "fact_id", F.col("text")).select("fact_id", "lexeme", F.size("positions").cast("long").alias("n"))


@query("vectors", sql=f"SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[]), 6) AS score FROM vectors ORDER BY list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[]) DESC, id LIMIT 20")
def v3_vector_search(t: Tables) -> DataFrame:
    return search.vector_search(t.vectors, PROBE, 20).select("id", F.round("score", 6).alias("score"))


_NEAR = "SELECT q.id AS query_id, v.id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM vectors q JOIN vectors v ON q.id <> v.id"


@query("vectors", sql=f"SELECT query_id, id, round(s, 6) AS score FROM ({_NEAR}) WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) <= 3")
def j15_neighbours(t: Tables) -> DataFrame:
    return search.neighbours(t.vectors, t.vectors, 3, 0.3).select("query_id", "id", F.round("score", 6).alias("score"))


@query("vectors", sql="SELECT label, i, round(avg(x), 6) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM vectors) GROUP BY ALL")
def v1_centroids(t: Tables) -> DataFrame:
    return vec.centroid(t.vectors, "label").select("label", F.posexplode("centroid").alias("i", "m")).select("label", F.col("i").cast("long").alias("i"), F.round("m", 6).alias("m"))


@query("vectors", sql="WITH_C SELECT label, id, score FROM (SELECT v.label, v.id, round(list_cosine_similarity(v.embedding::DOUBLE[], c.c), 6) AS score FROM vectors v JOIN cent c ON c.label = v.label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, id) = 1")
def v7_representatives(t: Tables) -> DataFrame:
    return vec.representatives(t.vectors, "label", "id")


ORACLES["v7_representatives"] = ORACLES["v7_representatives"].replace("\nWITH_C", ", cent AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM vectors) GROUP BY ALL) GROUP BY label)\n")


@query("usage", sql="SELECT id, round(coalesce(1 / (60 + l), 0) + coalesce(1 / (60 + s), 0), 9) AS score FROM (SELECT user_id AS id, row_number() OVER (ORDER BY user_id) - 1 AS l FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'view')) FULL JOIN (SELECT user_id AS id, row_number() OVER (ORDER BY user_id DESC) - 1 AS s FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')) USING (id)")
def r6_rank_fusion(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    ids = lambda kind: t.raw("events").where(F.col("event_type") == kind).select(F.col("user_id").alias("id")).distinct()
    ranked = lambda df, order: df.select("id", (F.row_number().over(Window.orderBy(order)) - 1).alias("rank"))  # noqa: E731  # two result lists
    return search.fuse(ranked(ids("view"), F.col("id")), ranked(ids("error"), F.desc("id"))).select("id", F.round("score", 9).alias("score"))


def _drawn_vectors(t: Tables, items: DataFrame) -> DataFrame:
    """A vector for every item (id string): the one whose number follows from the hash of the id."""
    number = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % t.vectors.count()
    return items.select(F.col("id").alias("own"), number.alias("id")).join(t.vectors, "id").select(F.col("own").alias("id"), "embedding")


@query("facts", "vectors", sql=f""", words AS (SELECT fact_id AS id, len(list_filter(w, lambda x: x IN ('tion', 'thon', 'erin'))) AS n FROM (SELECT fact_id, {_TOKENS} AS w FROM facts)),
lex AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) - 1 AS l FROM words WHERE n > 0 QUALIFY l < 60),
near AS (SELECT fact_id AS id, list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[]) AS s FROM facts JOIN vectors v ON v.id = CAST('0x' || substr(md5(fact_id), 1, 8) AS BIGINT) % (SELECT count(*) FROM vectors)),
sem AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS r FROM near QUALIFY r < 60),
both_ AS (SELECT id, l, r, coalesce(1.0::DOUBLE / (60 + l), 0) + coalesce(1.0::DOUBLE / (60 + r), 0) AS score FROM lex FULL JOIN sem USING (id)),
page AS (SELECT *, row_number() OVER (ORDER BY score DESC, l NULLS LAST, r NULLS LAST, id) - 1 AS fused FROM both_ QUALIFY fused < 20)
SELECT id, text, round(score, 9) AS score, CAST(fused AS INTEGER) AS fused, 'hybrid' AS search_mode FROM page JOIN facts ON fact_id = id""")
def r8_hybrid_facts(t: Tables) -> DataFrame:
    facts = t.facts.select(F.col("fact_id").alias("id"), "text")
    return search.hybrid_facts(facts, _drawn_vectors(t, facts), "tion or thon or erin", PROBE).withColumn("score", F.round("score", 9))


@query("facts", "fact_concepts", "vectors", sql=f""", c AS (SELECT concat_ws('|', name, context) AS id, name, count(*) AS fact_count FROM fact_concepts GROUP BY name, context),
lex AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM c WHERE name IN ('thanedble', 'tiontion')),
near AS (SELECT c.id, list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[]) AS s FROM c JOIN vectors v ON v.id = CAST('0x' || substr(md5(c.id), 1, 8) AS BIGINT) % (SELECT count(*) FROM vectors)),
sem AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS r FROM near QUALIFY r < 500),
fused AS (SELECT id, coalesce(1.0::DOUBLE / (60 + lex.r), 0) + coalesce(1.0::DOUBLE / (60 + sem.r), 0) AS score FROM lex FULL JOIN sem USING (id))
SELECT name AS name_key, CAST(sum(fact_count) AS BIGINT) AS total_fact_count, round(max(score), 9) AS score FROM c JOIN fused USING (id) GROUP BY 1 HAVING sum(fact_count) >= 5""")
def r9_hybrid_concepts(t: Tables) -> DataFrame:
    named = concepts.concepts_of(t.fact_concepts).select(F.col("concept_id").alias("id"), "name", "fact_count")
    return search.hybrid_concepts(named, _drawn_vectors(t, named), "thanedble or tiontion", PROBE).withColumn("score", F.round("score", 9))


@query("usage", sql="SELECT source_id AS id, min(CAST(substr(operation, 3) AS INTEGER)) AS query FROM usage GROUP BY 1")
def r13_merged_queries(t: Tables) -> DataFrame:
    hits = t.usage.select(F.substring("operation", 3, 9).cast("int").alias("query"), F.col("id").alias("rank"), F.col("source_id").alias("id"))
    return search.merged_queries(hits).select("id", "query")


# ---- dedup -----------------------------------------------------------------------------------------------------------


@query(
    "vectors",
    sql=f""", top AS (SELECT query_id AS id, id AS hit FROM ({_NEAR}) WHERE s >= {NEAR} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) = 1),
turns AS (SELECT row_number() OVER (ORDER BY id) AS n, id, hit, hit % 3 = 0 AS settled FROM top WHERE id % 3 <> 0),
pass(n, gone, losers, winners) AS (SELECT CAST(0 AS BIGINT), []::BIGINT[], []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT t.n, CASE WHEN stays THEN gone WHEN settled THEN list_append(gone, id) ELSE list_append(gone, hit) END, CASE WHEN stays THEN losers WHEN settled THEN list_append(losers, id) ELSE list_append(losers, hit) END,
    CASE WHEN stays THEN winners WHEN settled THEN list_append(winners, hit) ELSE list_append(winners, id) END
  FROM (SELECT t.n, t.id, t.hit, t.settled, gone, losers, winners, list_contains(gone, t.id) OR (NOT t.settled AND list_contains(gone, t.hit)) AS stays FROM pass p JOIN turns t ON t.n = p.n + 1) t),
lost AS (SELECT unnest(losers) AS id, unnest(winners) AS winner FROM (SELECT * FROM pass ORDER BY n DESC LIMIT 1)),
chain(id, winner) AS (SELECT id, winner FROM lost UNION SELECT c.id, l.winner FROM chain c JOIN lost l ON l.id = c.winner)
SELECT v.id, CASE WHEN c.id IS NULL THEN 'stable' ELSE 'to_delete' END AS new_status, c.winner FROM vectors v LEFT JOIN (SELECT * FROM chain WHERE winner NOT IN (SELECT id FROM lost)) c USING (id)""",
)
def t10_deduplicated_facts(t: Tables) -> DataFrame:
    top = dedup.top_neighbour(t.vectors, NEAR, None)
    return dedup.deduplicate(t.vectors.select("id", F.when(F.col("id") % 3 == 0, "stable").otherwise("new").alias("status")), top)


@query("vectors", sql=f"SELECT query_id AS id, id AS hit, round(s, 6) AS score FROM ({_NEAR}) WHERE s >= {NEAR} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) = 1")
def t10_top_neighbours(t: Tables) -> DataFrame:
    return dedup.top_neighbour(t.vectors, NEAR, None).select("id", "hit", F.round("score", 6).alias("score"))


@query("vectors", sql=f""", near AS (SELECT query_id AS a, id AS b, s FROM ({_NEAR}) WHERE s >= 0.36 AND query_id < id),
over_ AS (SELECT t, a, b, a % 7 <> b % 7 AS far FROM near JOIN (SELECT unnest([0.36, {NEAR}, 0.45]::DOUBLE[]) AS t) ON s >= t),
two AS (SELECT t, a AS u, b AS v, far FROM over_ UNION ALL SELECT t, b, a, far FROM over_),
walk(t, node, seen) AS (SELECT DISTINCT t, u, u FROM two UNION SELECT w.t, w.node, x.v FROM walk w JOIN two x ON x.t = w.t AND x.u = w.seen),
roots AS (SELECT t, count(DISTINCT root) AS clusters FROM (SELECT t, node, min(seen) AS root FROM walk GROUP BY ALL) GROUP BY t),
ends AS (SELECT t, count(*) AS any_neighbour, count(*) FILTER (far) AS cross_source FROM (SELECT t, u, bool_or(far) AS far FROM two GROUP BY ALL) GROUP BY t),
total AS (SELECT count(*) AS n FROM vectors)
SELECT t AS threshold, any_neighbour, cross_source, clusters, n - any_neighbour + clusters AS survivors, round((any_neighbour - clusters) * 100.0 / n, 4) AS reduction_pct FROM ends JOIN roots USING (t), total""")
def g20_threshold_sweep(t: Tables) -> DataFrame:
    pairs = dedup.sweep_pairs(t.vectors, 0.36, lambda a, b: a % 7 != b % 7)
    return dedup.threshold_sweep(pairs, [0.36, NEAR, 0.45], t.vectors.count())


@query("vectors", sql=f"SELECT CAST(CASE WHEN s < 0.32 THEN 0 WHEN s < 0.36 THEN 1 ELSE 2 END AS INTEGER) AS bin, count(*) AS n FROM (SELECT max(s) AS s FROM ({_NEAR}) GROUP BY query_id) WHERE s >= 0.3 GROUP BY 1")
def g21_score_histogram(t: Tables) -> DataFrame:
    return dedup.score_histogram(search.neighbours(t.vectors, t.vectors, 1, 0.3), [0.3, 0.32, 0.36, 1.0])


@query("facts", sql="SELECT fact_id, source_id FROM (SELECT min(fact_id) OVER (PARTITION BY text) AS fact_id, source_id FROM facts) GROUP BY ALL")
def t11_merged_sources(t: Tables) -> DataFrame:
    first = t.facts.groupBy("text").agg(F.min("fact_id").alias("winner"))
    verdict = t.facts.join(first, "text").select(F.col("fact_id").alias("id"), F.when(F.col("winner") != F.col("fact_id"), F.col("winner")).alias("winner"))
    return dedup.merge_sources(t.facts.select("fact_id", "source_id").distinct(), verdict, "2024-01-01")


# ---- graph -----------------------------------------------------------------------------------------------------------

_MODEL = _EDGES + ", k AS (SELECT name, count(*) AS k FROM op GROUP BY 1), model AS (SELECT e.*, a.k AS k_a, b.k AS k_b, a.k * b.k / (SELECT sum(k) FROM k) AS expected FROM edges e JOIN k a ON a.name = name_a JOIN k b ON b.name = name_b), z AS (SELECT *, (weight - expected) / sqrt(expected) AS z FROM model)"


@query(sql=_EDGES + " SELECT * FROM edges")
def j6_order_part_graph(t: Tables) -> DataFrame:
    return _edges(t)


@query(sql=_MODEL + " SELECT name_a, name_b, k_a, k_b, round(expected, 9) AS expected, round(z, 6) AS z FROM z WHERE weight >= 2")
def g2_null_model(t: Tables) -> DataFrame:
    m = graph.null_model(_edges(t), t.orders_parts).where("weight >= 2")
    return m.select("name_a", "name_b", "k_a", "k_b", F.round("expected", 9).alias("expected"), F.round("z", 6).alias("z"))


@query(sql=_MODEL + " SELECT 'all' AS band, count(*) AS edges, count(*) FILTER (abs(z) < 1) AS confounded FROM z UNION ALL SELECT CASE WHEN weight = 1 THEN '1' WHEN weight < 5 THEN '2-4' WHEN weight < 10 THEN '5-9' ELSE '>=10' END, count(*), count(*) FILTER (abs(z) < 1) FROM z GROUP BY 1")
def g5_confounded(t: Tables) -> DataFrame:
    return graph.confounded(graph.null_model(_edges(t), t.orders_parts))


@query(sql=_MODEL + """, tested AS (SELECT weight, round(greatest(0, 1 - coalesce(list_sum(list_transform(range(0, CAST(weight AS BIGINT)), lambda i: exp(i * ln(expected) - expected - lgamma(i + 1)))), 0)), 12) AS p FROM z),
ranked AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM tested), adjusted AS (SELECT *, least(1, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM ranked)
SELECT count(*) FILTER (p < 0.05) AS p_05, count(*) FILTER (p < 0.01) AS p_01, count(*) FILTER (q < 0.05) AS q_05, count(*) FILTER (weight >= 2) AS w_2, count(*) FILTER (weight >= 5) AS w_5, count(*) FILTER (weight >= 10) AS w_10 FROM adjusted""")
def g3_significance(t: Tables) -> DataFrame:
    like = graph.null_model(_edges(t), t.orders_parts).groupBy("weight", "expected").agg(F.count(F.lit(1)).alias("n"))  # edges of one weight and expectation share their p
    return graph.survivors(graph.benjamini_hochberg(graph._saved(graph.significance(like)), "n"), "n")


@query(sql=_MODEL + ", r AS (SELECT rank() OVER (ORDER BY weight) + (count(*) OVER (PARTITION BY weight) - 1) / 2 AS x, rank() OVER (ORDER BY k_a) + (count(*) OVER (PARTITION BY k_a) - 1) / 2 AS y FROM z) SELECT round(corr(x, y), 6) AS rho FROM r")
def g4_spearman(t: Tables) -> DataFrame:
    return graph.spearman(graph.null_model(_edges(t), t.orders_parts).select("weight", "k_a"), "weight", "k_a").select(F.round("rho", 6).alias("rho"))


@query(sql=_MODEL + " SELECT CAST(w AS INTEGER) AS w, count(*) AS edges, count(*) FILTER (abs(z) < 1) AS confounded, count(*) FILTER (k_a < 10 AND k_b < 10) AS low_degree FROM z JOIN range(1, 21) r(w) ON weight >= w GROUP BY 1")
def g7_weight_sweep(t: Tables) -> DataFrame:
    return graph.weight_sweep(graph.null_model(_edges(t), t.orders_parts))


@query(sql=_EDGES + " SELECT * FROM edges ORDER BY weight DESC, name_a, name_b LIMIT 20")
def g8_top_edges(t: Tables) -> DataFrame:
    return graph.top_edges(_edges(t))


@query(sql=_EDGES + " SELECT name, count(*) AS k FROM op GROUP BY 1 ORDER BY k DESC, name LIMIT 15")
def g8_hubs(t: Tables) -> DataFrame:
    return graph.hubs(t.orders_parts)


_ENDS = "(SELECT unnest([name_a, name_b]) AS name FROM edges WHERE weight >= {w})"


@query(sql=_EDGES + f" SELECT 2 AS w, count(DISTINCT name) AS nodes, count(*) // 2 AS edges, (SELECT count(DISTINCT name) FROM op) - count(DISTINCT name) AS isolated FROM {_ENDS.format(w=2)}")
def g9_at_threshold(t: Tables) -> DataFrame:
    return graph.at_threshold(_edges(t), 2, t.orders_parts)


@query(sql=_EDGES + f" SELECT round(avg(d), 6) AS mean, max(d) AS max, median(d) AS median, round(1 + count(*) / sum(ln(d / 0.5)), 6) AS alpha_mle FROM (SELECT name, count(*) AS d FROM {_ENDS.format(w=1)} GROUP BY 1)")
def g10_degree_distribution(t: Tables) -> DataFrame:
    return graph.degree_distribution(_edges(t)).select(F.round("mean", 6).alias("mean"), "max", "median", F.round("alpha_mle", 6).alias("alpha_mle"))


@query(sql=_EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + ", two AS (SELECT name_a AS u, name_b AS v FROM edges WHERE weight >= 3 UNION SELECT name_b, name_a FROM edges WHERE weight >= 3), walk(node, far) AS (SELECT u, u FROM two UNION SELECT w.node, t.v FROM walk w JOIN two t ON t.u = w.far) SELECT root, count(*) AS size FROM (SELECT node, min(far) AS root FROM walk GROUP BY node) GROUP BY root")
def g11_component_sizes(t: Tables) -> DataFrame:
    return graph.component_sizes(_edges(t).where("weight >= 3"))


@query()
def g12_communities(t: Tables) -> DataFrame:
    edges = _edges(t).where("weight >= 2")
    return graph.modularity(edges, graph.communities_lpa(edges))


@query(sql=_EDGES + ", e AS (SELECT name_a AS u, name_b AS v FROM edges WHERE weight >= 2), two AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), tri AS (SELECT a.u AS name, count(*) AS t FROM two a JOIN two b ON a.u = b.u AND a.v < b.v JOIN e ON e.u = a.v AND e.v = b.v GROUP BY 1), d AS (SELECT u AS name, count(*) AS degree FROM two GROUP BY 1) SELECT d.name, degree, coalesce(t, 0) AS t, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM d LEFT JOIN tri ON tri.name = d.name")
def g13_clustering(t: Tables) -> DataFrame:
    return graph.clustering(_edges(t).where("weight >= 2")).withColumn("clustering", F.round("clustering", 6))


@query()
def g13_path_lengths(t: Tables) -> DataFrame:
    edges = _edges(t).where("weight >= 2")
    return graph.path_lengths(edges, graph.path_starts(edges)).withColumn("mean_path", F.round("mean_path", 6))


@query(sql=_EDGES + " SELECT min(weight) AS min, max(weight) AS max, round(avg(weight), 6) AS mean, median(weight) AS median, round(avg((weight = 1)::INT), 6) AS frac_1, round(avg((weight >= 2)::INT), 6) AS frac_2, round(avg((weight >= 5)::INT), 6) AS frac_5 FROM edges")
def g14_weight_distribution(t: Tables) -> DataFrame:
    return graph.weight_distribution(_edges(t)).select("min", "max", F.round("mean", 6).alias("mean"), "median", *[F.round(f"frac_{w}", 6).alias(f"frac_{w}") for w in (1, 2, 5)])


@query("fact_concepts", sql="SELECT lower(name) AS name, count(DISTINCT lower(context)) AS contexts FROM fact_concepts GROUP BY 1 HAVING count(DISTINCT lower(context)) > 1")
def g15_multi_context(t: Tables) -> DataFrame:
    return graph.multi_context(t.fact_concepts)


@query(sql=_LINKS + ", deg AS (SELECT name, count(*) AS degree FROM (SELECT unnest([name_a, name_b]) AS name FROM pairs WHERE weight >= 2) GROUP BY 1) SELECT source_id, count(DISTINCT fact_id) AS facts, round(avg(degree), 6) AS mean_degree FROM fact_concepts JOIN deg USING (name) GROUP BY 1")
def g16_source_centrality(t: Tables) -> DataFrame:
    edges = concepts.relations(t.fact_concepts).where("weight >= 2")
    return graph.source_centrality(edges, t.fact_concepts).withColumn("mean_degree", F.round("mean_degree", 6))


@query(sql=_LINKS + """, deg AS (SELECT name, count(*) AS degree FROM (SELECT unnest([name_a, name_b]) AS name FROM pairs WHERE weight >= 2) GROUP BY 1),
per AS (SELECT source_id, count(DISTINCT fact_id) AS x, avg(degree) AS y FROM fact_concepts JOIN deg USING (name) GROUP BY 1),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY round(y, 9)) - 1) / 2 AS ry FROM per)
SELECT count(*) AS sources, CASE WHEN count(*) >= 10 THEN round(corr(x, y), 6) END AS pearson, CASE WHEN count(*) >= 10 THEN round(corr(rx, ry), 6) END AS spearman FROM r""")
def g16_centrality_correlations(t: Tables) -> DataFrame:
    edges = concepts.relations(t.fact_concepts).where("weight >= 2")
    found = graph.centrality_correlations(graph.source_centrality(edges, t.fact_concepts))
    return found.select("sources", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


_HEADS = "n AS (SELECT DISTINCT array_to_string(string_split(lower(text), ' ')[1:k], ' ') AS b FROM facts, range(1, 4) r(k))"


@query(sql=with_tables("facts").rstrip() + f",\n{_HEADS}, h AS (SELECT b, array_to_string(string_split(b, ' ')[1:i], ' ') AS a FROM n, range(1, 3) r(i) WHERE i < len(string_split(b, ' '))) SELECT DISTINCT a, b, 'prefix' AS reason FROM h WHERE a IN (SELECT b FROM n) AND length(a) >= 4 AND length(b) <= 1.5 * length(a)")
def g17_fragmentation(t: Tables) -> DataFrame:
    heads = F.array(*[F.array_join(F.slice(F.split(F.lower("text"), " "), 1, k), " ") for k in (1, 2, 3)])
    named = t.facts.select(F.explode(heads).alias("name")).distinct().select(F.col("name").alias("concept_id"), "name")
    none = t.spark.createDataFrame([], "concept_id string, alias string")
    edges = t.spark.createDataFrame([], "name_a string, name_b string, weight long")
    return graph.fragmentation(named, none, edges)


@query("fact_concepts", sql="SELECT f.name, count(*) AS facts, round(avg(contains(lower(x.text), left(f.name, 4))::INT), 6) AS rate FROM (SELECT DISTINCT fact_id, name FROM fact_concepts) f JOIN facts x USING (fact_id) WHERE f.name IN (SELECT name FROM (SELECT DISTINCT fact_id, name FROM fact_concepts) GROUP BY 1 HAVING count(*) > 20 ORDER BY count(*) DESC, name LIMIT 200) GROUP BY 1")
def g18_mention_rates(t: Tables) -> DataFrame:
    terms = t.fact_concepts.select("name", F.substring("name", 1, 4).alias("term")).distinct()
    return graph.mention_rates(t.fact_concepts, t.facts, terms).select("name", "facts", F.round("rate", 6).alias("rate"))


@query(sql="""WITH p AS (SELECT event_type AS x, user_id % 5 AS y, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT sum(n) AS t FROM p), px AS (SELECT x, sum(n) AS nx FROM p GROUP BY 1), py AS (SELECT y, sum(n) AS ny FROM p GROUP BY 1)
SELECT round(2 * (SELECT sum(n / t * ln(n * t / (nx * ny))) FROM p JOIN px USING (x) JOIN py USING (y), t) / ((SELECT sum(-nx / t * ln(nx / t)) FROM px, t) + (SELECT sum(-ny / t * ln(ny / t)) FROM py, t)), 6) AS nmi""")
def g12_nmi(t: Tables) -> DataFrame:
    rows = t.raw("events").select(F.col("event_type").alias("x"), (F.col("user_id") % 5).alias("y"))
    return graph.nmi(rows, "x", "y").select(F.round("nmi", 6).alias("nmi"))


# ---- text, sources, reports, scoring ---------------------------------------------------------------------------------


@query(sql="SELECT doc_id, i AS idx, substr(text, i * 900 + 1, 1000) AS chunk FROM documents, range(0, 400) r(i) WHERE length(text) > 0 AND (i = 0 OR i <= ceil((length(text) - 1000) / 900.0))")
def t4_sliding_chunks(t: Tables) -> DataFrame:
    rows = t.raw("documents").select("doc_id", F.explode(tx.sliding_chunks(F.col("text"), 1000, 100)).alias("c"))
    return rows.select("doc_id", F.col("c.idx").cast("long").alias("idx"), F.col("c.text").alias("chunk"))


@query(sql=r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, array_to_string(w[i * 90 + 1:i * 90 + 100], ' ') AS passage FROM w, range(0, 400) r(i) WHERE len(w) > 0 AND (i = 0 OR i <= ceil((len(w) - 100) / 90.0))")
def t8_passages(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.explode(tx.passages(F.col("text"), 100, 10)).alias("passage"))


@query()
def t1_report_sentences(t: Tables) -> DataFrame:
    return reports.report_sentences(t.reports)


@query()
def t31_numeric_tokens(t: Tables) -> DataFrame:
    return t.facts.select("fact_id", tx.numeric_tokens(F.col("text")).alias("numbers"), tx.numeric_query(F.col("text")).alias("query")).where(F.size("numbers") > 0)


@query(sql="SELECT page_id, nullif(regexp_extract(url, 'https?://([^/]+)', 1), '') AS host, CASE WHEN starts_with(trim(url), '10.') OR contains(url, 'doi.org/') THEN 'doi' ELSE 'url' END AS kind FROM pages")
def p9_links(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", tx.host_raw(F.col("url")).alias("host"), tx.classify_url(F.col("url"))["kind"].alias("kind"))


_PHRASES = " OR ".join("contains(lower(text), '{}')".format(p.replace("'", "''")) for p in tx.BOILERPLATE_PHRASES)


@query(sql=f"SELECT doc_id, coalesce({_PHRASES}, false) AS boilerplate, length(coalesce(text, '')) < 200 AS insufficient FROM documents")
def p11_boilerplate(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", tx.is_boilerplate(F.col("text")).alias("boilerplate"), tx.is_insufficient(F.col("text")).alias("insufficient"))


@query(sql="SELECT doc_id, sha256(text) AS fact_hash, sha256('u' || doc_id || text || lang) AS source_hash FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents)")
def s11_content_hashes(t: Tables) -> DataFrame:
    d = t.raw("documents")
    url = F.concat(F.lit("u"), F.col("doc_id").cast("string"))
    return d.select("doc_id", bundle.fact_hash(F.col("text")).alias("fact_hash"), bundle.source_hash(url, F.col("text"), F.lit(None).cast("string"), F.col("lang")).alias("source_hash"))


@query("facts", sql="SELECT fact_id, row_number() OVER (ORDER BY fact_id) - 1 AS idx FROM facts")
def s10_dense_indexes(t: Tables) -> DataFrame:
    return bundle.dense(t.facts.select("fact_id"), "fact_id", "idx")


@query()
def s3_page_documents(t: Tables) -> DataFrame:
    return pages.documents(t.raw("pages")).drop("images")


@query()
def s5_image_references(t: Tables) -> DataFrame:
    return pages.image_refs(pages.documents(t.raw("pages")), "page_id")


@query(sql=r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\b.*?</script|style\b.*?</style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def s3_plain_text(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", pages.plain_text(F.col("html")).alias("text"))


@query(sql="SELECT conv_id AS report_id, turn AS idx, coalesce(lag(text) OVER w, '') AS before, coalesce(lead(text) OVER w, '') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def r15_context_windows(t: Tables) -> DataFrame:
    rows = t.raw("conversations").select(F.col("conv_id").alias("report_id"), F.col("turn").alias("idx"), "text")
    return reports.context_windows(rows, 1).select("report_id", "idx", F.array_join("before", "").alias("before"), F.array_join("after", "").alias("after"))


@query()
def t32_annotations(t: Tables) -> DataFrame:
    rows = t.raw("conversations").select(F.col("conv_id").alias("report_id"), F.col("turn").cast("int").alias("idx"), F.when(F.length("text") < 40, F.rpad("text", 40, ".")).otherwise(F.col("text")).alias("text"))  # all are candidates
    vectors = rows.select("report_id", "idx", F.pmod(F.col("report_id") * 31 + F.col("idx"), F.lit(t.vectors.count())).alias("id")).join(t.vectors, "id").select("report_id", "idx", "embedding")
    own = t.facts.select(F.col("fact_id").alias("fid"), F.pmod(F.xxhash64("fact_id"), F.lit(t.vectors.count())).alias("id")).join(t.vectors, "id").select(F.col("fid").alias("id"), "embedding")
    facts = t.facts.select("fact_id", "text")
    return reports.annotate(rows, vectors, facts, own, own.select("id", F.lit("fact").alias("kind")), threshold=NEAR)


@query(sql="""WITH p AS (SELECT event_type AS question_type, event_id AS id, 'the ' || event_type AS prediction, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'nothing' END AS gold FROM events), s AS (SELECT *, gold = question_type AS ok FROM p),
r AS (SELECT question_type, ok FROM s UNION ALL SELECT 'all', ok FROM s) SELECT question_type, count(*) AS n, count(*) FILTER (ok) AS correct, 0::BIGINT AS refused, count(*) AS substantive, count(*) FILTER (NOT ok) AS hallucinated, round(avg(ok::INT), 6) AS accuracy FROM r GROUP BY 1""")
def e2_scores(t: Tables) -> DataFrame:
    e = t.raw("events")
    return evaluate.score(e.select(F.col("event_type").alias("question_type"), F.concat(F.lit("the "), "event_type").alias("prediction"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("nothing").alias("gold")))


@query()
def e3_bootstrap_interval(t: Tables) -> DataFrame:
    rows = t.raw("labels").select(F.col("doc_id").alias("id"), "quality")
    return evaluate.bootstrap_poisson(rows, "quality")


@query(sql="SELECT round(avg(least(3, n) / n), 6) AS recall_3, round(avg(least(10, n) / n), 6) AS recall_10 FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)")
def e4_recall(t: Tables) -> DataFrame:
    pair = F.struct(F.col("l_partkey").cast("string").alias("title"), F.lit("s").alias("source"))
    rows = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(pair)).alias("hits")).withColumn("gold", F.col("hits"))
    return evaluate.recall_at(rows, [3, 10])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest relations between concepts, with their band."""
    strong = concepts.relations(Tables(spark, sf_dir).fact_concepts).withColumn("band", tx.band(F.col("weight")))
    return relational.page(strong, F.desc("weight"), "name_a", "name_b", limit=100)


from . import index_queries, more_queries, stage_queries  # noqa: E402,F401 - register more

for _name in ("t10_deduplicated_facts", "g20_threshold_sweep"):
    ORACLES[_name] = ORACLES[_name].replace("WITH ", "WITH RECURSIVE ", 1)
