"""More named queries: text and link functions, hosts, aliases, routing, dedup upkeep, catalog matching, list orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..functions.segment import salvaged
from ..operators import concepts, dedup, evaluate, graph, hosts, relational, reports, search, summaries
from ..sources import bundle
from .fixtures import Tables, with_tables
from .queries import _EDGES, _GROUPS, _MODEL, NAME_A, _edges, _groups, query


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pick(values: list[str | None], column: str) -> Column:
    """One of the values by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def _pick_sql(values: list[str | None], column: str) -> str:
    return f"list_extract([{', '.join('NULL' if v is None else _quoted(v) for v in values)}], CAST({column} % {len(values)} + 1 AS INTEGER))"


# ---- text ------------------------------------------------------------------------------------------------------------


@query(sql=r"SELECT doc_id, trim(s) AS sentence FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) WHERE trim(s) <> ''")
def t2_rough_sentences(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.explode(tx.rough_sentences(F.col("text"))).alias("sentence"))


@query(sql="SELECT doc_id, i AS idx, substr(text, i * 300 + 1, 300) AS part FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 300.0) AS BIGINT))) AS i FROM documents)")
def t3_hard_split(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.posexplode(tx.hard_split(F.col("text"), 300)).alias("idx", "part")).withColumn("idx", F.col("idx").cast("long"))


@query(sql="""SELECT doc_id, array_to_string(flatten(list_transform(range(0, n + 1), lambda i: [i * 900, least(i * 900 + 1000, length(text))])), ',') AS flat, n + 1 AS spans
FROM (SELECT doc_id, text, CAST(CASE WHEN length(text) <= 1000 THEN 0 ELSE ceil((length(text) - 1000) / 900.0) END AS BIGINT) AS n FROM documents WHERE length(text) > 0)""")
def t5_offsets(t: Tables) -> DataFrame:
    spans = F.transform(tx.sliding_chunks(F.col("text"), 1000, 100), lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.length(c["text"])).alias("end")))
    coded = t.raw("documents").where("length(text) > 0").select("doc_id", tx.encode_offsets(spans).alias("coded"))
    return coded.select("doc_id", F.array_join(F.col("coded").cast("array<string>"), ",").alias("flat"), F.size(tx.decode_offsets(F.col("coded"))).cast("long").alias("spans"))


@query(sql=r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents")
def e6_evidence_tokens(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", tx.token_count(F.col("text")).cast("long").alias("n"))


@query(sql="SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: true), ' ') AS text FROM documents WHERE length(text) > 0")
def s14_abstracts(t: Tables) -> DataFrame:
    inverted = t.raw("documents").where("length(text) > 0").select("doc_id", tx.inverted_of(F.split("text", " ")).alias("inverted"))
    return inverted.select("doc_id", tx.abstract_of(F.col("inverted")).alias("text"))


@query(sql="SELECT doc_id, array_to_string(list_filter([-1, 0, doc_id % 7, n, n + 3, n - 1], lambda x: x >= 0 AND x < n), ',') AS kept FROM (SELECT doc_id, doc_id % 11 AS n FROM documents)")
def t42_bounded_citations(t: Tables) -> DataFrame:
    d = t.raw("documents").select("doc_id", (F.col("doc_id") % 11).alias("n"))
    given = F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.col("doc_id") % 7, F.col("n"), F.col("n") + 3, F.col("n") - 1)
    return d.select("doc_id", F.array_join(tx.bounded_citations(given, F.col("n")).cast("array<string>"), ",").alias("kept"))


def _uuid(salt: str) -> Column:
    h = F.md5(F.concat(F.lit(salt), F.col("doc_id").cast("string")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _uuid_sql(salt: str) -> str:
    h = f"md5('{salt}' || doc_id)"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"


@query(sql=f"SELECT doc_id, {_uuid_sql('a')} || ',' || {_uuid_sql('b')} AS images FROM documents")
def t29_embedded_images(t: Tables) -> DataFrame:
    body = F.concat(F.lit("Text ![one](<fact:"), _uuid("a"), F.lit(">) more ![](<"), _uuid("b"), F.lit(">)\n![again]("), _uuid("a"), F.lit(") [no]("), _uuid("c"), F.lit(")"))
    return t.raw("documents").select("doc_id", F.array_join(tx.embedded_images(body), ",").alias("images"))


@query(sql=f"SELECT doc_id, {_uuid_sql('a')} || ',' || {_uuid_sql('b')} || ',' || {_uuid_sql('d')} AS cited FROM documents")
def t30_direct_citations(t: Tables) -> DataFrame:
    said = F.concat(F.lit("As fact: "), F.upper(_uuid("a")), F.lit(" and < "), _uuid("b"), F.lit("> say ```<"), _uuid("c"), F.lit(">``` (concept:"), _uuid("d"), F.lit("), fact:"), _uuid("a"), F.lit("."))
    return t.raw("documents").select("doc_id", F.array_join(tx.direct_citations(said), ",").alias("cited"))


_SALVAGED = [('say [1, 2] and [3]', "[1, 2]"), ('{"a": ["b]", "c"]} tail', '["b]", "c"]'), ("none", None), ("[[1], [2]] x", "[[1], [2]]"), ("[open", None)]


@query(sql=f"SELECT doc_id, {_pick_sql([b for _, b in _SALVAGED], 'doc_id')} AS found FROM documents")
def t43_salvaged_arrays(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", salvaged(_pick([a for a, _ in _SALVAGED], "doc_id")).alias("found"))


@query(sql=r"SELECT conv_id, turn, len(list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1:20], lambda x: regexp_matches(x, '^(#|- |\* |> |\| |1\. |```)'))) > 0 AS markdown FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '# ' || text WHEN 1 THEN text || chr(10) || '- item' ELSE text END AS text FROM conversations)")
def p24_markdown(t: Tables) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("# "), "text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit("\n- item"))).otherwise(F.col("text"))
    return t.raw("conversations").select("conv_id", "turn", tx.looks_like_markdown(text).alias("markdown"))


@query(sql="SELECT fact_id, trim(concat_ws(' ', name, context)) AS text FROM (SELECT fact_id, name, CASE WHEN length(name) % 2 = 0 THEN context END AS context FROM fact_concepts)".join([with_tables("fact_concepts"), ""]))
def v6_embedded_text(t: Tables) -> DataFrame:
    return t.fact_concepts.select("fact_id", vec.concept_text(F.col("name"), F.when(F.length("name") % 2 == 0, F.col("context"))).alias("text"))


# ---- failures --------------------------------------------------------------------------------------------------------


def _like(patterns, op: str) -> str:
    return "(" + " OR ".join(f"e {op} {_quoted(p)}" for p in patterns) + ")"


def _sample(pattern: str) -> str:
    return pattern.replace("%", " .. ").strip()


_SILENT = [_sample(p) for _, patterns, _ in tx.SILENT_FAILURES for p in patterns] + ["plain page", "page not found" + " x" * 300]
_SILENT_SQL = " ".join(f"WHEN {_like(p, 'ILIKE')}{f' AND length(e) < {most}' if most else ''} THEN {_quoted(n)}" for n, p, most in tx.SILENT_FAILURES)


@query(sql=f"SELECT doc_id, CASE {_SILENT_SQL} ELSE 'other_short' END AS kind FROM (SELECT doc_id, {_pick_sql(_SILENT, 'doc_id')} AS e FROM documents)")
def p14_silent_failures(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", tx.silent_failure(_pick(_SILENT, "doc_id")).alias("kind"))


_ATTEMPT = [_sample(p).upper() if i % 2 else _sample(p) for i, p in enumerate(p for _, patterns in tx.ATTEMPT_ERRORS for p in patterns)] + [None, "", "boom"]
_ATTEMPT_SQL = " ".join(f"WHEN {_like(p, 'ILIKE')} THEN {_quoted(n)}" for n, p in tx.ATTEMPT_ERRORS)


@query(sql=f"SELECT event_id, CASE {_ATTEMPT_SQL} WHEN e IS NULL OR e = '' THEN 'no_error_field' ELSE 'other' END AS mode FROM (SELECT event_id, {_pick_sql(_ATTEMPT, 'event_id')} AS e FROM events)")
def p15_attempt_errors(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", tx.attempt_error(_pick(_ATTEMPT, "event_id")).alias("mode"))


_SOURCE = [" ".join(_sample(g[i % len(g)]) for g in groups) for _, groups, _ in tx.SOURCE_ERRORS for i in (0, 1)] + [tx.BACKFILLED_ERROR, "boom", "extracted content below minimum length after status 404"]
_SOURCE_SQL = " ".join(
    "WHEN " + " AND ".join([_like(g, "LIKE") for g in groups] + [f"NOT e LIKE {_quoted(p)}" for p in never]) + f" THEN {_quoted(n)}" for n, groups, never in tx.SOURCE_ERRORS
)


@query(sql=f"SELECT event_id, CASE WHEN e = {_quoted(tx.BACKFILLED_ERROR)} THEN 'AA_backfilled_silent_failure' {_SOURCE_SQL} ELSE 'Z_other' END AS mode FROM (SELECT event_id, {_pick_sql(_SOURCE, 'event_id')} AS e FROM events)")
def p16_source_errors(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", tx.source_error(_pick(_SOURCE, "event_id")).alias("mode"))


_BACKFILL = [_sample(p) for p in tx.BACKFILL_PATTERNS] + ["a good page", None]


@query(sql=f"SELECT doc_id, coalesce({_like(tx.BACKFILL_PATTERNS, 'ILIKE')}, false) AS failed FROM (SELECT doc_id, {_pick_sql(_BACKFILL, 'doc_id')} AS e FROM documents)")
def p17_backfilled(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", tx.backfill_failed(_pick(_BACKFILL, "doc_id")).alias("failed"))


_LEAKS = [f"{p} src=x>" for p in tx.HTML_LEAK_PREFIXES] + ["<IFRAME TITLE=\"GOOGLE TAG MANAGER\">", "plain", None]


@query(sql=f"SELECT doc_id, coalesce({' OR '.join(f'starts_with(lower(left(e, 200)), {_quoted(p)})' for p in tx.HTML_LEAK_PREFIXES)}, false) AS leak FROM (SELECT doc_id, {_pick_sql(_LEAKS, 'doc_id')} AS e FROM documents)")
def p12_html_leaks(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", tx.is_html_leak(_pick(_LEAKS, "doc_id")).alias("leak"))


# ---- links and names -------------------------------------------------------------------------------------------------

_DOIS = ["10.1000/xyz", "https://doi.org/10.5/a", " http://dx.doi.org/10.6/b ", "https://example.org/10.7/c", "see doi.org/10.8/d", "https://doi.org/http://doi.org/10.9/e"]
_DOI_SQL = "trim(e)"
for _p in tx.DOI_PREFIXES:
    _DOI_SQL = f"(CASE WHEN starts_with({_DOI_SQL}, '{_p}') THEN substr({_DOI_SQL}, {len(_p) + 1}) ELSE {_DOI_SQL} END)"


@query(sql=f"SELECT page_id, kind, CASE WHEN kind = 'doi' THEN trim({_DOI_SQL}) ELSE trim(e) END AS value, CASE WHEN kind = 'doi' THEN trim({_DOI_SQL}) END AS doi FROM (SELECT *, CASE WHEN starts_with(trim(e), '10.') OR contains(trim(e), 'doi.org/') THEN 'doi' ELSE 'url' END AS kind FROM (SELECT page_id, {_pick_sql(_DOIS, 'page_id')} AS e FROM pages))")
def p9_dois(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", tx.classify_url(_pick(_DOIS, "page_id")).alias("c")).select("page_id", "c.kind", "c.value", "c.doi")


_SAFE = ["http://example.org/a", "HTTPS://user@Example.org:80/", "http://10.1.2.3/", "http://127.0.0.1:99/x", "https://169.254.1.1", "http://192.168.0.9/", "http://172.20.1.1/", "http://172.40.1.1/", "http://localhost:8080/", "ftp://example.org/", "http:///x", "https://8.8.8.8/"]


@query(sql=rf"SELECT page_id, regexp_matches(lower(e), '^https?://[^/]') AND h <> '' AND NOT regexp_matches(h, '^(10|127|0)\.\d+\.\d+\.\d+$|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^localhost$') AS safe FROM (SELECT *, regexp_replace(regexp_extract(lower(e), 'https?://([^/]+)', 1), '^[^@]*@|:\d+$', '', 'g') AS h FROM (SELECT page_id, {_pick_sql(_SAFE, 'page_id')} AS e FROM pages))")
def p10_safe_urls(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", tx.safe_url(_pick(_SAFE, "page_id")).alias("safe"))


_MODELS = ["openai/GPT-4:free", " google/gemma-3 ", "a/b/c:beta", "plain", "x/y:nitro:free", "m:fp8"]


@query(sql=f"SELECT event_id, regexp_replace(regexp_replace(lower(trim(e)), ':(?:{'|'.join(tx.ROUTING_TAGS)})$', ''), '^[^/]*/', '') AS model FROM (SELECT event_id, {_pick_sql(_MODELS, 'event_id')} AS e FROM events)")
def p21_model_names(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", tx.normal_model(_pick(_MODELS, "event_id")).alias("model"))


_HOSTS = ["HTTP://User@Host.Example:80/x?y", " https://a.b ", "no link", "ftp://F.x/y", ""]


@query(sql=f"SELECT page_id, lower(coalesce(nullif(regexp_extract(trim(e), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1), ''), trim(e))) AS host, lower(nullif(regexp_extract(url, 'https?://([^/]+)', 1), '')) AS own FROM (SELECT page_id, url, {_pick_sql(_HOSTS, 'page_id')} AS e FROM pages)")
def p23_normal_hosts(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", tx.host_normal(_pick(_HOSTS, "page_id")).alias("host"), F.lower(tx.host_raw(F.col("url"))).alias("own"))


_RESOLVED = [("//cdn.x/a", "https://cdn.x/a"), ("https://o.org/q", "https://o.org/q"), ("/top", "https://h.org/top"), ("leaf", "https://h.org/a/b/leaf"), ("../up", "https://h.org/a/up"), ("./same", "https://h.org/a/b/same"), ("mailto:me", "mailto:me"), ("", "")]


@query(sql=f"SELECT page_id, {_pick_sql([b for _, b in _RESOLVED], 'page_id')} AS link FROM pages")
def s4_resolved_links(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", tx.resolve_url(_pick([a for a, _ in _RESOLVED], "page_id"), F.lit("https://h.org/a/b/page.html?x=1#y")).alias("link"))


@query(sql="SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m') || '-01' WHEN 2 THEN strftime(ts, '%Y') || '-01-01' END AS day FROM events")
def s15_partial_dates(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy")).otherwise("soon")
    return t.raw("events").select("event_id", F.date_format(tx.partial_date(raw), "yyyy-MM-dd").alias("day"))


@query(sql=r"SELECT doc_id, CASE WHEN length(e) > 80 THEN left(e, 80) || '...' ELSE e END AS snippet FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS e FROM documents)")
def s16_snippets(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", tx.snippet(F.regexp_replace("text", r"[^\x00-\x7F]", "x"), 80).alias("snippet"))


# ---- hosts -----------------------------------------------------------------------------------------------------------

_STATS = "SELECT {by}, count(*) AS total, count(*) FILTER (ok) AS successes, count(*) FILTER (bad) AS failures FROM (SELECT {by}, source_id, bool_or(success) AS ok, bool_or(NOT success) AS bad FROM attempts{where} GROUP BY ALL) GROUP BY {by}"


@query("attempts", sql="SELECT * FROM (" + _STATS.format(by="host", where=" WHERE provider = 'p1'") + ") WHERE failures >= 4")
def a6_failing_hosts(t: Tables) -> DataFrame:
    return hosts.failing(t.attempts, "p1", 4)


def _old_skips(t: Tables) -> DataFrame:
    rows = [(f"h{i}.example.com", f"p{i % 3}", 1.0, 5, None, i % 4 == 0) for i in range(13)]
    return t.spark.createDataFrame(rows, "host string, provider string, failure_rate double, sample_size long, expires_at timestamp, manual boolean")


_OLD = "old AS (SELECT 'h' || i || '.example.com' AS host, 'p' || (i % 3) AS provider, 1.0::DOUBLE AS rate, 5::BIGINT AS n, i % 4 = 0 AS manual FROM range(13) r(i))"
_LEARN = (
    with_tables("attempts").rstrip() + ", st AS (" + _STATS.format(by="provider, host", where="") + f"), {_OLD}, learned AS (SELECT host, provider, failures / total AS rate, total AS n, false AS manual FROM st WHERE total >= 10 AND failures / total >= 0.9), "
    "freed AS (SELECT host, provider FROM st WHERE successes > 0 AND failures / total < 0.9), skips AS (SELECT * FROM old WHERE manual UNION ALL SELECT * FROM old WHERE NOT manual AND (host, provider) NOT IN (SELECT (host, provider) FROM freed) "
    "AND (host, provider) NOT IN (SELECT (host, provider) FROM learned) UNION ALL SELECT * FROM learned WHERE (host, provider) NOT IN (SELECT (host, provider) FROM old WHERE manual))"
)


def _skips(t: Tables) -> DataFrame:
    return hosts.learn_skips(hosts.statistics(t.attempts, "provider", "host"), _old_skips(t), "2024-02-01", minimum=10, threshold=0.9)


@query(sql=_LEARN + " SELECT host, provider, round(rate, 6) AS failure_rate, n AS sample_size, manual FROM skips")
def t34_kept_and_freed_skips(t: Tables) -> DataFrame:
    return _skips(t).select("host", "provider", F.round("failure_rate", 6).alias("failure_rate"), "sample_size", "manual")


_CHAIN = "SELECT host, p, CASE WHEN p = pin THEN -1 ELSE i END AS o FROM (SELECT DISTINCT host, CASE WHEN host IN ('h1.example.com', 'h2.example.com') THEN 'p2' END AS pin FROM attempts), (VALUES ('p0', 0), ('p1', 1), ('p2', 2)) v(p, i)"


@query(sql=_LEARN + f", left_ AS (SELECT host, string_agg(p, ',' ORDER BY o) AS providers FROM ({_CHAIN}) WHERE (host, p) NOT IN (SELECT (host, provider) FROM skips) GROUP BY host) SELECT host, coalesce(providers, '') AS providers FROM (SELECT DISTINCT host FROM attempts) LEFT JOIN left_ USING (host)")
def t35_provider_chains(t: Tables) -> DataFrame:
    pinned = t.spark.createDataFrame([("h1.example.com", "p2"), ("h2.example.com", "p2")], "host string, provider string")
    return hosts.provider_chain(t.attempts, ["p0", "p1", "p2"], _skips(t), pinned).select("host", F.array_join("providers", ",").alias("providers"))


# ---- aliases, candidates, routing, contexts --------------------------------------------------------------------------

_ALIASES = "SELECT DISTINCT context AS concept_id, name AS alias FROM fact_concepts WHERE length(name) % 2 = 0"


@query("fact_concepts", sql=f"SELECT concept_id, alias FROM ({_ALIASES} UNION ALL SELECT DISTINCT context, name FROM fact_concepts WHERE length(name) % 2 = 1 UNION ALL SELECT DISTINCT context, 'x' || name FROM fact_concepts) WHERE length(alias) % 3 <> 0 GROUP BY ALL")
def t18_aliases(t: Tables) -> DataFrame:
    names = t.fact_concepts.select(F.col("context").alias("concept_id"), "name").distinct()
    own = names.where("length(name) % 2 = 0").select("concept_id", F.col("name").alias("alias"))
    more = names.select("concept_id", F.explode(F.array(F.when(F.length("name") % 2 == 0, F.upper("name")).otherwise(F.col("name")), F.concat(F.lit("x"), "name"))).alias("alias"))
    added = concepts.add_aliases(own, more)
    return concepts.prune_aliases(added, added.where("length(alias) % 3 = 0").withColumn("alias", F.upper("alias")))


@query(sql="SELECT fact_id, arg_max(error, seen) AS last_error, CAST(sum(n) AS INTEGER) AS attempts FROM (SELECT user_id AS fact_id, 'e' || minute(ts) AS error, ts AS seen, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN event_id % 3 ELSE 1 END AS n FROM events) GROUP BY 1")
def t19_skip_ledger(t: Tables) -> DataFrame:
    e = t.raw("events").select("event_id", F.col("user_id").alias("fact_id"), F.concat(F.lit("e"), F.minute("ts").cast("string")).alias("error"), F.col("ts").alias("at"))
    first = e.groupBy("fact_id").agg(F.min("event_id").alias("event_id"))
    old = e.join(first, ["fact_id", "event_id"]).select("fact_id", F.col("error").alias("last_error"), (F.col("event_id") % 3).cast("int").alias("attempts"), F.col("at").alias("last_attempt_at"))
    return concepts.record_skips(old, e.join(first, ["fact_id", "event_id"], "left_anti").select("fact_id", "error", "at")).select("fact_id", "last_error", "attempts")


@query("fact_concepts", sql="SELECT repository_id, name AS text_key, context AS context_key, name AS text, context, array_to_string(list_sort(list_distinct([left(name, 3), right(name, 3)])), ',') AS seeds FROM fact_concepts WHERE length(name) % 2 = 1 GROUP BY ALL")
def t14_candidates(t: Tables) -> DataFrame:
    known = t.fact_concepts.where("length(name) % 2 = 0").select("repository_id", F.upper("name").alias("text"), "context")
    seeds = F.array(F.substring("name", 1, 3), F.expr("right(name, 3)"))
    found = concepts.new_candidates(known, t.fact_concepts.select("repository_id", F.col("name").alias("text"), "context", seeds.alias("seeds")))
    return found.withColumn("seeds", F.array_join("seeds", ","))


@query(sql="""WITH n AS (SELECT DISTINCT regexp_extract(p_name, '[a-zA-Z]+') AS w, p_partkey FROM part), c AS (SELECT s_suppkey AS concept_id, n_name AS name, s_suppkey % 3 AS created FROM supplier JOIN nation ON n_nationkey = s_nationkey),
m AS (SELECT c_custkey AS fact_id, CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' ELSE n_name END AS mention FROM customer JOIN nation ON n_nationkey = c_nationkey), met AS (SELECT m.fact_id, m.mention, c.concept_id, c.created, CASE WHEN m.fact_id % 5 = 0 THEN NULL ELSE list_cosine_similarity(f.embedding::DOUBLE[], g.embedding::DOUBLE[]) END AS s
FROM m LEFT JOIN c ON c.name = m.mention LEFT JOIN embeddings f ON f.vec_id = m.fact_id % (SELECT count(*) FROM embeddings) LEFT JOIN embeddings g ON g.vec_id = c.concept_id % (SELECT count(*) FROM embeddings)),
r AS (SELECT *, count(concept_id) OVER (PARTITION BY fact_id) AS n, row_number() OVER (PARTITION BY fact_id ORDER BY coalesce(s, -1) DESC, created, concept_id) AS k FROM met)
SELECT fact_id, mention, CASE WHEN n > 1 AND fact_id % 5 = 0 THEN NULL ELSE concept_id END AS concept_id, CASE WHEN n = 0 THEN 'miss' WHEN n > 1 AND fact_id % 5 = 0 THEN 'deferred' ELSE 'linked' END AS outcome FROM r WHERE k = 1""")
def t16_disambiguation(t: Tables) -> DataFrame:
    nation = t.raw("nation")
    own = t.raw("supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    known = own.select(F.col("s_suppkey").alias("concept_id"), F.col("n_name").alias("name"), F.lit("c").alias("context"), F.lit("r").alias("repository_id"), F.timestamp_seconds(F.col("s_suppkey") % 3).alias("created_at"))
    names = concepts.named_concepts(known, t.spark.createDataFrame([], "concept_id long, alias string"))
    met = t.raw("customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    mentions = met.select(F.col("c_custkey").alias("fact_id"), F.lit("r").alias("repository_id"), F.lit("C").alias("context"), F.when(F.col("c_custkey") % 7 == 0, "nowhere").otherwise(F.col("n_name")).alias("mention"))
    vectors = t.raw("embeddings")
    number = vectors.count()
    of = lambda df, key: df.select(F.col(key), (F.col(key) % number).alias("vec_id")).join(vectors, "vec_id").select(key, "embedding")
    return concepts.route(mentions, names, of(known, "concept_id"), of(mentions.where("fact_id % 5 <> 0"), "fact_id"))


@query("fact_concepts", sql="""SELECT cid AS candidate_id, n.concept_id, CASE WHEN n.concept_id IS NULL THEN 'create' WHEN i > 0 THEN 'seed' WHEN canonical THEN 'canonical' ELSE 'alias' END AS how FROM (SELECT DISTINCT name AS cid FROM fact_concepts) c LEFT JOIN (
SELECT cid, i, concept_id, canonical, row_number() OVER (PARTITION BY cid ORDER BY i, NOT canonical, concept_id) AS k FROM (SELECT name AS cid, 0 AS i, CASE length(name) % 3 WHEN 0 THEN name WHEN 1 THEN reverse(name) ELSE 'zz' || name END AS key FROM (SELECT DISTINCT name FROM fact_concepts)
UNION ALL SELECT name, 1, name FROM (SELECT DISTINCT name FROM fact_concepts)) s JOIN (SELECT key, concept_id, bool_or(canonical) AS canonical FROM (SELECT DISTINCT name AS key, name AS concept_id, true AS canonical FROM fact_concepts WHERE length(name) % 2 = 0 UNION ALL SELECT DISTINCT reverse(name), name, false FROM fact_concepts WHERE length(name) % 2 = 0) GROUP BY ALL) USING (key)
) n USING (cid) WHERE coalesce(k, 1) = 1""")
def t17_refinement(t: Tables) -> DataFrame:
    one = t.fact_concepts.select("name").distinct()
    known = one.where("length(name) % 2 = 0").select(F.col("name").alias("concept_id"), "name", F.lit("en").alias("context"), F.lit("r").alias("repository_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    names = concepts.named_concepts(known, known.select("concept_id", F.reverse("name").alias("alias")))
    text = F.when(F.length("name") % 3 == 0, F.col("name")).when(F.length("name") % 3 == 1, F.reverse("name")).otherwise(F.concat(F.lit("zz"), "name"))
    asked = one.select(F.col("name").alias("candidate_id"), F.lit("r").alias("repository_id"), F.lit("EN").alias("context"), F.upper(text).alias("text"), F.array("name").alias("seeds"))
    return concepts.refine(asked, names)


def _migrated(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = concepts.concepts_of(t.fact_concepts).select("concept_id", "name", "context", F.lit("r").alias("repository_id"), F.lit(True).alias("embedded"))
    links = t.fact_concepts.select("fact_id", F.concat_ws("|", "name", "context").alias("concept_id"))
    return concepts.migrate_context(own, links, own.select("concept_id", F.substring("name", 1, 5).alias("alias")), "FR", "en")


_BOTH = "b AS (SELECT name FROM fact_concepts WHERE context = 'fr' INTERSECT SELECT name FROM fact_concepts WHERE context = 'en')"


@query(sql=with_tables("fact_concepts").rstrip() + f", {_BOTH} SELECT DISTINCT name || '|' || context AS concept_id, CASE WHEN context = 'fr' THEN 'en' ELSE context END AS context, NOT (context = 'en' AND name IN (SELECT name FROM b)) AS embedded FROM fact_concepts WHERE NOT (context = 'fr' AND name IN (SELECT name FROM b))")
def t23_migrated_concepts(t: Tables) -> DataFrame:
    return _migrated(t)[0].select("concept_id", "context", "embedded")


@query(sql=with_tables("fact_concepts").rstrip() + f", {_BOTH} SELECT DISTINCT fact_id, name || '|' || CASE WHEN context = 'fr' AND name IN (SELECT name FROM b) THEN 'en' ELSE context END AS concept_id FROM fact_concepts")
def t23_migrated_links(t: Tables) -> DataFrame:
    return _migrated(t)[1]


_FRESH = _GROUPS.replace("FROM fact_concepts", "FROM (SELECT * FROM fact_concepts WHERE source_id % 2 = 0)")


@query("fact_concepts", sql=f"SELECT * FROM ({_GROUPS}) WHERE NOT starts_with(name_key, 't') UNION ALL SELECT * FROM ({_FRESH}) WHERE starts_with(name_key, 't')")
def t20_refreshed_groups(t: Tables) -> DataFrame:
    some = t.fact_concepts.where("source_id % 2 = 0")
    links = some.select(F.concat_ws("|", "name", "context").alias("concept_id"), "fact_id")
    fresh = concepts.groups(concepts.concepts_of(some).withColumn("embedded", F.length("name") % 2 == 0), links)
    return concepts.refresh_groups(_groups(t), fresh, t.fact_concepts.where("name like 't%'").select(F.col("name").alias("name_key")).distinct())


@query("fact_concepts", sql="SELECT p, name, CASE context WHEN 'de' THEN 'german' WHEN 'fr' THEN 'FR' ELSE CASE p WHEN 'auto_add' THEN context ELSE 'general' END END AS context FROM (SELECT DISTINCT name, context FROM fact_concepts), (SELECT unnest(['skip', 'auto_add', 'catch_all']) AS p) WHERE p <> 'skip' OR context IN ('de', 'fr')")
def t24_inbound_contexts(t: Tables) -> DataFrame:
    rows = t.fact_concepts.select("name", "context").distinct()
    mapping, local = t.spark.createDataFrame([("german", "DE")], "local string, remote string"), t.spark.createDataFrame([("FR",)], "context string")
    out = None
    for p in ("skip", "auto_add", "catch_all"):
        part = concepts.map_inbound(rows, mapping, local, p).select(F.lit(p).alias("p"), "name", "context")
        out = part if out is None else out.unionByName(part)
    return out


@query("fact_concepts", sql="SELECT lower(name) AS name_key, arg_min(name, pos) AS name, CAST(sum(length(name)) AS BIGINT) AS total_fact_count, max(pos % 5) AS rank, array_to_string(list(context ORDER BY pos), ',') AS contexts FROM (SELECT name, context, min(source_id) * 10 + min(CASE context WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END) AS pos FROM fact_concepts GROUP BY name, context) GROUP BY 1 ORDER BY rank DESC, total_fact_count DESC, name LIMIT 40")
def r11_group_order(t: Tables) -> DataFrame:
    which = F.when(F.col("context") == "en", 0).when(F.col("context") == "fr", 1).when(F.col("context") == "de", 2).otherwise(3)
    hits = t.fact_concepts.groupBy("name", "context").agg((F.min("source_id") * 10 + F.min(which)).alias("pos"))
    hits = hits.select("name", "context", F.length("name").cast("long").alias("fact_count"), (F.col("pos") % 5).alias("rank"), "pos")
    return relational.page(concepts.grouped_hits(hits), F.desc("rank"), F.desc("total_fact_count"), "name", limit=40).withColumn("contexts", F.array_join("contexts", ","))


# ---- dedup upkeep ----------------------------------------------------------------------------------------------------


def _verdict(t: Tables) -> DataFrame:
    first = t.facts.groupBy("text").agg(F.min("fact_id").alias("winner"))
    return t.facts.join(first, "text").select(F.col("fact_id").alias("id"), F.when(F.col("winner") != F.col("fact_id"), F.col("winner")).alias("winner"))


_WON = "(SELECT *, min(fact_id) OVER (PARTITION BY text) AS w FROM facts)"


@query("facts", sql=f"SELECT DISTINCT w AS fact_id, CAST(source_id % 20 AS BIGINT) AS source_id, CAST(sidx % 3 AS BIGINT) AS sentence_index FROM {_WON}")
def t11_merged_references(t: Tables) -> DataFrame:
    refs = t.facts.select("fact_id", (F.col("source_id") % 20).alias("source_id"), (F.col("sidx") % 3).cast("long").alias("sentence_index"))
    return dedup.merge_references(refs, _verdict(t))


@query("facts", "fact_concepts", sql=f"SELECT DISTINCT w AS fact_id, name AS concept_id FROM fact_concepts JOIN (SELECT fact_id, w FROM {_WON}) USING (fact_id)")
def t11_merged_links(t: Tables) -> DataFrame:
    return dedup.merge_links(t.fact_concepts.select("fact_id", F.col("name").alias("concept_id")), _verdict(t))


_STATUS = "CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'stable' ELSE 'to_delete' END"


@query(sql=f"SELECT event_id AS id, {_STATUS} AS status FROM events WHERE event_id % 3 <> 2 AND NOT (event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-20' - INTERVAL 168 HOUR)")
def t13_cleanup(t: Tables) -> DataFrame:
    status = _pick(["new", "stable", "to_delete"], "event_id")
    return dedup.cleanup(t.raw("events").select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("created_at")), "2024-01-20").select("id", "status")


@query(sql="WITH f AS (SELECT event_id AS id, user_id AS source_id, event_id % 3 = 0 AND event_id % 5 <> 0 AS need FROM events), m AS (SELECT DISTINCT source_id FROM f WHERE need AND id % 101 = 0) SELECT id, need AND source_id NOT IN (SELECT source_id FROM m) OR id % 5 = 0 AS embedded, CASE WHEN need AND source_id NOT IN (SELECT source_id FROM m) THEN 'm2' WHEN id % 5 = 0 THEN 'm1' END AS model FROM f")
def t9_embed_pass(t: Tables) -> DataFrame:
    done = F.col("id") % 5 == 0
    facts = t.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), _pick(["new", "stable", "to_delete"], "event_id").alias("status"), "ts")
    facts = facts.select("id", "source_id", "status", F.when(done, F.col("ts")).alias("embedded_at"), F.when(done, "m1").alias("embedded_model"))
    out = dedup.embed_pass(facts, facts.where("id % 101 <> 0").select("id"), "m2", "2024-02-01")
    return out.select("id", F.col("embedded_at").isNotNull().alias("embedded"), F.col("embedded_model").alias("model"))


# ---- summaries, reports, scoring -------------------------------------------------------------------------------------


@query(sql="SELECT event_id, CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS stale FROM events")
def t27_stale_syntheses(t: Tables) -> DataFrame:
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    covered = F.when(F.col("event_id") % 4 == 0, arr("a", "b", "c")).when(F.col("event_id") % 4 == 1, arr("a")).when(F.col("event_id") % 4 == 3, arr("b", "a"))
    return t.raw("events").select("event_id", summaries.is_stale(covered, arr("a", "b")).alias("stale"))


@query(sql="SELECT user_id AS report_id, CAST(event_id AS BIGINT) AS idx, event_type AS fact_id, CASE WHEN event_id % 4 = 0 THEN 'supports' ELSE l END AS posture FROM (SELECT *, list_extract(['related', 'supports', 'contradicts', 'irrelevant', NULL], CAST(event_id % 5 + 1 AS INTEGER)) AS l FROM events) WHERE event_id % 4 = 0 OR l IN ('related', 'supports', 'contradicts')")
def t33_postures(t: Tables) -> DataFrame:
    rows = t.raw("events").select(F.col("user_id").alias("report_id"), F.col("event_id").cast("long").alias("idx"), F.col("event_type").alias("fact_id"), F.when(F.col("event_id") % 4 == 0, "supports").alias("posture"))
    labels = rows.select("report_id", "idx", "fact_id", _pick(["related", "supports", "contradicts", "irrelevant", None], "idx").alias("posture"))
    return reports.apply_posture(rows, labels).select("report_id", "idx", "fact_id", "posture")


@query("facts", sql="SELECT source_id, c AS chunk, trim(string_agg('[S' || sidx || '] ' || text, ' ' ORDER BY sidx)) AS text FROM facts, range(0, 400) r(c) WHERE sidx * 1100 + 900 > c * 2500 AND sidx * 1100 < c * 2500 + 2500 GROUP BY ALL")
def t6_chunk_labels(t: Tables) -> DataFrame:
    rows = t.facts.select("source_id", F.col("sidx").alias("idx"), "text", (F.col("sidx") * 1100).cast("long").alias("start"), (F.col("sidx") * 1100 + 900).cast("long").alias("end"))
    most = rows.groupBy("source_id").agg(F.max("end").alias("n"))
    chunks = most.select("source_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 2500))).alias("chunk"))
    return reports.chunk_labels(chunks.select("source_id", "chunk", (F.col("chunk") * 2500).alias("start"), (F.col("chunk") * 2500 + 2500).alias("end")), rows)


@query(sql="SELECT event_id, event_id % 3 <> 2 AS ok FROM events")
def e1_answer_match(t: Tables) -> DataFrame:
    said = F.concat(F.lit("The  answer IS "), F.upper("event_type"))
    gold = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(" indeed"))).when(F.col("event_id") % 3 == 1, "is").otherwise("nothing")
    return t.raw("events").select("event_id", evaluate.answer_match(said, gold).alias("ok"))


@query(sql="WITH p AS (SELECT event_type AS q, event_id, event_id % 3 = 0 AS ok, event_id % 5 = 1 AS refused FROM events WHERE event_id % 7 <> 3), s AS (SELECT q, ok AND NOT refused AS ok, refused FROM p), r AS (SELECT q, ok, refused FROM s UNION ALL SELECT 'all', ok, refused FROM s) SELECT q AS question_type, count(*) AS n, count(*) FILTER (ok) AS correct, count(*) FILTER (refused) AS refused, count(*) FILTER (NOT refused) AS substantive, count(*) FILTER (NOT refused AND NOT ok) AS hallucinated, round(avg(ok::INT), 6) AS accuracy FROM r GROUP BY 1")
def e2_scores_with_refusals(t: Tables) -> DataFrame:
    i = F.col("event_id")
    said = F.when(i % 7 == 3, " [LLM error]").when(i % 5 == 1, "Insufficient information..").otherwise(F.concat(F.lit("the "), "event_type"))
    gold = F.when(i % 3 == 0, F.col("event_type")).otherwise("nothing")
    return evaluate.score(t.raw("events").select(F.col("event_type").alias("question_type"), said.alias("prediction"), gold.alias("gold")))


@query(sql="SELECT round(avg(len(list_filter([l_partkey % 7, l_partkey % 5, l_suppkey % 3], lambda x: x = l_orderkey % 7)[1:1]) / 1.0), 6) AS recall_3 FROM lineitem")
def e4_recall_of_misses(t: Tables) -> DataFrame:
    pair = lambda c: F.struct(c.cast("string").alias("title"), F.lit("S").alias("source"))
    hits = F.array(pair(F.col("l_partkey") % 7), pair(F.col("l_partkey") % 5), pair(F.col("l_suppkey") % 3), pair(F.col("l_orderkey") % 7))
    return evaluate.recall_at(t.raw("lineitem").select(F.col("l_orderkey").alias("id"), hits.alias("hits"), F.array(pair(F.col("l_orderkey") % 7)).alias("gold")), [3])


@query(sql="SELECT avg((event_id % 4 IN (0, 1))::INT) AS coverage FROM events")
def e5_source_coverage(t: Tables) -> DataFrame:
    ids = F.when(F.col("event_id") % 4 < 2, F.array(F.col("event_type"))).when(F.col("event_id") % 4 == 2, F.array().cast("array<string>"))
    return evaluate.source_coverage(t.raw("events").select(ids.alias("source_ids")))


@query(sql="SELECT n_nationkey AS subject, n_name AS name FROM nation WHERE contains(lower(n_name), '1')")
def e7_triples(t: Tables) -> DataFrame:
    triples = t.raw("nation").select(F.col("n_nationkey").alias("subject"), F.col("n_name").alias("s"), F.lit("r").alias("r"), F.lit("o").alias("o"))
    return evaluate.triples_with(triples, "1").select("subject", F.col("s").alias("name"))


@query("vectors", sql="SELECT label, i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM vectors WHERE id % 3 <> 0) GROUP BY ALL)")
def v9_pooled_chunks(t: Tables) -> DataFrame:
    rows = vec.pooled(t.vectors.withColumn("mask", F.col("id") % 3 != 0), "label")
    return rows.select("label", F.posexplode("pooled").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


# ---- search ----------------------------------------------------------------------------------------------------------


@query("facts", sql=r"SELECT fact_id AS id, round(1 / (60 + rn), 9) AS score, rn AS fused, 'lexical' AS search_mode FROM (SELECT fact_id, row_number() OVER (ORDER BY n DESC, fact_id) - 1 AS rn FROM (SELECT fact_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x = 'tion')) AS n FROM facts) WHERE n > 0) WHERE rn >= 5 AND rn < 25")
def r10_lexical_fallback(t: Tables) -> DataFrame:
    found = search.hybrid_facts(t.facts.select(F.col("fact_id").alias("id"), "text"), t.vectors, "tion", None, limit=20, offset=5)
    return found.select("id", F.round("score", 9).alias("score"), F.col("fused").cast("long").alias("fused"), "search_mode")


@query("usage", sql="SELECT source_id, id, q AS query FROM (SELECT source_id, id, id % 5 - 1 AS q, min(CASE WHEN id % 5 = 0 THEN 99 ELSE id % 5 - 1 END) OVER (PARTITION BY source_id) AS b FROM usage WHERE id % 5 <> 1 + source_id % 3) WHERE CASE WHEN q < 0 THEN 99 ELSE q END = b")
def r14_first_query(t: Tables) -> DataFrame:
    hits = t.usage.where("id % 5 <> 1 + source_id % 3").select("source_id", "id", (F.col("id") % 5 - 1).alias("query"))
    return search.first_query_with_hits(hits, "source_id").select("source_id", "id", "query")


# ---- lists and catalog -----------------------------------------------------------------------------------------------


@query("facts", sql="SELECT text, source_count FROM (SELECT text, nullif(count(DISTINCT source_id), 1) AS source_count, max(source_id) AS created_at FROM facts GROUP BY text) ORDER BY source_count DESC NULLS LAST, created_at DESC, text LIMIT 60")
def r1_fact_list(t: Tables) -> DataFrame:
    rows = t.facts.groupBy("text").agg(F.nullif(F.count_distinct("source_id"), F.lit(1)).alias("source_count"), F.max("source_id").alias("created_at"))
    return relational.page(rows, *relational.fact_order(by_sources=True), "text", limit=60).select("text", "source_count")


@query("fact_concepts", sql=f"SELECT fact_id, name FROM (SELECT fact_id, name, source_id, lower(name) = lower('{NAME_A}') AS exact, starts_with(lower(name), left('{NAME_A}', 4)) AS prefix FROM fact_concepts) WHERE prefix ORDER BY exact DESC, length(name), source_id, fact_id, name LIMIT 50")
def r2_ranked_list(t: Tables) -> DataFrame:
    rows = t.fact_concepts.where(F.lower("name").startswith(NAME_A[:4])).withColumns({"rank": (F.lower("name") == NAME_A).cast("int"), "size": F.length("name"), "first_seen_at": F.col("source_id")})
    return relational.page(rows, F.desc("rank"), "size", "first_seen_at", "fact_id", "name", limit=50).select("fact_id", "name")


@query(sql="SELECT event_id, kind FROM (SELECT event_id, list_extract(['image', 'page', 'table'], CAST(event_id % 3 + 1 AS INTEGER)) AS kind, CASE WHEN event_id % 4 <> 0 THEN event_id % 50 END AS page_number, user_id AS position FROM events) ORDER BY kind <> 'page', page_number NULLS LAST, position, event_id LIMIT 80")
def r5_part_order(t: Tables) -> DataFrame:
    parts = t.raw("events").select("event_id", _pick(["image", "page", "table"], "event_id").alias("kind"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 50).alias("page_number"), F.col("user_id").alias("position"))
    return relational.page(parts, *relational.part_order(), "event_id", limit=80).select("event_id", "kind")


@query(sql="SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, max(length(text)) AS longest FROM conversations GROUP BY 1 UNION ALL SELECT -1 - n_nationkey, 0, 0, NULL FROM nation")
def j8_lateral_counts(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    outer = c.select("conv_id").distinct().unionByName(t.raw("nation").select((-1 - F.col("n_nationkey")).cast("long").alias("conv_id")))
    return relational.lateral_counts(outer, c, ["conv_id"], turns=F.count("text"), asked=F.count_if(F.col("role") == "user"), longest=F.max(F.length("text")).cast("long"))


@query(sql="SELECT lang, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents GROUP BY 1")
def a14_lengths(t: Tables) -> DataFrame:
    return relational.lengths(t.raw("documents"), "lang").withColumns({c: F.col(c).cast("long") for c in ("shortest", "longest")})


@query("sources", sql="SELECT source_id FROM sources WHERE url ILIKE '%src1%' OR text ILIKE '%thanedble%'")
def p6_catalog_search(t: Tables) -> DataFrame:
    return relational.search_any(t.sources, "SRC1", "url").select("source_id").union(relational.search_any(t.sources, "thanedble", "text").select("source_id")).distinct()


@query(sql="SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey WHEN s_suppkey % 4 = 1 THEN s_suppkey + 1 WHEN s_suppkey % 4 = 2 THEN s_suppkey + 2 END AS source_id, CASE s_suppkey % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'doi' WHEN 2 THEN 'hash' END AS how FROM supplier")
def t38_catalog_match(t: Tables) -> DataFrame:
    i = F.col("s_suppkey")
    rows = t.raw("supplier").select(i.alias("row_id"), F.when(i % 4 == 0, F.concat(F.lit("u"), i)).otherwise("none").alias("url"), F.when(i % 4 < 2, F.concat(F.lit("d"), i)).otherwise("").alias("doi"), F.when(i % 4 < 3, F.concat(F.lit("h"), i)).otherwise("x").alias("content_hash"))
    catalog = t.raw("supplier").select(F.explode(F.array(*[F.struct((i + k).alias("source_id"), *[(F.concat(F.lit(p), i) if j == k else F.lit("")).alias(c) for j, (p, c) in enumerate((("u", "url"), ("d", "doi"), ("h", "content_hash")))]) for k in range(3)])).alias("c")).select("c.*")
    return bundle.push_match(rows, catalog)


@query(sql="SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'nothing' WHEN event_id % 2 = 0 OR event_id % 5 = 0 THEN 'reembed' ELSE 'dedup' END AS plan FROM events")
def t39_reconcile_plans(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return t.raw("events").select("event_id", bundle.reconcile_plan(i % 3, F.when(i % 2 == 0, "other").otherwise("m"), F.when(i % 5 == 0, 3).otherwise(64), "m", 64).alias("plan"))


@query(sql="SELECT event_id, 'fact:a' AS keys FROM events")
def t40_synced_vectors(t: Tables) -> DataFrame:
    held = F.create_map(F.lit("fact:a"), F.array(F.lit(1.0)), F.lit("concept:b"), F.array(F.lit(2.0)))
    return t.raw("events").select("event_id", F.array_join(F.map_keys(bundle.sync_vectors(held, "facts")), ",").alias("keys"))


@query(sql="SELECT event_id FROM events WHERE event_type IN ('view', 'click', 'error') OR event_id % 7 = 0")
def p20_admitted(t: Tables) -> DataFrame:
    rows = t.raw("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("model"))
    return bundle.admitted(rows, "model", ["view", "click"], "error").select("event_id")


@query(sql="SELECT o_orderkey AS summary_id, array_to_string(list_transform(list_filter([o_custkey % 9, o_custkey % 4, 3], lambda x: x <> 2), lambda x: 'id' || x), ',') AS covered FROM orders")
def t37_remapped_coverage(t: Tables) -> DataFrame:
    ids = t.spark.range(20).where("id <> 2").select(F.col("id").alias("idx"), F.concat(F.lit("id"), F.col("id").cast("string")).alias("id"))
    rows = t.raw("orders").select(F.col("o_orderkey").alias("summary_id"), F.array(F.col("o_custkey") % 9, F.col("o_custkey") % 4, F.lit(3).cast("long")).alias("covered"))
    return bundle.remap_covered(rows, ids).select("summary_id", F.array_join("covered", ",").alias("covered"))


# ---- graph -----------------------------------------------------------------------------------------------------------


@query(sql=_MODEL + " SELECT coalesce(min(w) FILTER (c = 0), 10) AS w FROM (SELECT CAST(w AS INTEGER) AS w, count(*) FILTER (abs(z) < 1) AS c FROM z JOIN range(1, 21) r(w) ON weight >= w GROUP BY 1)")
def g7_recommended_weight(t: Tables) -> DataFrame:
    return graph.recommended_weight(graph.weight_sweep(graph.null_model(_edges(t), t.orders_parts)))


@query(sql="SELECT event_id AS item, CASE WHEN event_id % 5 > 0 THEN (event_id % 3) / (event_id % 5) END AS raw, CASE WHEN event_id % 5 > 1 THEN (event_id % 3) / (event_id % 5 - 1) END AS adjusted FROM events")
def g19_recall_audit(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return graph.recall_audit(t.raw("events").select(i.alias("item"), (i % 3).alias("matched"), (i % 5).alias("total"), F.when(i % 5 > 0, 1).otherwise(0).alias("noise")))


@query(sql=_MODEL + ", r AS (SELECT rank() OVER (ORDER BY weight) + (count(*) OVER (PARTITION BY weight) - 1) / 2 AS x, rank() OVER (ORDER BY round(z, 9)) + (count(*) OVER (PARTITION BY round(z, 9)) - 1) / 2 AS y FROM z) SELECT round(corr(x, y), 5) AS rho FROM r")
def g4_spearman_of_z(t: Tables) -> DataFrame:
    m = graph.null_model(_edges(t), t.orders_parts).select("weight", F.round("z", 9).alias("z"))
    return graph.spearman(m, "weight", "z").select(F.round("rho", 5).alias("rho"))


@query(sql=_EDGES + " SELECT weight, name_a, name_b FROM edges WHERE weight >= 2 AND weight < 5 ORDER BY md5(name_a || '-' || name_b), name_a, name_b LIMIT 20")
def g8_mid_band_sample(t: Tables) -> DataFrame:
    return graph.mid_band(_edges(t), 2, 5, 20).select("weight", "name_a", "name_b")
