"""Queries of the vector index, the labelled text index, communities and degree fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import communities, graph, ranked_text, search, vector_index
from .fixtures import Tables
from .queries import _EDGES, _NEAR, _TOKENS, NEAR, _edges, query


@query("vectors", sql=f"SELECT query_id, id, round(s, 6) AS score FROM ({_NEAR}) WHERE s >= {NEAR}")
def v4_near_pairs(t: Tables) -> DataFrame:
    """Every item as a query: all items at or above the threshold, by the bound on angles."""
    return vector_index.within(vector_index.build(t.vectors), t.vectors, NEAR).select("query_id", "id", F.round("score", 6).alias("score"))


@query("vectors", sql=f"SELECT query_id AS id, id AS hit, round(s, 6) AS score FROM ({_NEAR}) WHERE s >= {NEAR} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) = 1")
def t10_indexed_top_neighbours(t: Tables) -> DataFrame:
    """The pass' top neighbours from the index: exact."""
    found = vector_index.within(vector_index.build(t.vectors), t.vectors, NEAR, 1)
    return found.select(F.col("query_id").alias("id"), F.col("id").alias("hit"), F.round("score", 6).alias("score"))


@query()
def v4_indexed_neighbours(t: Tables) -> DataFrame:
    """The 5 best of every item by the tuned index."""
    index = vector_index.tuned(vector_index.build(t.vectors), t.vectors, 5)
    return vector_index.search(index, t.vectors, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vectors", sql="SELECT count(*) * least(5, count(*) - 1) AS wanted, true AS reached FROM vectors")
def v4_index_recall(t: Tables) -> DataFrame:
    """Recall of the tuned index over every item as a query, against the exact neighbours: at least 0.9."""
    index = vector_index.tuned(vector_index.build(t.vectors), t.vectors, 5)
    got = vector_index.recall(vector_index.search(index, t.vectors, 5), search.neighbours(t.vectors, t.vectors, 5))
    return got.select("wanted", (F.col("recall") >= 0.9).alias("reached"))


# ---- ranked text -----------------------------------------------------------------------------------------------------

_INVERSE = "CASE label WHEN 'A' THEN 1.0 WHEN 'D' THEN 10.0 END"


def _covers(hits: str, groups: list[str], key: str) -> str:
    """SQL for the rank of each key of hits (key, pos, lexeme, label): minimal covers by definition, over pairs of hits."""
    holds = " AND ".join(f"count(*) FILTER (h.lexeme IN ({g})) > 0" for g in groups)
    return f"""spans AS (SELECT DISTINCT a.{key}, a.pos AS b, z.pos AS e FROM {hits} a JOIN {hits} z ON z.{key} = a.{key} AND z.pos >= a.pos),
whole AS (SELECT s.{key}, b, e, count(*) AS n, sum({_INVERSE}) AS inv FROM spans s JOIN {hits} h ON h.{key} = s.{key} AND h.pos BETWEEN b AND e GROUP BY ALL HAVING {holds}),
covers AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM whole x WHERE x.{key} = w.{key} AND x.b >= w.b AND x.e <= w.e AND (x.b > w.b OR x.e < w.e))),
ranks AS (SELECT {key}, sum(n / inv / (1 + CASE WHEN e - b < n - 1 THEN (n - 1) // 2 ELSE e - b - (n - 1) END)) AS rank FROM covers GROUP BY 1)"""


_HITS = f"hits AS (SELECT fact_id, pos, w[pos] AS lexeme, 'D' AS label FROM (SELECT fact_id, w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT fact_id, {_TOKENS} AS w FROM facts)) WHERE w[pos] IN ('tion', 'erin', 'eren'))"


@query("facts", sql=f", {_HITS}, {_covers('hits', [repr('tion'), repr('erin') + ', ' + repr('eren')], 'fact_id')} SELECT fact_id, round(rank, 9) AS rank FROM ranks")
def f5_cover_density(t: Tables) -> DataFrame:
    index = ranked_text.occurrences(t.facts, "fact_id", (F.col("text"), "D"))
    found = ranked_text.cover_density(index, "fact_id", ranked_text.groups_of(search.parse_query("tion erin or eren")))
    return found.select("fact_id", F.round("rank", 9).alias("rank"))


_STOPS = ", ".join(repr(w) for w in search.STOP_WORDS)


def _words(text: str) -> str:
    return _TOKENS.replace("coalesce(text, '')", f"coalesce({text}, '')")


@query(
    "facts",
    sql=f""", named AS (SELECT source_id, max(text) FILTER (sidx = 0) AS name, max(text) FILTER (sidx = 1) AS description FROM facts GROUP BY 1 HAVING count(*) FILTER (sidx = 0) > 0),
t AS (SELECT source_id AS k, {_words("name")} AS a, {_words("description")} AS d FROM named),
lex AS (SELECT k, pos, a[pos] AS lexeme, 'A' AS label FROM (SELECT k, a, unnest(range(1, len(a) + 1)) AS pos FROM t) WHERE a[pos] NOT IN ({_STOPS})),
low AS (SELECT k, max(pos) AS last FROM lex GROUP BY 1),
two AS (SELECT k, pos + coalesce(last, 0) AS pos, d[pos] AS lexeme, 'D' AS label FROM (SELECT k, d, unnest(range(1, len(d) + 1)) AS pos FROM t) LEFT JOIN low USING (k) WHERE d[pos] NOT IN ({_STOPS})),
al AS (SELECT DISTINCT source_id AS c, text, {_words("text")} AS w FROM facts WHERE sidx IN (2, 3) AND source_id IN (SELECT source_id FROM named)),
three AS (SELECT 'a' || c || '|' || text AS k, pos, w[pos] AS lexeme, 'A' AS label FROM (SELECT c, text, w, unnest(range(1, len(w) + 1)) AS pos FROM al)),
hits AS (SELECT CAST(k AS VARCHAR) AS k, pos, lexeme, label FROM (SELECT * FROM lex UNION ALL SELECT * FROM two) WHERE lexeme IN ('the', 'tion', 'er', 'nt') UNION ALL SELECT * FROM three WHERE lexeme IN ('tion', 'er', 'nt')),
{_covers("hits", [repr("tion") + ", " + repr("er") + ", " + repr("nt")], "k")},
named_rank AS (SELECT CAST(k AS BIGINT) AS c, rank FROM ranks WHERE k NOT LIKE 'a%'),
alias_rank AS (SELECT CAST(regexp_extract(k, '^a([0-9]+)', 1) AS BIGINT) AS c, max(rank) AS rank FROM ranks WHERE k LIKE 'a%' GROUP BY 1)
SELECT c AS concept_id, round(coalesce(n.rank, 0), 9) AS name_rank, round(coalesce(a.rank, 0), 9) AS alias_rank, round(greatest(coalesce(n.rank, 0), coalesce(a.rank, 0)), 9) AS search_rank FROM named_rank n FULL JOIN alias_rank a USING (c)""",
)
def f6_search_rank(t: Tables) -> DataFrame:
    """Sources as concepts: the first sentence names one, the second describes it, the third and fourth are its aliases."""
    f = t.facts
    named = f.groupBy(F.col("source_id").alias("concept_id")).agg(F.max(F.when(F.col("sidx") == 0, F.col("text"))).alias("name"), F.max(F.when(F.col("sidx") == 1, F.col("text"))).alias("description")).where("name is not null")
    aliases = f.where("sidx in (2, 3)").select(F.col("source_id").alias("concept_id"), F.col("text").alias("alias"))
    found = ranked_text.search_rank(named, aliases, "tion or er or nt")
    return found.select("concept_id", *[F.round(c, 9).alias(c) for c in ("name_rank", "alias_rank", "search_rank")])


# ---- communities and degrees -----------------------------------------------------------------------------------------


@query()
def g12_louvain(t: Tables) -> DataFrame:
    """Communities of the whole part graph: how many, and their modularity."""
    edges = graph._saved(_edges(t))  # read by both below, more than once
    labels = graph._saved(communities.louvain(edges))
    return labels.agg(F.count_distinct("label").alias("communities")).crossJoin(graph.modularity(edges, labels))


@query(
    sql=_EDGES
    + """, h AS (SELECT CAST(k AS DOUBLE) AS d, count(*) AS n FROM (SELECT name, count(*) AS k FROM (SELECT unnest([name_a, name_b]) AS name FROM edges) GROUP BY 1) GROUP BY 1),
t AS (SELECT a.d AS low, b.d, b.n, sum(b.n) OVER (PARTITION BY a.d ORDER BY b.d DESC) AS f FROM h a JOIN h b ON b.d >= a.d),
fit AS (SELECT low, sum(n) AS total, 1 + sum(n) / sum(n * ln(d / (low - 0.5))) AS alpha FROM t GROUP BY 1 HAVING count(*) >= 2),
gaps AS (SELECT low, any_value(total) AS n, any_value(alpha) AS alpha, max(greatest(abs(f / total - pow((d - 0.5) / (low - 0.5), 1 - alpha)), abs((f - n) / total - pow((d + 0.5) / (low - 0.5), 1 - alpha)))) AS distance FROM t JOIN fit USING (low) GROUP BY low)
SELECT CAST(n AS BIGINT) AS n, low, round(alpha, 6) AS alpha, round((alpha - 1) / sqrt(n), 6) AS sigma, round(distance, 6) AS distance,
CASE WHEN (alpha - 1) / sqrt(n) < 0.5 THEN 'strongest' WHEN (alpha - 1) / sqrt(n) < 0.8 THEN 'strong' WHEN (alpha - 1) / sqrt(n) < 1 THEN 'moderate' WHEN (alpha - 1) / sqrt(n) < 1.3 THEN 'weak' ELSE 'super-weak' END AS taxonomy FROM gaps ORDER BY round(distance, 9), low LIMIT 1"""
)
def g10_power_law(t: Tables) -> DataFrame:
    return communities.power_law(_edges(t)).select("n", "low", *[F.round(c, 6).alias(c) for c in ("alpha", "sigma", "distance")], "taxonomy")
