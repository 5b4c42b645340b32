"""Report annotation; T30: direct citations; context windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.segment import sentences
from ..functions.vectors import cosine
from .search import matches, neighbours, parse_query, tokens

# Defaults of annotation.
MIN_RUNES, BUDGET, THRESHOLD, SEMANTIC_FLOOR = 40, 5, 0.7, 0.6


def report_sentences(reports: DataFrame) -> DataFrame:
    """(report_id, idx, text) of every sentence of a report's Markdown body."""
    rows = reports.select(F.col("id").alias("report_id"), F.explode(sentences(F.col("body"))).alias("s"))
    return rows.select("report_id", F.col("s.idx").alias("idx"), F.col("s.text").alias("text"))


def candidates(rows: DataFrame, least: int = MIN_RUNES) -> DataFrame:
    """Sentences long enough to carry a claim; a bare image citation always is."""
    return rows.where((F.length("text") >= least) | tx.is_bare_image_citation(F.col("text")))


def direct(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """(report_id, idx, fact_id, pos) of facts cited in a sentence; kinds: (id, kind); concepts are left out."""
    cited = rows.select("report_id", "idx", F.posexplode(tx.direct_citations(F.col("text"))).alias("pos", "id"))
    return cited.join(kinds.where("kind = 'fact'"), "id").select("report_id", "idx", F.col("id").alias("fact_id"), "pos")


def numeric_hits(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """(report_id, idx, fact_id): facts that hold every number of a sentence, and one spelling of each unit.

    Numbers are the join key: each sentence and each fact gives its distinct numbers, a sentence needs all of its own.
    """
    number = F.transform(F.regexp_extract_all("text", F.lit(f"({tx.NUMERIC_TOKEN})"), 1), lambda x: F.regexp_extract(F.lower(F.trim(x)), r"^(\d+(?:[.,]\d+)?%?)", 1))
    want = rows.select("report_id", "idx", F.col("text").alias("sentence"), F.array_distinct(number).alias("numbers")).where(F.size("numbers") > 0)
    have = facts.select("fact_id", F.col("text").alias("fact"), F.explode(F.array_distinct(number)).alias("number"))
    met = want.select("*", F.explode("numbers").alias("number")).join(have, "number").groupBy("report_id", "idx", "fact_id").agg(F.count(F.lit(1)).alias("n"), F.first("numbers").alias("numbers"), F.first("sentence").alias("sentence"), F.first("fact").alias("fact"))
    met = met.where(F.col("n") == F.size("numbers"))
    spelled = F.create_map(*[x for u, names in tx.UNIT_ALIASES.items() for x in (F.lit(u), F.array(*[F.lit(n) for n in (u, *names)]))])
    units = F.filter(F.transform(tx.numeric_tokens(F.col("sentence")), lambda t: F.regexp_extract(t, r"\s+(\S+)$", 1)), lambda u: u != "")
    words = F.flatten(F.transform(tokens(F.col("fact")), lambda w: F.array(w, F.regexp_replace(w, r"^\d+", ""))))
    fits = F.forall(units, lambda u: F.arrays_overlap(words, F.coalesce(F.try_element_at(spelled, u), F.array(u))))
    return met.where(fits).select("report_id", "idx", "fact_id")


def annotate(rows: DataFrame, vectors: DataFrame, facts: DataFrame, fact_vectors: DataFrame, kinds: DataFrame, claims: DataFrame | None = None, budget: int = BUDGET, threshold: float = THRESHOLD, floor: float = SEMANTIC_FLOOR, least: int = MIN_RUNES) -> DataFrame:
    """(report_id, idx, fact_id, score, posture) of each candidate sentence.

    Direct citations (score 1, supports) come first and outside the budget, but use it up; then the nearest facts at
    the threshold, then facts with the same numbers whose cosine is not below the floor.  No fact twice in a sentence.
    Without a classifier the posture of what was retrieved is null.  rows, vectors: (report_id, idx, text / embedding).
    """
    cand = candidates(rows, least)
    cited = direct(cand, kinds)
    key = F.struct("report_id", "idx")
    asked = cand.select("report_id", "idx").join(vectors, ["report_id", "idx"]).select(F.to_json(key).alias("id"), "embedding")
    near = neighbours(asked, fact_vectors.select("id", "embedding"), budget, threshold, False)
    near = near.select(F.from_json("query_id", "report_id long, idx int").alias("k"), F.col("id").alias("fact_id"), "score", F.lit(1).alias("channel"), F.col("rank").cast("long").alias("o")).select("k.*", "fact_id", "score", "channel", "o")
    num = numeric_hits(cand if claims is None else claims, facts)
    num = num.join(vectors.select("report_id", "idx", F.col("embedding").alias("sv")), ["report_id", "idx"], "left").join(fact_vectors.select(F.col("id").alias("fact_id"), F.col("embedding").alias("fv")), "fact_id", "left")
    sim = F.coalesce(F.when(F.col("sv").isNotNull() & F.col("fv").isNotNull(), cosine(F.col("sv"), F.col("fv"), 0.0)), F.lit(0.0))
    num = num.withColumn("score", sim).where(F.lit(floor <= 0) | (F.col("score") >= floor)).select("report_id", "idx", "fact_id", "score", F.lit(2).alias("channel"), F.lit(0).cast("long").alias("o"))
    found = near.unionByName(num).join(cited.select("report_id", "idx", "fact_id"), ["report_id", "idx", "fact_id"], "left_anti")
    once = found.groupBy("report_id", "idx", "fact_id").agg(F.min_by(F.struct("score", "channel", "o"), F.struct("channel", "o")).alias("b"))
    used = cited.groupBy("report_id", "idx").agg(F.count(F.lit(1)).alias("used"))
    w = Window.partitionBy("report_id", "idx").orderBy("b.channel", F.desc("b.score"), "fact_id")
    kept = once.withColumn("r", F.row_number().over(w)).join(used, ["report_id", "idx"], "left").where(F.col("r") <= F.lit(budget) - F.coalesce("used", F.lit(0)))
    retrieved = kept.select("report_id", "idx", "fact_id", F.col("b.score").alias("score"), F.lit(None).cast("string").alias("posture"))
    return cited.select("report_id", "idx", "fact_id", F.lit(1.0).alias("score"), F.lit("supports").alias("posture")).unionByName(retrieved)


def apply_posture(annotations: DataFrame, labels: DataFrame) -> DataFrame:
    """Retrieved pairs that the classifier left out or called irrelevant go; the others take its label."""
    given = labels.where("posture in ('related', 'supports', 'contradicts')").select("report_id", "idx", "fact_id", F.col("posture").alias("label"))
    done = annotations.where("posture is null").drop("posture").join(given, ["report_id", "idx", "fact_id"]).withColumnRenamed("label", "posture")
    return annotations.where("posture is not null").unionByName(done)


def context_windows(rows: DataFrame, n: int = 2) -> DataFrame:
    """Each sentence with the n before and the n after it in its report."""
    w = Window.partitionBy("report_id").orderBy("idx")
    return rows.withColumns({"before": F.collect_list("text").over(w.rowsBetween(-n, -1)), "after": F.collect_list("text").over(w.rowsBetween(1, n))})


def search_reports(reports: DataFrame, q: str) -> DataFrame:
    """P5 on bodies; with full-text syntax through search.full_text."""
    return reports.where(F.col("body").ilike(f"%{q}%")) if q else reports


def numeric_text_query(rows: DataFrame, text: str) -> DataFrame:
    """Facts that match a sentence's words by the full-text rules (F3's prose fallback)."""
    from .search import lexemes

    return rows.where(matches(lexemes(F.col("text")), parse_query(text)))


def chunk_labels(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """(source_id, chunk, text): the sentences that overlap a chunk as `[Sn] text `, trimmed.

    chunks, rows: (source_id, chunk / idx, start, end[, text]); an end equal to a start does not overlap.  Each chunk
    and sentence is entered under the spans of 1,000 characters it touches, so the overlap is an equi-join.
    """
    spans = lambda: F.explode(F.sequence(F.floor(F.col("start") / 1000), F.floor((F.greatest("end", F.col("start") + 1) - 1) / 1000)))
    c = chunks.select("source_id", "chunk", F.col("start").alias("cs"), F.col("end").alias("ce"), spans().alias("span"))
    s = rows.select("source_id", "idx", "text", "start", "end", spans().alias("span"))
    met = c.join(s, ["source_id", "span"]).where("end > cs and start < ce").select("source_id", "chunk", "idx", "text").distinct()
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.concat(F.lit("[S"), x["idx"].cast("string"), F.lit("] "), x["text"]))
    return met.groupBy("source_id", "chunk").agg(F.trim(F.array_join(parts, " ")).alias("text"))
