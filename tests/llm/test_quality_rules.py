"""Quality rules against a plain version."""

import duckdb
import numpy as np
import pytest

from . import brute

SF = "/root/testdata/sf0.001"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
TEXT = " ".join(f"word{i}" for i in range(80))
EDGES = [
    (1, None), (2, ""), (3, " \n\t\x0b\n"), (4, "one"), (5, "a b c a b c"), (6, "a a a a a"), (7, TEXT), (7, TEXT), (None, TEXT + " ä😀 #*$"), (8, "x\ny\nx\n \n\ny\r\nx"), (9, (TEXT + "\n") * 900),
    (10, "a b c d a b c e f a b"), (11, "b c d " * 40), (12, "  nbsp em"), (13, TEXT.upper() + "!! &&"),
]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1, 2.0) for d, t in docs], "doc_id long, text string, words string, n_words int, score double")


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("which", ["table", "edges", "empty"])
def test_base_rules(spark, which):
    from factloom.llm import quality_rules

    docs = {"table": duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall(), "edges": EDGES, "empty": []}[which]
    got = quality_rules.report(frame(spark, docs), labelled(spark, [])).select("doc_id", *BASE, "kept").collect()
    want = [(d, *(b := brute.base_rules(t))[:6], not b[5]) for d, t in docs]  # without labels the base rules decide
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_trusted(spark):
    from factloom.llm import quality_rules

    rows = [(i, 1, 0) for i in range(100)] + [(100, 0, 0), (101, 1, 1), (102, 1, 0), (102, 0, 0), (103, 1, None), (None, 1, 0), (104, None, 0)]
    got = quality_rules.trusted(labelled(spark, rows)).collect()
    assert sorted(r["id"] for r in got) == [*range(100), 103] and 5 < sum(r["held_out"] for r in got) < 40
    some = quality_rules.trusted(labelled(spark, [(i, 1, 0) for i in range(3000)]), most=300).count()
    assert 200 < some < 400


def test_scores_and_verdicts(spark):
    from factloom.llm import quality_rules

    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall() + EDGES
    labels = labelled(spark, duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall())
    chosen = quality_rules.trusted(labels).collect()
    good, held = ({r["id"] for r in chosen if r["held_out"] == x} for x in (False, True))
    want = brute.likelihood_scores(docs, good, 1 << 10)
    got = quality_rules.report(frame(spark, docs), labels, buckets=1 << 10, min_trusted=3, slack=0.0, percentile=0.25).select("doc_id", "base_failed", "score", "kept").collect()
    key = lambda x: (str(x[0]), x[1] is None, x[1] or 0)
    for (d, s), r in zip(sorted(((d, s) for (d, _), s in zip(docs, want)), key=key), sorted(got, key=lambda r: key((r["doc_id"], r["score"])))):
        assert d == r["doc_id"] and (s is None) == (r["score"] is None) and (s is None or abs(s - r["score"]) < 1e-6)
    least = np.percentile([s for (d, _), s in zip(docs, want) if d in held and s is not None], 25)
    for r in got:
        assert r["kept"] == (not r["base_failed"] and r["score"] >= least - 1e-9) or abs(r["score"] - least) < 1e-6
    assert 0 < sum(r["kept"] for r in got) < sum(not r["base_failed"] for r in got)


def test_junk_goes_and_clean_text_stays(spark):
    from factloom.llm import quality_rules

    rng = np.random.default_rng(4)
    vocabulary = [f"common{i}" for i in range(400)]
    clean = [(i, " ".join(rng.choice(vocabulary, 120))) for i in range(400)]
    junk = [(1000 + i, " ".join(rng.choice(vocabulary, 120)).upper().replace(" ", "!! ")) for i in range(60)]
    labels = labelled(spark, [(i, 1, 0) for i in range(200)] + [(1000 + i, 0, 0) for i in range(20)])
    kept = {r["doc_id"] for r in quality_rules.clean(frame(spark, clean + junk), labels).collect()}
    assert len(kept & {d for d, _ in clean}) >= 398 and not kept & {d for d, _ in junk}
    assert quality_rules.clean(frame(spark, clean), labels).columns == frame(spark, clean).columns


def test_no_python_in_the_plan(spark):
    from factloom.llm.queries import op12_quality_rules

    plan = op12_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_all_labelled_documents_count_and_the_percentile_is_exact(spark):
    from factloom.llm import quality_rules

    many = spark.range(70_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality_rules.trusted(many).count() == 70_000
    scores = np.random.default_rng(1).normal(size=3001)
    df = spark.createDataFrame([(float(x),) for x in scores] + [(None,)], "score double")
    for p in (0.0, 0.005, 0.25, 1.0):
        found = quality_rules._low(df, p)
        assert found["n"] == 3001 and found["low"] == pytest.approx(np.percentile(scores, 100 * p), abs=2e-9)
    assert quality_rules._low(df.limit(0), 0.5) == {"n": 0, "low": None}


def test_windows_whose_hashes_agree_are_compared_by_their_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from factloom.llm import quality_rules

    docs = [(1, "a b c d e f g h i j"), (2, "a b c x a b c y a b d"), (3, "b c d " * 40), (4, "a b")]
    plain = quality_rules._next
    monkeypatch.setattr(quality_rules, "_next", lambda array, f: plain(array, f if array != "_two" else lambda x, y: F.lit(7).cast("long")))
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measured(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: brute.base_rules(t)[4] for d, t in docs}


def test_words_and_pairs_are_hashed_once(spark, monkeypatch):
    from factloom.llm import quality_rules

    docs, plans, plain = spark.createDataFrame(EDGES, "doc_id long, text string"), [], quality_rules.cut
    monkeypatch.setattr(quality_rules, "cut", lambda df: plans.append(df) or plain(df))
    table = quality_rules.weights(docs, spark.createDataFrame([(9, False)], "id long, held_out boolean"))
    plans = [plans[0], quality_rules._scored(quality_rules.measured(docs), table, quality_rules.BUCKETS)]
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") for df in plans] == [2, 3]  # windows are hashed, too
