"""Operators on small inputs whose results are known."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.segment import salvage_array, segment
from factloom.operators import concepts, dedup, graph, relational, search
from factloom.sources import bundle, pages


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_rank_fusion_counts_from_zero(spark):
    lex = spark.createDataFrame([("x", 0), ("both", 1)], "id string, rank int")
    sem = spark.createDataFrame([("both", 0), ("y", 1)], "id string, rank int")
    fused = search.fuse(lex, sem, 0).orderBy("fused").collect()
    assert [r["id"] for r in fused] == ["both", "x", "y"]
    assert fused[1]["score"] == pytest.approx(1 / 60)


def test_a_winner_may_lose_later():
    chain = pd.DataFrame({"id": [1, 2, 3], "status": ["new"] * 3, "hit": [2.0, 1.0, 1.0]})
    out = dedup.fold(chain).set_index("id")
    assert out.loc[2, "new_status"] == "to_delete" and out.loc[1, "new_status"] == "to_delete" and out.loc[3, "new_status"] == "stable"
    assert out.loc[2, "winner"] == 3


def test_phrases(spark):
    df = spark.createDataFrame([(1, "red apple tree"), (2, "apple red"), (3, None)], "id int, text string")
    assert rows(search.full_text(df, F.col("text"), '"red apple"'), "id") == [(1,)]
    assert rows(search.full_text(df, F.col("text"), "apple -tree"), "id") == [(2,)]


def test_numeric_tokens_are_cut_leftmost_first(spark):
    df = spark.createDataFrame([("5 min, 5 grams, 508kcal, 22.3%, 1,5 mg",)], "s string")
    assert df.select(tx.numeric_tokens(F.col("s"))).first()[0] == ["5 m", "5 g", "508kcal", "22.3%", "1,5 mg"]


def test_sentences_keep_offsets():
    text = "One. Two é! Three"
    found = segment(text)
    assert [text[a:b] for _, _, a, b in found] == ["One. ", "Two é! ", "Three"] or "".join(t for _, t, _, _ in found).replace(" ", "") == text.replace(" ", "")
    assert segment(None) == [] and segment("") == []


def test_salvaged_json():
    assert salvage_array('x [1, 2] y]') == "[1, 2]"
    assert salvage_array("none") is None and salvage_array(None) is None


def test_components_and_empty_graph(spark):
    e = spark.createDataFrame([(3, 2), (2, 1), (9, 8)], "u int, v int")
    assert rows(graph.components(e), "node", "root") == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]


def test_group_counts_rows_after_the_left_join(spark):
    c = spark.createDataFrame([("a", "X", True), ("b", "x", False)], "concept_id string, name string, embedded boolean")
    links = spark.createDataFrame([("a", "f1"), ("a", "f2")], "concept_id string, fact_id string")
    r = concepts.groups(c, links).first()
    assert (r["context_count"], r["context_count_compat"], r["total_fact_count"], r["any_embedded"]) == (2, 3, 2, True)


def test_paging_and_cursor():
    assert relational.clamp(0, -1) == (100, 0) and relational.clamp(500, 3) == (200, 3)
    assert relational.read_cursor(relational.cursor(120)) == 120


def test_bundle_round_trip(spark, tmp_path):
    t = {
        "sources": spark.createDataFrame([("s1", "u1", "t", "T")], "source_id string, url string, text string, title string"),
        "facts": spark.createDataFrame([("f1", "A fact."), ("f2", "B fact.")], "fact_id string, text string"),
        "concepts": spark.createDataFrame([("c1", "N", "ctx")], "concept_id string, name string, context string"),
        "fact_sources": spark.createDataFrame([("f1", "s1")], "fact_id string, source_id string"),
        "fact_concepts": spark.createDataFrame([("f2", "c1")], "fact_id string, concept_id string"),
    }
    bundle.export(t, str(tmp_path / "b"))
    back = bundle.import_bundle(t, bundle.load(spark, str(tmp_path / "b")), "new")
    assert {n: df.count() for n, df in back.items()} == {n: df.count() for n, df in t.items()}


def test_pages():
    assert pages.read_page("")["error"] == "empty input"
    assert pages.read_page("<html><body><nav>no</nav><article><p>Yes &amp; no</p></article></body></html>")["text"] == "Yes & no"


def test_path_lengths_reach_to_the_end(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", 1) for i in range(40)]
    edges = spark.createDataFrame([*chain, ("x", "y", 1)], "name_a string, name_b string, weight int")
    starts = graph.path_starts(edges)
    assert {r["name"] for r in starts.collect()} == {f"n{i:02d}" for i in range(41)}
    one = graph.path_lengths(edges, starts.where("name = 'n00'")).first()
    assert (one["mean_path"], one["diameter"]) == (pytest.approx(20.5), 40)
    assert graph.path_starts(edges, whole=10, drawn=3).count() == 3
    assert graph.path_lengths(edges, starts.limit(0)).first()["mean_path"] is None


def test_trimmed_pieces_keep_the_digits_of_their_index(spark):
    text = spark.createDataFrame([("0 a0. 121!!  2 b 2. \n3.5",)], "text string")
    assert text.select(tx.rough_sentences(F.col("text"))).first()[0] == ["0 a0.", "121!!", "2 b 2.", "3.5"]
    line = spark.createDataFrame([("x\n1. first",)], "text string")
    assert line.select(tx.looks_like_markdown(F.col("text"))).first()[0]


def test_routing_meets_different_vectors_in_blocks(spark, monkeypatch):
    """Blocks of 4 vectors: many concepts of one spelling, equal vectors, concepts without a vector, facts of one vector."""
    import numpy as np

    rng = np.random.default_rng(5)
    pool = rng.normal(size=(9, 8)).tolist()
    known = [(i, "n", i % 3, pool[i % 9] if i % 4 else None) for i in range(30)] + [(40, "two", 0, None), (41, "two", 0, None), (50, "one", 0, None)]
    asked = [(i, ["n", "two", "one", "none"][i % 4], rng.normal(size=8).tolist() if i % 5 else None) for i in range(60)]
    names = spark.createDataFrame([("r", "c", k, i, t) for i, k, t, _ in known], "repository_id string, context_key string, key string, concept_id long, created_at int")
    vectors = spark.createDataFrame([(i, v) for i, _, _, v in known if v], "concept_id long, embedding array<double>")
    mentions = spark.createDataFrame([(i, "r", "C", k.upper()) for i, k, _ in asked], "fact_id long, repository_id string, context string, mention string")
    facts = spark.createDataFrame([(i, v) for i, _, v in asked if v], "fact_id long, embedding array<double>")
    cos = lambda a, b: -1.0 if b is None else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = []
    for i, k, v in asked:
        some = [x for x in known if x[1] == k]
        if len(some) > 1 and v is None:
            want.append((i, None, "deferred"))
        else:
            first = min(some, key=lambda x: (-round(cos(v, x[3]), 9) if v else 0, x[2], x[0]), default=None)
            want.append((i, first and first[0], "linked" if first else "miss"))
    closest = concepts._closest
    monkeypatch.setattr(concepts, "_closest", lambda a, b: closest(a, b, block=4))
    assert rows(concepts.route(mentions, names, vectors, facts), "fact_id", "concept_id", "outcome") == want


def test_neighbours_of_copies_in_blocks(spark):
    """Equal vectors meet once, and the result is that of all rows: ties by id, no row its own neighbour, repositories apart."""
    import numpy as np

    rng = np.random.default_rng(8)
    pool = rng.normal(size=(40, 6)).tolist() + [[0.0] * 6]
    items = [(i, pool[int(rng.integers(0, 41))], "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(items, "id long, embedding array<float>, repo string").repartition(3)
    x = np.array([v for _, v, _ in items], np.float32).astype(float)
    n = np.linalg.norm(x, axis=1)
    score = np.where(n[:, None] * n > 0, x @ x.T / np.where(n[:, None] * n > 0, n[:, None] * n, 1), -1)
    for repo, minimum in ((None, -1.0), ("repo", 0.3)):
        want = []
        for i in range(300):
            some = [j for j in range(300) if j != i and score[i, j] >= minimum and (repo is None or i % 2 == j % 2)]
            want += [(i, j, r + 1) for r, j in enumerate(sorted(some, key=lambda j: (-round(score[i, j], 9), j))[:4])]
        assert rows(search.neighbours(df, df, 4, minimum, True, repo, block=16), "query_id", "id", "rank") == sorted(want)


def test_thinned_pairs_give_the_sweep_and_examples_of_all(spark):
    import numpy as np

    x = np.random.default_rng(9).normal(size=(150, 6)).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "id long, embedding array<double>").cache()
    cross = lambda a, b: a % 7 != b % 7
    every = search.pairs_above(df, 0.5, block=40).where("query_id < id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score").withColumn("cross", F.col("a") % 7 != F.col("b") % 7)
    thin = dedup.sweep_pairs(df, 0.5, cross)
    assert thin.count() < every.count()
    assert dedup.threshold_sweep(thin, [0.5, 0.7, 0.9], 150).collect() == dedup.threshold_sweep(every, [0.5, 0.7, 0.9], 150).collect()
    assert rows(dedup.band_examples(df, [0.5, 0.7]), "a", "b", "band") == rows(dedup.examples(every, [0.5, 0.7]), "a", "b", "band")


def test_texts_are_inverted_within_their_rows(spark):
    texts = [(1, "b a  b"), (1, "second text of one id"), (2, ""), (3, " x "), (4, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", "text", tx.inverted_of(F.split("text", " ")).alias("at"))
    assert [r["at"] for r in df.collect()][0] == {"b": [0, 3], "a": [1], "": [2]}
    back = df.select("text", tx.abstract_of(F.col("at")).alias("back"))
    assert all(r["text"] == r["back"] for r in back.collect()) and "Exchange" not in back._jdf.queryExecution().executedPlan().toString()


def test_ranks_and_q_values_of_rows_that_stand_for_many(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    data = [(int(a), float(b)) for a, b in zip(rng.integers(0, 6, 500), rng.integers(0, 9, 500))]
    df = spark.createDataFrame(data, "x int, y double")
    ranks = pd.DataFrame(data).rank()
    assert graph.spearman(df, "x", "y").first()["rho"] == pytest.approx(np.corrcoef(ranks[0], ranks[1])[0, 1])
    many = [(w, round(p, 2), n) for w, p, n in zip(rng.integers(1, 12, 60).tolist(), (rng.random(60) ** 3).tolist(), rng.integers(1, 5, 60).tolist())]
    short = spark.createDataFrame(many, "weight int, p double, n int")
    whole = short.select("weight", "p", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    assert graph.survivors(graph.benjamini_hochberg(short, "n"), "n").collect() == graph.survivors(graph.benjamini_hochberg(whole)).collect()
