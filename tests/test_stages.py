"""Hierarchical clustering against the sequential version, failures row by row, routing that creates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions.segment import salvage_array
from factloom.operators import clustering, concepts, failures


def plain_tree(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = 1 - x @ x.T
    parts, out = {i: [i] for i in range(len(x))}, []
    while len(parts) > 1:
        d, a, b = min((round(far[np.ix_(parts[a], parts[b])].mean(), 9), a, b) for a in parts for b in parts if a < b)
        out.append((a, b, d))
        parts[a] += parts.pop(b)
    return out


@pytest.mark.parametrize("n", [1, 2, 25])
def test_tree_and_cut(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 6))
    items = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")
    tree = clustering.merges(items)
    want = plain_tree(x)
    assert sorted((r["a"], r["b"], round(r["height"], 6)) for r in tree.collect()) == sorted((a, b, round(d, 6)) for a, b, d in want)
    if n == 25:
        for wanted in (4, 25, 1):
            label = list(range(n))
            for a, b, _ in sorted(want, key=lambda m: (m[2], m[0], m[1]))[: n - wanted]:
                low, high = sorted((label[a], label[b]))
                label = [low if c == high else c for c in label]
            assert {r["id"]: r["cluster"] for r in clustering.clusters(items, wanted, tree).collect()} == dict(enumerate(label))


def test_a_failed_row_leaves_the_others(spark):
    def invert(x):
        return 1 / x

    rows = spark.createDataFrame([(1, 0, 2.0), (1, 1, 0.0), (1, 2, 4.0), (2, 0, 1.0)], "source_id long, index int, x double")
    tried = rows.withColumn("r", failures.guarded(invert, "double")("x")).select("source_id", F.lit("text").alias("type"), "index", "r.value", "r.error", F.lit(3).alias("attempts"))
    assert sorted((r["source_id"], r["index"], r["value"]) for r in tried.where("error is null").collect()) == [(1, 0, 0.5), (1, 2, 0.25), (2, 0, 1.0)]
    account = failures.chunk_account(tried, "2024-05-01")
    got = {r["source_id"]: r for r in account.collect()}
    assert got[1]["chunk_failures"] == 1 and got[1]["first_error"].startswith("ZeroDivisionError") and '"index":1' in got[1]["chunk_errors"]
    assert got[2]["chunk_failures"] == 0 and got[2]["chunk_errors"] is None
    before = spark.createDataFrame([(1, "fetched", 0, None, None), (2, "fetched", 3, "[]", None), (3, "fetched", 1, "[x]", None)], "source_id long, status string, chunk_failures long, chunk_errors string, last_chunk_failure_at timestamp")
    after = {r["source_id"]: (r["status"], r["chunk_failures"], r["last_chunk_failure_at"] is None) for r in failures.apply_account(before, account).collect()}
    assert after == {1: ("fetched", 1, False), 2: ("processed", 0, True), 3: ("fetched", 1, True)}


def test_direct_routing_creates_one_concept_for_one_key(spark):
    mentions = spark.createDataFrame([("f2", "r", "Bio", " Cell ", ["unit"]), ("f1", "r", "bio", "cell", ["", "unit"]), ("f1", "q", "bio", "cell", []), ("f3", "r", "bio", "Gene", ["g"]), ("f4", "r", "bio", " ", ["lost"])], "fact_id string, repository_id string, context string, mention string, seeds array<string>")
    known = spark.createDataFrame([("c1", "gene", "bio", "r")], "concept_id string, name string, context string, repository_id string").withColumn("created_at", F.current_timestamp())
    names = concepts.named_concepts(known, spark.createDataFrame([], "concept_id string, alias string"))
    none = spark.createDataFrame([], "concept_id string, embedding array<float>")
    links, created, aliases = concepts.route_direct(mentions, names, none, none.withColumnRenamed("concept_id", "fact_id"))
    made = {(r["repository_id"], r["name"]): r["concept_id"] for r in created.collect()}
    assert set(made) == {("r", "cell"), ("q", "cell")}
    got = {(r["fact_id"], r["concept_id"], r["created"]) for r in links.collect()}
    assert got == {("f1", made["r", "cell"], True), ("f2", made["r", "cell"], True), ("f1", made["q", "cell"], True), ("f3", "c1", False)}
    assert {(r["concept_id"], r["alias"]) for r in aliases.collect()} == {("c1", "g"), (made["r", "cell"], "unit"), (made["r", "cell"], "cell"), (made["q", "cell"], "cell")}


def test_direct_routing_sends_a_mention_once(spark, monkeypatch):
    rows = [("f2", "r", "Bio", " Cell ", ["unit"]), ("f1", "r", "bio", "cell", None), (None, "r", "bio", "gene", ["g", None]), ("f3", "r", "bio", "Gene", ["g"]), ("f4", "r", "bio", "gene", ["h"]), ("f4", "q", "bio", "gene", ["i"]), ("f5", "r", None, "gene", []), ("f6", "r", "bio", "two", ["t"])]
    mentions = spark.createDataFrame(rows, "fact_id string, repository_id string, context string, mention string, seeds array<string>")
    known = spark.createDataFrame([("c1", "gene", "bio", "r"), ("c2", "two", "bio", "r"), ("c3", "two", "bio", "r")], "concept_id string, name string, context string, repository_id string").withColumn("created_at", F.current_timestamp())
    names = concepts.named_concepts(known, spark.createDataFrame([], "concept_id string, alias string"))
    none = spark.createDataFrame([], "concept_id string, embedding array<float>")
    routed = lambda: concepts.route_direct(mentions, names, none, none.withColumnRenamed("concept_id", "fact_id"))
    links, created, aliases = routed()
    sent = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert sent(links) == 1 and sent(created) <= 2 and sent(aliases) <= 3  # the rows once, then what they are grouped by
    assert {(r["fact_id"], r["created"]) for r in links.where("concept_id = 'c1'").collect()} == {("f3", False), ("f4", False)}
    assert links.count() == 7 and {r["name"] for r in links.join(created, "concept_id").where("fact_id = 'f6'").collect()} == {"two"}
    assert {r["alias"] for r in aliases.where("concept_id = 'c1'").collect()} == {"g", "h", "i"}  # a concept is that of a fact and its mention
    small = [sorted(map(str, df.collect())) for df in (links, created, aliases)]
    own = concepts._candidates
    monkeypatch.setattr(concepts, "_candidates", lambda *of: own(*of, most_bytes=0))
    assert [sorted(map(str, df.collect())) for df in routed()] == small


def test_salvaged_arrays():
    cases = {"say [1, 2] and [3]": "[1, 2]", '{"a": ["b]", "c"]} tail': '["b]", "c"]', "none": None, "[[1], [2]] x": "[[1], [2]]", "[open": None, "[" * 200_000: None, None: None, "[1," + "]" * 100_000: None}
    assert {k: salvage_array(k) for k in cases} == cases
