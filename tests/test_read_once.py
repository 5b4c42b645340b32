"""Results of steps that read what they need of the tables once, from a table written for them."""

import pytest

from factloom.operators import concepts, ranked_text
from factloom.plans import index_queries, queries  # noqa: F401 - registers

SF = "/root/testdata/sf0.001"


def test_louvain_reads_its_edges_once(spark):
    assert not any("lineitem" in f for f in queries.QUERIES["g12_louvain"](spark, SF).inputFiles())


def test_search_rank_reads_texts_once(spark):
    assert not any("documents" in f for f in queries.QUERIES["f6_search_rank"](spark, SF).inputFiles())


def test_search_rank_of_odd_rows(spark):
    concepts = spark.createDataFrame([(1, "red fox", "fox den"), (2, None, "red"), (3, "blue", None), (4, "grey", "fox")], "concept_id long, name string, description string")
    aliases = spark.createDataFrame([(3, "red red"), (3, "red red"), (3, None), (9, "red")], "concept_id long, alias string")
    got = {r["concept_id"]: (round(r["name_rank"], 6), round(r["alias_rank"], 6)) for r in ranked_text.search_rank(concepts, aliases, "red").collect()}
    assert got == {1: (1.0, 0.0), 2: (0.1, 0.0), 3: (0.0, 2.0)}
    none = {r["concept_id"]: r["search_rank"] for r in ranked_text.search_rank(concepts, aliases, "-fox").collect()}
    assert none == {2: 0.0, 3: 0.0}


@pytest.mark.parametrize("name", ["j6_order_part_graph", "g14_weight_distribution"])
def test_part_graph_reads_line_items_once(spark, name):
    assert not any("lineitem" in f for f in queries.QUERIES[name](spark, SF).inputFiles())


def test_pairs_of_a_task_do_not_grow_with_the_input(spark):
    links = spark.range(4000).selectExpr("id div 8 as fact_id", "pmod(xxhash64(id), 50) as name")
    names = links.distinct().groupBy("fact_id").count()
    pairs = names.selectExpr("sum(count * (count - 1) div 2)").first()[0]
    for most in (100, 1000):
        found = concepts.relations(links, most=most)
        assert "RepartitionByExpression [fact_id#" in (plan := found._jdf.queryExecution().optimizedPlan().toString())
        assert max(int(line.rsplit(",", 1)[1]) for line in plan.splitlines() if "RepartitionByExpression [fact_id#" in line) >= pairs / most
        assert found.agg({"weight": "sum"}).first()[0] == pairs


def test_counted_pairs_of_a_task_do_not_grow_with_the_input(spark):
    links = spark.range(4000).selectExpr("id div 8 as fact_id", "pmod(xxhash64(id), 50) as name")
    wide = spark.range(400).selectExpr("7 as fact_id", "id + 100 as name")
    for some in (links, wide):
        pairs = some.distinct().groupBy("fact_id").count().selectExpr("sum(count * (count - 1) div 2)").first()[0]
        found = concepts.relations(some, block=64, most=1000)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        dealt = [int(line.rsplit(",", 1)[1]) for line in plan.splitlines() if "RepartitionByExpression [name_a#" in line]
        assert dealt and min(dealt) >= 2 * pairs / 1000
        assert found.agg({"weight": "sum"}).first()[0] == pairs
