"""The vector index against the exact answer."""

import numpy as np
import pytest

from factloom.operators import search, vector_index


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.25 * rng.normal(size=(900, 16))
    x[100:180] = x[100]  # a third of one cell are copies
    return frame(spark, x).repartition(4).cache()


def test_recall_and_coverage(spark, clustered):
    index = vector_index.tuned(vector_index.build(clustered, block_rows=50), clustered, 5, asked=100)
    assert index.items.select("id").distinct().count() == index.items.count() == 900
    assert index.items.groupBy("cell", "block").count().agg({"count": "max"}).first()[0] <= 100  # hot cells are cut; copies share an angle, not a hash
    exact = search.neighbours(clustered, clustered, 5)
    got = vector_index.search(index, clustered, 5)
    assert vector_index.recall(got, exact).first()["recall"] >= 0.9 and index.probes < len(index.centroids)
    whole = vector_index.search(index, clustered, 5, probes=len(index.centroids))
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    assert key(whole) == key(exact)


@pytest.mark.parametrize("minimum", [0.97, 0.8])
def test_threshold_is_exact(spark, clustered, minimum):
    index = vector_index.build(clustered, block_rows=64)
    want = {(r["query_id"], r["id"]) for r in search.pairs_above(clustered, minimum).collect()}
    assert want == {(r["query_id"], r["id"]) for r in vector_index.within(index, clustered, minimum).collect()}
    top = search.neighbours(clustered, clustered, 1, minimum)
    key = lambda df: sorted((r["query_id"], r["id"]) for r in df.collect())
    assert key(vector_index.within(index, clustered, minimum, 1)) == key(top)


def test_edges(spark):
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0])], "id long, embedding array<float>")
    same = odd.where("id in (1, 3, 4)")
    index = vector_index.build(same)
    assert {(r["query_id"], r["id"]) for r in vector_index.within(index, same, 0.9).collect()} == {(3, 4), (4, 3)}
    none = vector_index.build(odd.limit(0))
    assert vector_index.search(none, odd, 3).count() == 0 and vector_index.within(none, odd, 0.5).count() == 0


def test_search_sends_a_query_once_a_bin(spark, clustered):
    index = vector_index.build(clustered, block_rows=50)
    cells = len(index.centroids)
    bins = index.blocks.selectExpr("cell", "cast(pmod(xxhash64(cell, block), 3) as int) as bin").distinct()
    sent = vector_index._by_bin(vector_index._located(clustered, index.centroids, cells, True), bins)
    assert sent.count() == 900 * bins.select("bin").distinct().count()  # not 900 times the blocks
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    for probes, k in ((cells, 7), (3, 4)):
        assert key(vector_index.search(index, clustered, k, probes=probes, most=100)) == key(vector_index.search(index, clustered, k, probes=probes))
    assert key(vector_index.search(index, clustered, 7, probes=cells, most=100)) == key(search.neighbours(clustered, clustered, 7))


def _sent_rows(spark, df):
    """The rows of a run of df, and how many it wrote to shuffles."""
    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    return df.collect(), written() - before


def test_threshold_sends_a_query_once_a_bin(spark, clustered):
    index = vector_index.build(clustered, block_rows=50)
    key = lambda found: sorted((r["query_id"], r["id"], round(r["score"], 6)) for r in found)
    for minimum, k in ((0.3, None), (0.3, 3), (0.9, None)):
        got, sent = _sent_rows(spark, vector_index.within(index, clustered, minimum, k))
        assert sent <= 900 * 2 + 1000 + 900 * ((k or -1) + 1)  # queries and items once, then the best of each query; not 900 times the blocks
        want = (search.neighbours(clustered, clustered, k, minimum) if k else search.pairs_above(clustered, minimum)).collect()
        assert key(got) == key(want)
        assert key(vector_index.within(index, clustered, minimum, k, most=100).collect()) == key(want)
