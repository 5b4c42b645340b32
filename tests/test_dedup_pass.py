"""The deduplication pass in rounds against the sequential fold."""

import numpy as np
import pandas as pd
import pytest

from factloom.operators import dedup


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_the_fold(spark, seed):
    rng = np.random.default_rng(seed)
    n = 120
    status = ["stable" if x < 0.25 else "new" for x in rng.random(n)]
    if seed == 3:  # a chain in falling order, a hub that a third points to, and pairs that point to each other
        hits = [i + 1 if i < 25 else 100 if i < 65 else i ^ 1 for i in range(n)]
        status = ["stable" if i % 17 == 5 else "new" for i in range(n)]
    else:
        hits = [None if x < 0.2 else int(y) for x, y in zip(rng.random(n), rng.integers(0, [n, 12, 3][seed], n))]
    hits = [None if h == i else h for i, h in enumerate(hits)]
    want = dedup.fold(pd.DataFrame({"id": range(n), "status": status, "hit": pd.Series(hits, dtype=object)}))
    facts = spark.createDataFrame([(i, s) for i, s in enumerate(status)] + [(500, "to_delete"), (501, "new")], "id long, status string")
    top = spark.createDataFrame([(i, h, 0.95) for i, h in enumerate(hits) if h is not None], "id long, hit long, score double")
    got = {r["id"]: (r["new_status"], r["winner"]) for r in dedup.deduplicate(facts, top).collect()}
    assert got.pop(501) == ("stable", None)
    assert got == {r.id: (r.new_status, None if r.winner is None or r.winner != r.winner else int(r.winner)) for r in want.itertuples()}


def test_empty(spark):
    none = spark.createDataFrame([], "id long, status string")
    assert dedup.deduplicate(none, spark.createDataFrame([], "id long, hit long, score double")).count() == 0
