"""Products of blocks of vectors: small tiles, the same pairs as by brute force."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from factloom.operators import search, vector_index


def block(rng, n, width=16):
    x = rng.normal(size=(n, width))
    x[: n // 4] = x[0] + 1e-8 * rng.normal(size=(n // 4, width))  # very many nearly equal ones
    x[n // 4] = 0
    return x


@pytest.mark.parametrize("probed", [False, True])
@pytest.mark.parametrize("n", [64, 1024, 2500])
def test_products_equal_brute_force(n, probed):
    rng = np.random.default_rng(n)
    x, y, k = block(rng, 700), block(rng, n), 5
    left, right = pd.DataFrame({"embedding": list(x)}), pd.DataFrame({"embedding": list(y), "cell": rng.integers(0, 9, n)})
    left["cells"] = [np.append(rng.choice(9, 4, replace=False), 50) for _ in range(700)]
    norm = lambda v: np.linalg.norm(v, axis=1)
    n_xy = norm(x)[:, None] * norm(y)[None]
    score = np.where(n_xy > 0, np.divide(x @ y.T, n_xy, out=np.zeros_like(n_xy), where=n_xy > 0), -1.0)
    if probed:
        score[[[c not in cells for c in right["cell"]] for cells in left["cells"]]] = -np.inf
    want = [[(j, round(row[j], 6)) for j in np.lexsort((np.arange(n), -np.round(row, 9)))[:k] if row[j] >= -1] for row in score]
    got = [[] for _ in range(700)]
    for i, j, s in search._products(left, right, -1.0, k, probed=probed):
        for a, b, c in zip(i, j, s):
            got[a].append((b, round(c, 6)))
    assert got == want


def test_a_tile_of_products_stays_small():
    rng = np.random.default_rng(5)
    left, right = (pd.DataFrame({"embedding": list(rng.normal(size=(n, 8)))}) for n in (512, 16_384))
    tracemalloc.start()
    found = sum(len(i) for i, _, _ in search._products(left, right, -1.0, 6))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 512 * 6 and peak < 16 << 20  # tiles of 8,192 columns took over 40 MB


@pytest.mark.parametrize("width", [24, 23])
def test_places_are_those_set(width):
    mask = np.random.default_rng(width).random((40, width)) < 0.05
    assert all((a == b).all() for a, b in zip(search._places(mask), np.nonzero(mask)))


def test_index_keeps_single_precision(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "id long, embedding array<float>")
    index = vector_index.build(items.where("id <> 4"), cells=2)
    assert index.items.schema["embedding"].dataType.simpleString() == "array<float>"
    assert [r["id"] for r in vector_index._located(items, index.centroids, 1).orderBy("id").collect()] == [1, 2]
