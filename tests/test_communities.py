"""Louvain communities and the power-law fit against plain versions."""

import math
from collections import Counter, defaultdict

import numpy as np

from factloom.operators import communities, graph
from factloom.plans import index_queries, queries  # noqa: F401 - registers


def modularity(edges, label):
    m = sum(w for *_, w in edges)
    inside, strength = Counter(), Counter()
    for a, b, w in edges:
        strength[label[a]] += w
        strength[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += w
    return sum(inside[c] / m - (strength[c] / (2 * m)) ** 2 for c in strength)


def plain_louvain(edges):
    """The sequential version: one node after the other, then contraction."""
    member = {x: x for a, b, _ in edges for x in (a, b)}
    adj = defaultdict(Counter)
    for a, b, w in edges:
        adj[a][b] += w
        adj[b][a] += w
    whole = sum(sum(v.values()) for v in adj.values())
    while True:
        label = {u: u for u in adj}
        k = {u: sum(adj[u].values()) for u in adj}
        total, any_move = Counter(k), False
        moved = True
        while moved:
            moved = False
            for u in sorted(adj):
                own = label[u]
                total[own] -= k[u]
                towards = Counter({own: 0})
                for v, w in adj[u].items():
                    if v != u:
                        towards[label[v]] += w
                best = max(sorted(towards), key=lambda c: towards[c] - k[u] * total[c] / whole)
                if towards[best] - k[u] * total[best] / whole > towards[own] - k[u] * total[own] / whole + 1e-9:
                    label[u], moved, any_move = best, True, True
                total[label[u]] += k[u]
        if not any_move:
            return member
        member = {n: label[c] for n, c in member.items()}
        new = defaultdict(Counter)
        for u in adj:
            for v, w in adj[u].items():
                new[label[u]][label[v]] += w
        adj = new


def frame(spark, edges):
    return spark.createDataFrame(edges, "name_a string, name_b string, weight long")


def test_louvain(spark):
    rng = np.random.default_rng(6)
    edges = Counter()
    for _ in range(900):
        g = rng.integers(0, 8)
        a, b = sorted(rng.choice(25, 2, replace=False))
        x, y = (f"n{g}_{a}", f"n{g}_{b}") if rng.random() < 0.85 else tuple(sorted((f"n{g}_{a}", f"n{rng.integers(0, 8)}_{b}")))
        if x != y:
            edges[x, y] += 1
    rows = [(a, b, w) for (a, b), w in edges.items()]
    got = {r["name"]: r["label"] for r in communities.louvain(frame(spark, rows)).collect()}
    assert set(got) == {x for a, b, _ in rows for x in (a, b)}
    assert all(label == min(n for n in got if got[n] == label) for label in set(got.values()))
    mine, want = modularity(rows, got), modularity(rows, plain_louvain(rows))
    assert mine >= want - 0.02, (mine, want)
    by_spark = graph.modularity(frame(spark, rows), spark.createDataFrame(list(got.items()), "name string, label string")).first()[0]
    assert abs(by_spark - mine) < 1e-9
    lpa = graph.modularity(frame(spark, rows), graph.communities_lpa(frame(spark, rows))).first()[0]
    assert mine >= lpa - 1e-9


def test_louvain_query_takes_pairs_of_one_order(spark, tmp_path):
    lines = [(o, p) for o, parts in enumerate([(1, 2, 3), (4, 5, 6), (3, 4)]) for p in parts]  # no pair of parts meets twice
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries.QUERIES["g12_louvain"](spark, str(tmp_path)).first()
    assert got["communities"] == 2 and abs(got["modularity"] - (6 / 7 - 0.5)) < 1e-9


def test_louvain_small(spark):
    assert communities.louvain(frame(spark, [])).count() == 0
    two = [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("x", "y", 1), ("y", "z", 1), ("x", "z", 1), ("c", "x", 1), ("a", "b", 1)]
    got = {r["name"]: r["label"] for r in communities.louvain(frame(spark, two)).collect()}
    assert got == dict.fromkeys("abc", "a") | dict.fromkeys("xyz", "x")


def plain_power_law(degrees):
    best = None
    for low in sorted(set(degrees)):
        tail = [d for d in degrees if d >= low]
        if len(set(tail)) < 2:
            continue
        alpha = 1 + len(tail) / sum(math.log(d / (low - 0.5)) for d in tail)
        model = lambda x: (x / (low - 0.5)) ** (1 - alpha)
        gap = 0.0
        for d in set(tail):
            over = sum(x >= d for x in tail) / len(tail)
            more = sum(x > d for x in tail) / len(tail)
            gap = max(gap, abs(over - model(d - 0.5)), abs(more - model(d + 0.5)))
        if best is None or round(gap, 9) < round(best[3], 9):
            best = (len(tail), low, alpha, gap)
    return best


def test_power_law(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(2, 400):  # new nodes prefer nodes of many edges
        ends = [x for a, b, _ in rows for x in (a, b)] or ["n0", "n1"]
        rows.append((f"n{i}", ends[rng.integers(len(ends))], 1))
    degrees = list(Counter(x for a, b, _ in rows for x in (a, b)).values())
    got = communities.power_law(frame(spark, rows)).first()
    n, low, alpha, gap = plain_power_law(degrees)
    assert (got["n"], got["low"]) == (n, low) and abs(got["alpha"] - alpha) < 1e-9 and abs(got["distance"] - gap) < 1e-9
    assert abs(got["sigma"] - (alpha - 1) / math.sqrt(n)) < 1e-9 and got["taxonomy"] in ("strongest", "strong", "moderate", "weak", "super-weak")
    assert communities.power_law(frame(spark, [("a", "b", 1)])).first()["taxonomy"] == "N/A"
