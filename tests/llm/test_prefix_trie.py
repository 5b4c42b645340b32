"""The prefix trie of rebuilt conversations against a plain version."""

import duckdb
import numpy as np
import pytest

from . import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def same(spark, turns):
    from factloom.llm import prefix_trie

    frame = spark.createDataFrame([(*t, "x", 1, 2) for t in turns], "conv_id long, turn long, role string, text string, depth string, part int, weight long")
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in prefix_trie.nodes(frame).select(*COLUMNS).collect()), key=key) == sorted(brute.prefix_trie(turns), key=key)


def test_table_and_edges(spark):
    same(spark, duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall())
    edges = [
        (0, 0, "user", "a b"), (0, 0, "user", "a b"), (0, None, None, None), (1, 1, "user", "a b"), (1, 1, "assistant", "a b"), (2, 0, "", ""), (None, 0, "user", "lost"), (-3, 0, "user", "x"), (-3, 2, "user", "y z"),
        (47, 0, "user", "no donor"), (61, 5, "user", "long " * 100_000), (2**60, 1, "r", "\t\x0b one\x0c"), (2**60 + 1, -1, "r", None),
    ]
    same(spark, edges)
    same(spark, [])


@pytest.mark.parametrize("block", [3, 4096])
def test_long_and_equal_conversations(spark, monkeypatch, block):
    from factloom.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = np.random.default_rng(2)
    turns = [(40, i, "user", f"t{i % 5} w") for i in range(60)]  # a third of all turns
    turns += [(c, i, "user", f"t{i % 5} w") for c in range(100, 140) for i in range(3)]  # copies, and prefixes of each other
    turns += [(c, i, "user", f"t{rng.integers(2)}") for c in range(200, 220) for i in range(rng.integers(1, 7))]
    same(spark, turns)


def test_end_list_over_blocks(spark):
    import hashlib

    from factloom.llm import prefix_trie

    convs = spark.range(30_000).selectExpr("1L as depth", "5L as p1", "-6L as p2", "id as conv_id")
    got = prefix_trie.end_lists(convs).collect()
    assert [(r["depth"], r["p1"], r["p2"], r["ends"]) for r in got] == [(1, 5, -6, hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest())]
