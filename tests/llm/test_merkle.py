"""Merkle manifests and proofs against a plain version."""

import duckdb
import pytest
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, part int, tree long"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1, 2) for d in docs], SCHEMA)


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=key) == sorted(want, key=key)


EDGES = [
    (1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "ABD"), (None, "a", None, None, None), (None, None, "en", 0, ""), (2, "", "en", 4, "Äß😀"), (-7, "+", None, 1, "X" * 300_000),
    (8, "é", "fr", 2, "-"), (9, None, "de", 1, "a:b"), (2**62, "Z", "de", 1, "LOW low"),
]


@pytest.mark.parametrize("n, part_rows", [(0, 7), (1, 7), (17, 7), (300, 7), (300, 32_768)])
def test_proofs(spark, n, part_rows):
    from factloom.llm import merkle

    docs = [(i * 3, f"s{i % 40}" if i % 3 else "hot", "en", i, f"Text {i}") for i in range(n)]
    docs += EDGES if n == 300 else []
    upper = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    held = F.when(changed, merkle.leaf_hash(*[upper if f == "text" else F.col(f) for f in merkle.FIELDS]))
    same(merkle.proved(frame(spark, docs), other=held, part_rows=part_rows), brute.merkle(docs))


def test_query_and_edges(spark):
    from factloom.llm import merkle

    docs = duckdb.sql(f"select doc_id, source, lang, n_chars, text from '{SF}/documents.parquet'").fetchall()
    for rows in (docs, EDGES):
        same(merkle.audited(frame(spark, rows)), brute.merkle(rows))


def test_changes_show(spark):
    from factloom.llm import merkle

    got = {r["doc_id"]: r["verified"] for r in merkle.audited(frame(spark, [(i, "s", "en", 1, "Upper") for i in range(60)])).collect()}
    assert [i for i, ok in got.items() if not ok] and all(ok == bool(brute.crc(str(i)) % 5) for i, ok in got.items())


def test_manifest(spark):
    from factloom.llm import merkle

    got = {r["source"]: (r["n_leaves"], r["subroot"], r["root"]) for r in merkle.manifest(frame(spark, EDGES)).collect()}
    want = brute.merkle(EDGES)
    groups = {}
    for d in EDGES:
        groups.setdefault(d[1], []).append(d)
    assert {g: len(v) for g, v in groups.items()} == {g: n for g, (n, _, _) in got.items()}
    assert {s for _, s, _ in got.values()} == {w[2] for w in want} and {r for *_, r in got.values()} == {want[0][3]}
    assert not merkle.manifest(frame(spark, [])).collect()
