"""The stored catalog and the corpus readers."""

import re

from pyspark.sql import functions as F

from factloom.sources import catalog

SCHEMA = "id long, url string, doi string, content_hash string, title string"
ROWS = [(i, f"https://a.org/{i}", f"10.1/{i}" if i % 2 else None, f"h{i // 2}", f"Title {i}") for i in range(40)]


def test_lookups_pages_and_changes(spark, tmp_path):
    stored = catalog.store(spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}/c", buckets=8)
    assert sorted(r["id"] for r in stored.get(3, 5, 999).collect()) == [3, 5]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", stored.get(3)._jdf.queryExecution().toString())
    seen, after = [], None
    while page := stored.page("title", "id", limit=7, after=after, where=stored.search("TITLE", "title")).collect():
        seen += [r["id"] for r in page]
        after = (page[-1]["title"], page[-1]["id"])
    assert seen == [i for _, i in sorted((f"Title {i}", i) for i in range(40))]
    asked = spark.createDataFrame([(1, "https://a.org/7", "10.1/9", None), (2, "", "10.1/9", "h0"), (3, None, "none", "h3"), (4, None, None, None)], "row_id int, url string, doi string, content_hash string")
    assert {r["row_id"]: (r["id"], r["how"]) for r in stored.find(asked).collect()} == {1: (7, "url"), 2: (9, "doi"), 3: (6, "content_hash"), 4: (None, None)}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "c" / "rows").rglob("*.parquet")}
    stored.put(spark.createDataFrame([(7, "https://b.org/7", None, "new", "Changed"), (100, "https://a.org/100", None, None, "Added")], SCHEMA))
    left = sum(p.exists() and p.stat().st_mtime_ns == t for p, t in files.items())
    assert 6 <= left < 8 and stored.rows.count() == 41
    assert [r["title"] for r in stored.get(7).collect()] == ["Changed"] and stored.get(100).count() == 1
    again = spark.createDataFrame([(1, "https://a.org/7", None), (2, "https://b.org/7", None), (3, None, "new"), (4, "https://a.org/100", None)], "row_id int, url string, content_hash string")
    assert {r["row_id"]: r["id"] for r in stored.find(again).collect()} == {1: None, 2: 7, 3: 7, 4: 100}


def test_bad_json_lines_are_kept_apart(spark):
    lines = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "no number"}',), ("{broken",), ("",), ("  ",), (None,), ("{}",), ("[1]",)], "value string")
    good, bad = catalog.json_lines(lines, "a long, b string")
    assert sorted(map(str, (tuple(r) for r in good.collect()))) == ["(1, 'x')", "(None, None)"]
    assert sorted(r["value"] for r in bad.collect()) == ["[1]", '{"a": "no number"}', "{broken"]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "one.md").write_text("---\ntitle: First\nauthor: Ann\n---\nBody\nmore\n")
    (tmp_path / "two.md").write_text("No front matter.\n")
    got = {r["path"].rsplit("/", 1)[1]: r for r in catalog.markdown_files(spark, f"file://{tmp_path}/*.md").select("path", F.col("meta.title").alias("title"), "body").collect()}
    assert (got["one.md"]["title"], got["one.md"]["body"]) == ("First", "Body\nmore\n") and (got["two.md"]["title"], got["two.md"]["body"]) == (None, "No front matter.\n")
