"""The training-data operators against brute force, on the smallest tables and on hand-made edge rows."""

import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from . import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, bucket int"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
EDGES = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "One two"), (6, PASSAGE), (7, f"lead {PASSAGE} tail"), (8, PASSAGE), (9, LONG), (10, LONG + " end"),
    (11, "ä" * 60), (12, "x" + "ä" * 60), (13, "!!! ..."), (14, "a b c d e f g h i j k l m"), (15, "a b c d e f g h i j k l m"), (16, "😀 " * 40), (17, "A-Z's it's <|endoftext|> don't"),
]
BENCH = [("b1", " ".join(PASSAGE.split()[10:30])), ("b2", "one, TWO"), ("b3", None), ("b4", "!!!"), ("b1", " ".join(PASSAGE.split()[40:52]))]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 1) for d, t in docs], SCHEMA)


@pytest.fixture(scope="module")
def cases(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    return [(docs, bench), (EDGES, BENCH), ([], BENCH), (EDGES, [])]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_packing_round_trip(spark, cases):
    from factloom.llm import packing
    from factloom.llm.queries import tokenizer_path

    for docs, _ in cases:
        got = packing.pack(frame(spark, docs), tokenizer_path(), seq_len=4096).toPandas()
        ids = {d: brute.pack_ids(t, tokenizer_path()) for d, t in docs}
        assert set(got.doc_id) == set(ids)
        for d, g in got.sort_values("start").groupby("doc_id"):
            assert "".join(f"{s}+{n}," for s, n in zip(g.start, g.length)) == "".join(f"{s}+{n}," for s, n in zip(np.cumsum([0, *g.length[:-1]]), g.length))
            assert g.length.sum() == len(ids[d]) == g.doc_tokens.iloc[0]
            for s, n, c in zip(g.start, g.length, g.ids_crc32):
                assert zlib.crc32(np.array(ids[d][s : s + n], "<u4").tobytes()) == c
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert list(g.offset) == list(np.cumsum([0, *g.length[:-1]])) and g.length.sum() <= 4096


def test_first_fit_decreasing_is_first_fit():
    from factloom.llm.packing import first_fit_decreasing

    lengths = np.random.default_rng(5).integers(1, 100, 300)
    bins, _ = first_fit_decreasing(lengths, 100)
    free, want = [100] * 300, np.zeros(300, int)
    for i in np.argsort(-lengths, kind="stable"):
        want[i] = next(b for b, f in enumerate(free) if f >= lengths[i])
        free[want[i]] -= lengths[i]
    assert (bins == want).all()


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_decontamination(spark, cases, block):
    from factloom.llm import decontamination

    for docs, bench in cases:
        items = spark.createDataFrame(bench, "item_id string, text string")
        if bench and not isinstance(bench[0][0], str):
            items = spark.createDataFrame([(str(a), b) for a, b in bench], "item_id string, text string")
        if block == 300 and len(docs) > 100:
            continue
        got = rows(decontamination.report(frame(spark, docs), items, block_bytes=block), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == sorted(brute.decontaminate(docs, bench))


def test_cleaned_documents_hold_no_window(spark):
    from factloom.llm import decontamination

    items = spark.createDataFrame(BENCH, "item_id string, text string")
    docs = frame(spark, EDGES)
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    clean = {d for d, *_, hit in brute.decontaminate(EDGES, BENCH) if not hit}
    assert all(got[d] == t for d, t in EDGES if d in clean)
    assert not any(hit for *_, hit in brute.decontaminate([(d, t) for d, t in got.items() if d not in clean], BENCH))


def test_cleaning_does_not_depend_on_blocks(spark):
    from factloom.llm import decontamination

    rng = np.random.default_rng(11)
    word = lambda a, b: " ".join(f"k{i}" for i in range(a, b))
    bench = [(f"i{k}", word(a, a + 10)) for k, a in enumerate(range(0, 80, 5))] + [("far", word(200, 225)), ("join", "left " + word(300, 304) + " right")]
    docs = [(1, word(0, 15) + " plain end"), (2, word(0, 40) + " " + word(200, 225) + " " + word(500, 535)), (3, "left " + word(0, 20) + " right"), (4, None), (5, ""), (1, word(0, 15) + " plain end")]
    docs += [(10 + d, ", ".join(word(a, a + n) for a, n in zip(rng.integers(0, 300, 6).tolist(), rng.integers(3, 30, 6).tolist()))) for d in range(40)]
    items = spark.createDataFrame(bench, "item_id string, text string")
    pattern = re.compile(r"[a-z0-9]+")
    grams = {tuple(w[i : i + 10]) for w in (t.split() for _, t in bench) for i in range(max(1, len(w) - 9))}
    want = []
    for d, t in docs:
        w = list(pattern.finditer(t or ""))
        hit = {j for i in range(len(w)) for n in (6, 10) if tuple(x[0] for x in w[i : i + n]) in grams for j in range(i, i + n)}
        if not hit:
            want.append((d, t))
        elif len(hit) < 0.5 * len(w):
            gone = {c for i in hit for c in range(w[i].start(), w[i + 1].start() if i + 1 in hit else w[i].end())}
            want.append((d, "".join(c for k, c in enumerate(t) if k not in gone)))
    for block in (16 << 20, 700, 150):
        got = decontamination.clean(frame(spark, docs), items, block_bytes=block)
        assert got.columns == frame(spark, docs).columns
        got = [tuple(r) for r in got.select("doc_id", "text", "n_chars").collect()]
        assert sorted(map(str, got)) == sorted(str((d, t, len(t or ""))) for d, t in want)


def test_jaccard_components(spark, cases):
    from factloom.llm import ngram_join

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    chain = []
    for d in range(80):  # a slow walk: neighbours link, ends do not
        for i in rng.integers(0, 40, 2):
            words[i] = f"v{d}_{i}" if d % 3 == 0 else words[i]
        chain.append((100 + d, " ".join(words)))
    for docs in [c[0] for c in cases[:3]] + [chain]:
        assert rows(ngram_join.linked(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(docs))
    kept = ngram_join.representatives(frame(spark, EDGES))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, n, c in brute.jaccard_components(EDGES) if d == c or not n}


def test_substring_dedup(spark, cases):
    from factloom.llm import substring_dedup

    for docs, _ in cases[:3]:
        assert rows(substring_dedup.removed(frame(spark, docs), bucket_bytes=200_000), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_words(docs))


def test_suffix_array_dedup(spark, cases):
    from factloom.llm import suffix_array_dedup

    for docs, _ in [*cases[1:3], ([c for c in cases[0][0] if len(c[1] or "") < 5000], [])]:
        assert rows(suffix_array_dedup.removed(frame(spark, docs), bucket_bytes=100_000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeated_bytes(docs))
    kept = suffix_array_dedup.deduplicated(frame(spark, EDGES))
    assert {1, 2, 3, 6, 9} <= {r["doc_id"] for r in kept.collect()} and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_repeated_and_null_ids(spark):
    from factloom.llm import ngram_join, packing, sharding, substring_dedup, suffix_array_dedup
    from factloom.llm.queries import tokenizer_path

    docs = frame(spark, [(None, PASSAGE), (None, PASSAGE), (5, PASSAGE), (5, PASSAGE), (7, "short")])
    n = docs.count()
    for df in (ngram_join.linked(docs), packing.pack(docs, tokenizer_path()), sharding.digest(docs), substring_dedup.removed(docs), suffix_array_dedup.removed(docs)):
        assert df.count() == n
    assert rows(substring_dedup.removed(docs).where("doc_id = 5"), "n_removed") == [(0,), (0,)]
    assert rows(substring_dedup.removed(docs).where("doc_id is null"), "n_removed") == [(60,), (60,)]


def test_language_id(spark, cases):
    from factloom.llm import language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identified(docs).toPandas().set_index("doc_id")
    known = docs.where("lang is not null and text is not null").toPandas().set_index("doc_id").lang
    held = got[got.held_out]
    both = held.index.intersection(known.index)
    assert (held.lang_pred[both] == known[both]).mean() > 0.95
    assert all(got.held_out[d] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got.index)
    edge = language_id.identified(frame(spark, EDGES)).toPandas().set_index("doc_id")
    assert [edge.lang_pred[d] for d in (1, 2, 3, 13)] == ["und"] * 4 and edge.score.between(0, 1).all()
    assert language_id.identified(frame(spark, [])).count() == 0


def test_fingerprints(spark, cases):
    from factloom.llm import fingerprints as fp

    docs = cases[0][0][:60] + [(10_000 + d, t) for d, t in EDGES]
    got = fp.compared(frame(spark, docs), partitions=5).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for (d, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        t, u = t or "", u or ""
        new = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got.n_chars[d] == len(t)
        assert got.edited_sha256[d] == __import__("hashlib").sha256(new.encode()).hexdigest()
        assert got.fingerprint[d] == fp.simhash(t).tobytes().hex() and got.edited_fingerprint[d] == fp.simhash(new).tobytes().hex()
    prints = fp.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))
    ints = sorted({int(r["fingerprint"], 16) for r in prints.collect()})
    want = sorted((f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for i, a in enumerate(ints) for b in ints[i + 1 :] if (a ^ b).bit_count() <= 6)
    assert rows(fp.near(prints, 6), "a", "b", "distance") == want


def test_html_extraction(spark):
    from factloom.llm import html_extraction

    page = "<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><div class='main-content'><article><h1>Head &amp; more</h1><p>First   one.</p><p>Second.</p></article><div class='comments'><p>reader says</p></div></div><footer>foot</footer></body></html>"
    pages = spark.createDataFrame([(1, "http://a.b/1", page), (2, "http://a.b/2", None), (3, None, "<p>bare"), (1, "http://a.b/1", page)], "page_id long, url string, html string")
    got = html_extraction.extracted(pages).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 4 and texts[1] == "Head & more First one. Second." and texts[2] == "" and texts[3] == "bare"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    all_pages = html_extraction.extracted(spark.read.parquet(f"{SF}/pages.parquet")).toPandas()
    assert (all_pages.n_chars > 0).all() and not all_pages.text.str.contains("<p>|<div", regex=True).any()


def test_html_containers_with_misleading_names(spark):
    from factloom.llm import html_extraction

    said = "<h1>Title</h1><p>The first paragraph of the article, which is long.</p><p>And a second one.</p>"
    text = "Title The first paragraph of the article, which is long. And a second one."
    side = "<div class='sidebar'><p>Read this too.</p><a href=x>More of this and of that</a></div>"
    names = ["class='content with-sidebar'", "class='has-ads'", "id='page-search'", "class='post hidden-nav'", "class='legal-news'"]
    html = [f"<html><head><title>T</title></head><body><nav>Menu</nav><div {n}>{said}{side}</div><footer>foot</footer></body></html>" for n in names]
    html += [f"<html><body><form action=x><div>{said}</div><input><label>Name</label></form></body></html>"]
    html += [f"<html><head><meta charset=utf-8><title>T</title><script>'<div>no</div>'</script>{end}<div>{said}</div>" for end in ("<body>", "", "</head>")]
    html += [f"<body><div class=story>{said}</div><div class=comments>{'<p>A reader says much about it, again and again.</p>' * 4}</div>"]
    html += [f"<body><article>{said}</article><div class=related>{'<p>Another story about something else altogether.</p>' * 4}</div>"]
    pages = spark.createDataFrame([(i, f"http://h{i}.b/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extracted(pages).collect()}
    assert got == dict.fromkeys(range(len(html)), text)
    page = lambda inner, top="": f"<body>{top}<div class='content with-sidebar'>{inner}</div></body>"
    host = [(i, "http://one.b/", page(said)) for i in range(3)] + [(3, "http://one.b/", page("<p>Brief.</p>", "<p>Our site</p>"))]
    got = {r["page_id"]: r["text"] for r in html_extraction.extracted(spark.createDataFrame(host, pages.schema)).collect()}
    assert got == {0: text, 1: text, 2: text, 3: "Brief."}


def test_quality(spark):
    from factloom.llm import quality

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(docs, labels).toPandas().set_index("doc_id")
    known = labels.where("quality is not null").toPandas().drop_duplicates("doc_id").set_index("doc_id").quality
    both = got.index[got.held_out].intersection(known.index)
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    if known[both].nunique() == 2:
        assert got.score[both][known[both] == 1].median() > got.score[both][known[both] == 0].median()
    assert quality.scored(frame(spark, []), labels).count() == 0
    none = quality.scored(frame(spark, EDGES), labels.limit(0)).toPandas()
    assert (none.score == 0.5).all()


def test_quality_reads_long_words_whole(spark):
    from collections import Counter

    from factloom.llm import quality

    rng = np.random.default_rng(2)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    texts = ["你好" * 30 + draw("学习语言" if d % 2 else "广告点击", 400) + "再见" * 30 for d in range(60)]
    docs = frame(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(60)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).toPandas()
    held = got[got.held_out]
    assert len(held) and held.score[held.doc_id % 2 == 1].min() > held.score[held.doc_id % 2 == 0].max()


def test_quality_features_are_those_of_plain_code():
    from collections import Counter

    from factloom.llm import quality

    rng = np.random.default_rng(4)
    texts = ["one two  two\tthree", None, "", " x ", "你好" * 700 + " a", "é" * 45 + " " + "b" * 41, *("".join(rng.choice(list("ab cé\n"), 60)) for _ in range(20))]
    adds = rng.normal(size=quality.ROWS).astype(np.float32)
    together = quality.log_odds(texts, adds)
    for text, got in zip(texts, together):
        rows, share = quality.histogram(text)
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        grams = sum(len(f" {w} ") - n + 1 for w in words for n in (2, 3, 4) if len(w) + 2 >= n) + sum(map(len, words))
        shared = sum(1 for a, b in zip(re.findall(r"\S+", text or ""), re.findall(r"\S+", text or "")[1:]))
        counts = Counter(dict(zip(rows.tolist(), np.rint(share * (grams + len(words) + shared)).astype(int).tolist())))
        assert sum(counts.values()) == grams + len(words) + shared if words else rows.tolist() == [quality.EMPTY]
        assert got == pytest.approx(float(adds[rows] @ share), abs=1e-5) and got == quality.log_odds([text], adds)[0]


def test_language_sample_takes_copies_once(spark):
    from factloom.llm import language_filter, language_id

    rows = [("en", f"text number {i}") for i in range(300)] + [("en", "one hot text")] * 1000 + [("fr", f"texte {i}") for i in range(40)] + [(None, "x"), ("de", None), (" ", "y")]
    got = language_id.drawn(spark.createDataFrame(rows, "lang string, text string"), per_lang=50, most=100).collect()
    assert len(got) == len({tuple(r) for r in got}) == 90 and {r["lang"] for r in got} == {"en", "fr"}
    docs = spark.createDataFrame([(i, t, la, "clash") for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, lang_pred string")
    kept = language_filter.accepted(docs)
    assert kept.columns == docs.columns and {r["lang_pred"] for r in kept.collect()} == {"clash"}
    assert kept.where("lang is null or lang = ' '").count() == 0


def test_language_filter_rejects_noise_and_unlearned_languages(spark):
    """Learned from the table; what goes are noise and languages that are not in it, what stays short, clean and mixed texts."""
    from factloom.llm import language_filter

    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    noise = ["".join(rng.choice(letters, n)) for n in (40, 200, 5000)] + [" ".join("".join(rng.choice(letters, 6)) for _ in range(30))]
    foreign = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Все люди рождаются свободными и равными в своем достоинстве и правах", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw"]
    docs = duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchall()
    short = ["Ción de la.", "The of and", "qwx zzkj"]  # the last has under 12 bytes
    by = {k: next(t for _, t, g in docs if g == k and 400 < len(t) < 2000) for k in ("en", "es", "fr", "de")}
    mixed = [by["en"] + "\n" + by["es"], by["fr"] + " " + by["de"], by["es"][:60], by["de"][:30]]
    extra = [(10**6 + i, t) for i, t in enumerate(noise + foreign)], [(2 * 10**6 + i, t) for i, t in enumerate(short + mixed)]
    rows = docs + [(d, t, None) for group in extra for d, t in group]
    got = {r["doc_id"]: r["lang"] for r in language_filter.accepted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not {d for d, _ in extra[0]} & set(got)
    assert {d for d, _ in extra[1]} <= set(got) and None not in got.values()
    lettered = {d for d, t, _ in docs if any(map(str.isalpha, t))}
    assert len(lettered - set(got)) <= 0.002 * len(lettered)


def test_clashing_names_pass_through(spark):
    from factloom.llm import decontamination, ngram_join, quality, suffix_array_dedup

    docs = spark.createDataFrame([(d, t, "a", "b", "c", "d", "e", "f", "g") for d, t in EDGES], "doc_id long, text string, _id string, _c string, c1 string, spans string, _cut string, id string, n string")
    items = spark.createDataFrame(BENCH, "item_id string, text string")
    labels = spark.createDataFrame([(d, d % 2, 0) for d, _ in EDGES], "doc_id long, quality int, toxic int")
    for out in (ngram_join.representatives(docs), suffix_array_dedup.deduplicated(docs), decontamination.clean(docs, items), quality.good(docs, labels)):
        assert out.columns == docs.columns
        assert {tuple(r)[2:] for r in out.collect()} <= {("a", "b", "c", "d", "e", "f", "g")}


def test_sharding(spark, cases):
    from factloom.llm import sharding

    for docs, _ in cases[:3]:
        got = sharding.digest(frame(spark, docs), bucket_rows=16).toPandas()
        assert sorted(got.doc_id) == sorted(d for d, _ in docs)
        if len(got):
            counts = got.groupby("shard").size().reindex(range(8), fill_value=0)
            assert counts.max() - counts.min() <= 1
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        text = dict(docs)
        assert all(c == brute.crc(text[d]) and s == len((text[d] or "").encode()) + 1 for d, c, s in zip(got.doc_id, got.text_crc32, got["size"]))
    plan = sharding.digest(frame(spark, EDGES))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    many = frame(spark, [(d, f"text {d}") for d in range(500)])
    one = rows(sharding.digest(many.repartition(7), bucket_rows=64), "doc_id", "shard", "slot")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(sharding.digest(many.coalesce(1), bucket_rows=64), "doc_id", "shard", "slot") == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sum(a == b for a, b in zip([d for d, *_ in sorted(one, key=lambda r: (r[2], r[1]))], range(500))) < 50
    hot = frame(spark, [(None, None)] * 400 + [(d, "x") for d in range(20)])
    got = sharding.digest(hot, bucket_rows=32).toPandas()
    assert len(got) == 420 and got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1


def test_written_shards(spark, tmp_path):
    from factloom.llm import sharding

    docs = frame(spark, EDGES)
    sharding.write_shards(docs, f"{tmp_path}/shards", shards=3, bucket_rows=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert rows(back, *docs.columns) == rows(docs, *docs.columns) and back.select("shard").distinct().count() == 3


def test_near_fingerprints_of_queries(spark):
    from factloom.llm import fingerprints as fp

    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    docs = [(d, " ".join(words if d % 3 else [*words[: rng.integers(150, 200)], f"v{d}"])) for d in range(150)] + EDGES[:5]
    got = fp.searched(frame(spark, docs)).toPandas()
    ints = [int(x, 16) for x in got.fingerprint]
    for d, x, n in zip(got.doc_id, ints, got.n_near):
        assert n == sum((x ^ y).bit_count() <= 3 for y in ints) if d % 50 == 0 else np.isnan(n)


def test_html_votes_of_a_host(spark):
    from factloom.llm import html_extraction

    said = lambda i: "".join(f"<p>Sentence {j} of page {i} says this and that.</p>" for j in range(4))
    text = lambda i: " ".join(f"Sentence {j} of page {i} says this and that." for j in range(4))
    html = [f"<body><div class='t{'abcdefghijkl'[k]}'><div class=story>{said(i)}</div><div class=box><a href=x>More links</a></div></div></body>" for i, k in enumerate([*range(12), *range(12)])]
    html.append("<body><div class=ta><div class=story><p>Brief.</p></div><div class=box><p>A long box, longer than the story, on this page alone.</p></div></div></body>")
    pages = spark.createDataFrame([(i, "http://one.b/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    reports = html_extraction.reported(pages)
    found = html_extraction.consensus(reports)
    assert found.where("votes is not null").count() >= 12
    assert max(len(r["paths"]) for r in html_extraction.looked_up(reports, found).collect()) <= 2  # each page has only its own
    for parts in ({}, {"broadcast_bytes": -1}):
        got = {r["page_id"]: r["text"] for r in html_extraction.extracted(pages, **parts).collect()}
        assert {i: got[i] for i in range(24)} == {i: text(i) for i in range(24)} and got[24] == "Brief."
    own = [(0, "http://two.b/", f"<article>{said(0)}<section class='related-work'><p>Others did so before.</p></section><math>x = 1</math><div class='related-posts'><a href=y>Other post</a></div></article>")]
    assert html_extraction.extracted(spark.createDataFrame(own, pages.schema)).first()["text"] == text(0) + " Others did so before. x = 1"


def test_pipeline(spark):
    """Each stage after the first against brute force, on its own input."""
    import corpus_pipeline
    from factloom.llm.queries import table

    docs = table(spark, SF, "documents")
    kinds = docs.columns
    bench = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, SF).toPandas()
    lettered = {r["doc_id"] for r in docs.collect() if r["text"] and any(map(str.isalpha, r["text"]))}
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    assert set(first.doc_id) <= lettered and lettered & good <= set(first.doc_id) and len(first) >= 0.99 * len(lettered)
    docs = spark.createDataFrame(first, docs.schema)
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    second = stages["ngram_jaccard_join"](spark, docs, SF).toPandas()
    assert sorted(second.doc_id) == sorted(d for d, n, c in brute.jaccard_components(own) if d == c)
    docs = spark.createDataFrame(second, docs.schema)
    own = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    third = stages["suffix_array_dedup"](spark, docs, SF).toPandas()
    left = {d: bytes(c for c, m in zip(u, mask) if not m).decode("utf-8", "ignore") if any(mask) else u.decode() for d, u, mask in brute._covered(own, lambda t: t.encode(), 50)}
    assert dict(zip(third.doc_id, third.text)) == {d: t for d, t in left.items() if t.strip()}
    docs = spark.createDataFrame(third, docs.schema)
    fourth = stages["benchmark_decontamination"](spark, docs, SF).toPandas()
    judged = {d: (n, hit) for d, n, hit, *_ in brute.decontaminate(list(zip(third.doc_id, third.text)), bench)}
    assert set(fourth.doc_id) == {d for d, (n, hit) in judged.items() if not hit or hit < 0.5 * n}
    assert all(t == u for d, t, u in zip(fourth.doc_id, fourth.text, fourth.doc_id.map(dict(zip(third.doc_id, third.text)))) if not judged[d][1])
    assert list(fourth.columns) == kinds and all(n == len(t) for n, t in zip(fourth.n_chars, fourth.text))
    fifth = stages["packing"](spark, spark.createDataFrame(fourth, docs.schema), SF).toPandas()
    assert set(fifth.doc_id) == set(fourth.doc_id) and fifth.groupby("sequence_id").length.sum().max() <= 4096
    assert corpus_pipeline.run(spark, SF).count() == len(fifth)
    empty = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_without_labels(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from factloom.llm import language_filter

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    edge = frame(spark, EDGES)
    kept = {d for d, t in EDGES if t and any(map(str.isalpha, t))}
    held = [d for d in kept if zlib.crc32(str(d).encode()) % 3 == 1]
    for lang in (F.lit(None).cast("string"), F.lit(" "), F.when(F.col("doc_id").isin(held), "en")):
        got = language_filter.accepted(edge.withColumn("lang", lang))
        assert got.columns == edge.columns and {r["doc_id"] for r in got.collect()} == kept
