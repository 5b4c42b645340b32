"""The thin queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fingerprints, html_extraction, language_id, merkle, ngram_join, packing, prefix_trie, quality, quality_rules, sharding, substring_dedup, suffix_array_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), seq_len=4096)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"), shards=8)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.searched(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"), k=5, percent=75)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(table(spark, sf_dir, "documents"), window=13)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.removed(table(spark, sf_dir, "documents"), match=50)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_decontamination, op3_language_id, op4_fingerprints, op5_ngram_jaccard_join, op6_html_extraction, op7_substring_dedup, op8_quality, op9_sharding, op10_suffix_array_dedup, op11_merkle_manifest, op12_quality_rules, op13_conversation_prefix_trie)
}

def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text: eight steps of the polynomial for each character."""
    step = "lambda x, _: xor(x >> 1, 3988292384 * (x & 1))"
    chars = f"[cast(ord(c) as bigint) for c in str_split({text}, '') if c <> '']"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {chars}), lambda a, b: list_reduce(list_prepend(xor(a, b), [cast(0 as bigint), 0, 0, 0, 0, 0, 0, 0]), {step})), 4294967295)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_decontamination": rf"""
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
  items as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
  grams as (
    select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
    from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)
  ),
  sizes as (select distinct n from grams),
  windows as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where len(w) >= n)
  ),
  met as (select distinct doc_id, i, n, item_id from windows join grams using (n, g)),
  hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from met) group by doc_id),
  found as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct doc_id, item_id from met) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (doc_id) left join found using (doc_id)
""",
    "op5_ngram_jaccard_join": rf"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
  grams as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)
  ),
  sizes as (select doc_id, count(*) as n from grams group by doc_id),
  pairs as (
    select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as o from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id group by all) p
    join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * o >= 75 * (s.n + t.n - o)
  ),
  links as (select a, b from pairs union all select b, a from pairs),
  reach as (select doc_id, doc_id as r from sizes union select l.b, r.r from reach r join links l on l.a = r.doc_id)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(c, doc_id) as component_id
from words left join sizes using (doc_id) left join (select doc_id, min(r) as c from reach group by doc_id) using (doc_id)
""",
    "op7_substring_dedup": r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
  windows as (
    select doc_id, i, array_to_string(w[i : i + 12], ' ') as g
    from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) > 12)
  ),
  firsts as (select g, min(doc_id) as d from windows group by g having min(doc_id) < max(doc_id)),
  gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from (select doc_id, i from windows join firsts using (g) where doc_id > d)),
  units as (select doc_id, i, w[i] as s from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words)),
  kept as (
    select doc_id, count(*) filter (gone.i is not null) as n_removed, string_agg(s, ' ' order by units.i) filter (gone.i is null) as left_
    from units left join gone using (doc_id, i) group by doc_id
  )
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(left_, '')) as kept_sha256 from words left join kept using (doc_id)
""",
    "op10_suffix_array_dedup": r"""
with texts as (select doc_id, encode(coalesce(text, '')) as x from documents),
  units as (select doc_id, i, x[i : i] as s, case when octet_length(x) - i >= 49 then x[i : i + 49] end as g
    from (select doc_id, x, unnest(range(1, octet_length(x) + 1)) as i from texts)),
  firsts as (select g, min(doc_id) as d from units where g is not null group by g having min(doc_id) < max(doc_id)),
  hits as (select doc_id, i, s, coalesce(d < doc_id, false) as hit from units left join firsts using (g)),
  marks as (select doc_id, i, s, bool_or(hit) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from hits),
  runs as (select doc_id, i, s, gone, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from marks),
  kept as (
    select doc_id, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans, string_agg(hex(s), '' order by i) filter (not gone) as left_
    from runs group by doc_id
  )
select doc_id, cast(octet_length(x) as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(left_, ''))) as kept_sha256
from texts left join kept using (doc_id)
""",
}


def _merkle_sql(levels: int = 6, above: int = 5) -> str:
    """Every level is a table of nodes; h is a node, n the number of nodes on its level.  `levels` is enough for 16^6 rows a source."""
    field = lambda x: f"case when {x} is null then '-' else strlen(cast({x} as varchar)) || ':' || {x} end"
    leaf = lambda text: "sha256(concat(" + ", ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + "))"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    parts = [
        f"""leaves as (select doc_id, coalesce('+' || source, '') as g, {leaf("text")} as leaf,
          case when {crc32_sql("coalesce(cast(doc_id as varchar), '')")} % 5 = 0 then {leaf(lower)} else {leaf("text")} end as held from documents)""",
        """p0 as (select *, leaf as h, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i0, count(*) over (partition by g) as n from leaves)""",
        "t0 as (select g, i0 as i, n, h from p0)", "d0 as (select *, held as f, '' as proof from p0)",
    ]
    up = "case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h"
    for k in range(levels + above):
        if k == levels:  # the tree over the sources
            parts.append(f"top as (select '' as g, row_number() over (order by g) - 1 as i, count(*) over () as n, h, g as source_key from t{k})")
            parts.append(f"t{k}_ as (select g, i, n, h from top)")
            parts.append(f"d{k}_ as (select d.* exclude (i{k}, g), top.i as i{k}, '' as g, top.h as subroot from d{k} d join top on top.source_key = d.g)")
        t, d = (f"t{k}_", f"d{k}_") if k == levels else (f"t{k}", f"d{k}")
        parts.append(f"t{k + 1} as (select g, i // 16 as i, (any_value(n) + 15) // 16 as n, {up} from {t} group by g, i // 16)")
        parts.append(f"""x{k} as (select d.*, r.left_, r.right_ from {d} d, lateral (
          select coalesce(string_agg(h, '' order by i) filter (i < d.i{k}), '') as left_, coalesce(string_agg(h, '' order by i) filter (i > d.i{k}), '') as right_
          from {t} t where t.g = d.g and t.i // 16 = d.i{k} // 16) r)""")
        parts.append(f"""d{k + 1} as (select * exclude (f, proof, left_, right_), i{k} // 16 as i{k + 1}, proof || left_ || right_ as proof,
          case when left_ || right_ = '' and (select max(n) from {t} t where t.g = x{k}.g) = 1 then f else sha256(left_ || f || right_) end as f from x{k})""")
    last = levels + above
    return "with " + ",\n  ".join(parts) + f"""
select doc_id, leaf, subroot, (select h from t{last}) as root, sha256(proof) as proof_sha256, f as folded_root, f = (select h from t{last}) as verified from d{last}"""


ORACLES["op11_merkle_manifest"] = _merkle_sql()
ORACLES["op13_conversation_prefix_trie"] = rf"""
with turns as (select conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as w
    from conversations where conv_id is not null),
  own as (select conv_id, list(k order by turn nulls first, k) as ks, list(w order by turn nulls first, k) as ws, {crc32_sql("cast(conv_id as varchar)")} % 4 as h from turns group by conv_id),
  rebuilt as (
    select o.conv_id, list_concat(coalesce(list_slice(d.ks, 1, o.h), []), list_slice(o.ks, o.h + 1, len(o.ks))) as ks, list_concat(coalesce(list_slice(d.ws, 1, o.h), []), list_slice(o.ws, o.h + 1, len(o.ws))) as ws
    from own o left join own d on d.conv_id = o.conv_id - o.conv_id % 20
  ),
  prefixes as (select conv_id, d, list_slice(ks, 1, d) as p, case when d > 0 then ws[d] else 0 end as w, d = len(ks) as ends from (select *, unnest(range(0, len(ks) + 1)) as d from rebuilt)),
  nodes as (
    select d, p, min(conv_id) as conv_id, count(*) as n_convs, any_value(w) as w, string_agg(conv_id, ',' order by conv_id) filter (ends) as ids from prefixes group by d, p
  ),
  grown as (select d - 1 as d, list_slice(p, 1, d - 1) as p, count(*) as n_children from nodes where d > 0 group by 1, 2),
  counted as (select n.*, coalesce(g.n_children, 0) as n_children from nodes n left join grown g using (d, p)),
  below as (
    select a.d, a.p, count(*) filter (b.n_children = 0) as n_leaves, cast(sum((b.n_convs - 1) * b.w) as bigint) as saved_tokens
    from counted a join counted b on b.d >= a.d and list_slice(b.p, 1, a.d) = a.p group by a.d, a.p
  )
select n.conv_id, cast(n.d as bigint) as depth, u.conv_id as parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(n.ids, '')) as ends_sha256
from counted n join below b using (d, p) left join nodes u on n.d > 0 and u.d = n.d - 1 and u.p = list_slice(n.p, 1, n.d - 1)
"""
