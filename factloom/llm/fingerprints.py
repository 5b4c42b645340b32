"""Document fingerprints: SimHash with permuted block tables.

Terms are word pairs (a text of one word has that word), weighted by 1 + ln(tf) in steps of 1/64.  Each term's 128 hash bits vote with
its weight for 1 or 0; the majority makes the fingerprint, so texts with most terms in common differ in few bits.
found() and near() find all fingerprints within a Hamming radius: the bits are cut into blocks, and any two fingerprints
within the radius agree on some combination of blocks, each of which keys one permuted table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, cut, id_key, lean, mix, shuffle_width, slices, word_hashes, words_in

BITS = 128
_R = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def simhashes(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text as BITS / 8 bytes; all zero for a text without words."""
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    data = _LOWER[data]
    start, end, counts = words_in(data, offsets)
    words, at, out = word_hashes(data, start, end), 0, []
    for n in counts.tolist():
        h, at = words[at : at + n], at + n
        if not n:
            out.append(np.zeros(BITS // 8, np.uint8))
            continue
        terms, tf = np.unique(mix(h[:-1] * _R + h[1:]) if n > 1 else mix(h), return_counts=True)
        weight = np.rint(64 * (1 + np.log(tf))).astype(np.float32)  # whole numbers: sums do not depend on their order
        half, votes = weight.sum(dtype=np.float64) / 2, np.zeros(BITS)
        for i in range(0, len(terms), 8192):  # in bounded memory, however long the text
            part = terms[i : i + 8192]
            bits = np.unpackbits(np.stack((part, mix(part ^ _R)), 1).view(np.uint8), axis=1)
            votes += weight[i : i + 8192] @ bits.astype(np.float32)
        out.append(np.packbits(votes > half))
    return out


def simhash(text: str) -> np.ndarray:
    return simhashes([text])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bits."""
    return 1.0 - int(np.unpackbits(a ^ b).sum()) / BITS


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DONE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in _DONE.split(", ")]


def _against(docs: list[int | None], texts: list[str], following: list[str], own: list[np.ndarray], others: list[np.ndarray]) -> list[tuple]:
    """The rows of documents whose next texts (and both fingerprints) are known."""
    edits = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    out = []
    for doc, text, new, a, b, c in zip(docs, texts, edits, own, simhashes(edits), others, strict=True):
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((doc, len(text), sha, a.tobytes().hex(), b.tobytes().hex(), likeness(a, b), likeness(a, c)))
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each finished once the next is known; the first and the last of the partition go out with their texts."""
    part, first, docs, texts, own = TaskContext.get().partitionId(), None, [], [], []
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
    names = [*_NAMES, "part", "first_text", "last_text", "last_doc"]

    def rows(done: list[tuple], *ends: tuple) -> pa.RecordBatch:
        full = [(*x, None, None, None, None) for x in done] + [(*[None] * 7, *e) for e in ends]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*full, strict=True), kinds, strict=True)], names)

    for batch in slices(batches, most_bytes=2 << 20):
        new = batch.column("text").to_pylist()
        first = new[0] if first is None else first
        docs, texts, own = docs[-1:] + batch.column("doc_id").to_pylist(), texts[-1:] + new, own[-1:] + simhashes(new)
        if len(texts) > 1:
            yield rows(_against(docs[:-1], texts[:-1], texts[1:], own[:-1], own[1:]))
    if texts:
        yield rows([], (part, first, texts[-1], docs[-1]))


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts, following = (batch.column(c).to_pylist() for c in ("last_doc", "last_text", "next_text"))
        if done := _against(docs, texts, following, simhashes(texts), simhashes(following)):
            yield pa.RecordBatch.from_arrays([pa.array(c) if c[0] is not None else pa.array(c, pa.int64()) for c in zip(*done, strict=True)], _NAMES)


def compared(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next document is that of the next larger doc_id; after the last comes the first.  Rows are range-partitioned by
    doc_id and walked in order, so texts move once; only the last row of each partition waits for the first text of the
    next.  Null texts are empty; rows with equal doc_ids follow each other in the order of their text's hash; null
    doc_ids come last; a single row follows itself; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    n = partitions or 2 * shuffle_width(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("doc_id", "text")
    walked = cut(ordered.mapInArrow(lean(_walk), _DONE + ", part int, first_text string, last_text string, last_doc long"))
    ends = walked.where("part is not null").select("part", "first_text", "last_text", "last_doc")
    order = Window.orderBy("part")  # numbers of partitions only
    parts = ends.select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())))
    nexts = ends.select(F.col("part").alias("next"), F.col("first_text").alias("next_text"))
    last = ends.join(parts, "part").join(nexts, "next").select("last_doc", "last_text", "next_text").mapInArrow(lean(_close), _DONE)
    return walked.where("part is null").select(*_NAMES).unionByName(last)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of every row; null texts are empty."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=2 << 20):
            prints = [p.tobytes().hex() for p in simhashes([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(take), "doc_id long, fingerprint string")


def _tables(prints: DataFrame, radius: int, spare: int) -> tuple[DataFrame, list[str]]:
    """The permuted block tables of distinct fingerprints (a column fingerprint and any others): one row a table, with its number t and key k.

    The fingerprint is cut into radius + spare blocks; two that differ in at most radius bits agree on at least `spare`
    of them.  There is one table per combination of `spare` blocks; its key is those blocks.
    """
    blocks = radius + spare
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    bits = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", i, 8), 16, 2), 32, "0") for i in range(1, BITS // 4, 8)])
    names = [f"b{i}" for i in range(blocks)]
    words = [F.conv(F.substring("fingerprint", i, 8), 16, 10).cast("long").alias(f"w{i // 8}") for i in range(1, BITS // 4, 8)]
    cutup = prints.withColumn("bits", bits).select("*", *words, *[F.conv(F.substring("bits", edges[i] + 1, edges[i + 1] - edges[i]), 2, 10).cast("long").alias(names[i]) for i in range(blocks)])
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[names[i] for i in c]).alias("k")) for t, c in enumerate(combinations(range(blocks), spare))])
    return cutup.drop("bits").select("*", F.explode(keys).alias("key")).select("*", "key.t", "key.k").drop("key"), names


def _close_pairs(x: DataFrame, y: DataFrame, names: list[str], radius: int, spare: int):
    """Join condition of x and y, and the distance: within radius, and in the first table in which the two agree, so that no pair comes twice."""
    distance = sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in range(BITS // 32)), F.lit(0))
    agree = [F.col(f"x.{n}") == F.col(f"y.{n}") for n in names]
    chosen = F.coalesce(*[F.when(reduce(and_, [agree[i] for i in c]), F.lit(t)) for t, c in enumerate(combinations(range(len(names)), spare))])
    return (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k")) & (distance <= radius) & (chosen == F.col("x.t")), distance


def near(prints: DataFrame, radius: int = 6, spare: int = 2) -> DataFrame:
    """All pairs a < b of distinct fingerprints (hex) within `radius` bits, with their distance; join prints for the members.

    For tables whose near pairs are few; found() answers a set of queries and splits hot keys.  Nulls are left out.
    """
    one = prints.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
    keyed, names = _tables(one, radius, spare)
    on, distance = _close_pairs(keyed, keyed, names, radius, spare)
    return keyed.alias("x").join(keyed.alias("y"), on & (F.col("x.fingerprint") < F.col("y.fingerprint"))).select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"), distance.alias("distance"))


def found(queries: DataFrame, prints: DataFrame, radius: int = 3, spare: int = 1, parts: int = 16) -> DataFrame:
    """Per distinct fingerprint of `queries`: n_near, the number of rows of `prints` (fingerprint) within `radius` bits, copies included.

    Equal fingerprints meet first, map-side; every key's rows are dealt to `parts` groups, and the queries, a small
    share of all rows, go to each.  Nulls are left out.
    """
    items = prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    asked = queries.select("fingerprint").where("fingerprint is not null").distinct()
    y, names = _tables(items, radius, spare)
    x, _ = _tables(asked, radius, spare)
    y = y.withColumn("part", F.pmod(F.xxhash64(F.lit(parts), "fingerprint"), F.lit(parts)).cast("int")).alias("y")
    x = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).alias("x")
    on, _ = _close_pairs(x, y, names, radius, spare)
    return x.join(y, on & (F.col("x.part") == F.col("y.part"))).groupBy(F.col("x.fingerprint").alias("fingerprint")).agg(F.sum("y.copies").alias("n_near"))


def searched(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """compared(docs) with n_near: for documents whose id is divisible by `every`, the rows within `radius` bits of its fingerprint, itself included; else null."""
    done = cut(compared(docs))
    asked = F.col("doc_id") % every == 0
    near_ = found(done.where(asked), done, radius).withColumnRenamed("fingerprint", "_print")
    return done.join(near_, asked & (F.col("fingerprint") == F.col("_print")), "left").drop("_print")
