"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over every token window.

The benchmark is a stated, small item set.  It is split into blocks of a checked size; each block's windows are sent to
the executors once and every document's windows are looked up against it (hash first, then the exact word sequence).
With one block, the usual case, one pass over the documents does; with more, each pass but the last is written to the
shared folder with the hits so far beside the unchanged texts, so the result never depends on the number of blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut as stored
from .common import lean, mix, named_back, positional, release, slices, spans_of

WINDOW = 10
#: A-Z to a-z; digits, a-z and bytes above 127 as they are; all else separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_SPANS = "array<struct<first:int,last:int>>"
_KIND = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Windows:
    """The windows of a block of items: by length, word ids -> items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.by_length: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(dict)
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1) if n else ():
                self.by_length[n].setdefault(tuple(ids[i : i + n]), set()).add(name)
        self.hashes = {n: np.unique(self._hash(np.array(list(w), np.uint64))) for n, w in self.by_length.items()}

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for column in rows.astype(np.uint64).T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
        return h

    def find(self, ids: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """Position, length and items of every window that occurs; 0 in ids is a word of no item, or a document's end."""
        found = []
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for n, windows in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            rows = ids[at[:, None] + np.arange(n)]
            kept = np.isin(self._hash(rows), self.hashes[n])
            for i, row in zip(at[kept].tolist(), rows[kept].tolist(), strict=True):
                if items := windows.get(tuple(row)):
                    found.append((i, n, items))
        return found


def _hits(windows: Windows, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Per text: its words, the runs of words that windows hit, and the items found."""
    get = windows.vocabulary.get
    ids, counts = [], []
    for text in texts:
        words = words_of(text)
        ids.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        ids.append(np.zeros(1, np.int64))  # no window crosses from one document to the next
        counts.append(len(words))
    starts = np.concatenate(([0], np.cumsum(np.array(counts) + 1)))
    hits: dict[int, list[tuple[int, int, set[str]]]] = defaultdict(list)
    for i, n, items in windows.find(np.concatenate(ids)):
        doc = int(np.searchsorted(starts, i, "right")) - 1
        hits[doc].append((i - int(starts[doc]), n, items))
    spans, names = [], []
    for doc, n_words in enumerate(counts):
        if doc not in hits:
            spans.append([]), names.append([])
            continue
        spans.append(_merged([(i, i + n) for i, n, _ in hits[doc]], n_words))
        names.append(sorted(set().union(*(x[2] for x in hits[doc]))))
    return counts, spans, names


def _merged(spans: list[tuple[int, int]], n_words: int) -> list[tuple[int, int]]:
    mask = np.zeros(n_words, bool)
    for a, b in spans:
        mask[a:b] = True
    return [(int(a), int(b)) for a, b in zip(*spans_of(mask), strict=True)]


def _dealt(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The items with their block, and the number of blocks: each of at most block_bytes of text (or one item), small enough to send to all executors."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string"))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) if n > 1 else F.lit(0)), n


def _windows(dealt: DataFrame, block: int, window: int) -> Windows:
    return Windows([(r.item_id, r.text) for r in dealt.where(F.col("block") == block).collect()], window)


def _pass(docs: DataFrame, windows: Windows) -> DataFrame:
    """docs, which has a column text, with n_words and with the hits of one block added to spans and items."""
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    more = "spans" in docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept) + f", n_words long, spans {_SPANS}, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=4 << 20):
            counts, spans, names = _hits(windows, batch.column("text").to_pylist())
            if more:
                before = [[(s["first"], s["last"]) for s in own] for own in batch.column("spans").to_pylist()]
                spans = [_merged(a + b, n) for a, b, n in zip(before, spans, counts, strict=True)]
                names = [sorted({*a, *b}) for a, b in zip(batch.column("items").to_pylist(), names, strict=True)]
            added = [pa.array(counts, pa.int64()), pa.array([[{"first": a, "last": b} for a, b in own] for own in spans], _KIND), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *added], [*kept, "n_words", "spans", "items"])

    return docs.mapInArrow(lean(run), schema)


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """docs, which has a column text, with n_words, spans (runs of hit words) and items of all blocks; one block's windows at a time are on the driver."""
    dealt, n = _dealt(benchmark, block_bytes)
    for block in range(n):
        before, docs = docs, _pass(docs, _windows(dealt, block, window))
        if block < n - 1:
            docs = stored(docs)
            release(before)
    return docs


def _mask_size(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["last"] - s["first"]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans (runs of hit words, first and the one behind the last) and items found, in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _marked(rows, benchmark, window, block_bytes).drop("text")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    A null text has no words; an item without words has no window; equal item ids count once; equal documents are
    reported each; an empty benchmark hits nothing; an empty table of documents gives an empty result.
    """
    found = find(docs, benchmark, window, block_bytes)
    return found.select(
        "doc_id", "n_words", _mask_size("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """docs without the benchmark: hit spans are cut out of the text, and a document hit in drop_share of its words or more goes.

    Columns are those of docs, whatever their names.  n_chars, where there is one, follows the new text.  Documents
    without a hit, null and blank ones included, pass unchanged; repeated rows are judged each; an empty benchmark
    changes nothing; an empty table gives an empty result.
    """
    plain, at = positional(docs, "text", "n_chars")
    kinds, where = plain.schema, plain.columns.index(at["text"])
    marked = _marked(plain.withColumn("text", F.col(at["text"]).cast("string")).drop(at["text"]), benchmark, window, block_bytes)
    marked = marked.where((F.size("spans") == 0) | (_mask_size("spans") < drop_share * F.col("n_words")))
    kept = [c for c in marked.columns if c not in ("text", "n_words", "spans", "items")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name in kept) + ", text string, less boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[(s["first"], s["last"]) for s in own] for own in batch.column("spans").to_pylist()]
            texts = [_without(t, own) if own else t for t, own in zip(batch.column("text").to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string()), pa.array(list(map(bool, spans)))], [*kept, "text", "less"])

    done = marked.mapInArrow(lean(run), schema).withColumn(f"_{where}", F.col("text").cast(kinds[where].dataType))
    if "n_chars" in at:
        size = F.length("text").cast(kinds[at["n_chars"]].dataType)
        done = done.withColumn(at["n_chars"], F.when(F.col("less"), size).otherwise(F.col(at["n_chars"])))
    return named_back(done, docs)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without these runs of words."""
    raw = text.encode("utf-8", "surrogatepass")
    first, last = spans_of(np.frombuffer(raw.translate(_WORDS), np.uint8) != 32)
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at : first[a]])
        at = last[b - 1]
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")
