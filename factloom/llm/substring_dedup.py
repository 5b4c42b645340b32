"""Substring dedup by super-k-mer partitioning: repeated word windows across documents, counted exactly.

1. Equal texts become one class with its smallest doc_id.
2. Every class's words are cut into super-k-mers: consecutive windows of 13 words whose smallest 3-word hash is the same
   travel together as one packed string (words joined by a space) to the bucket of that hash.
3. In a bucket the windows are sorted; equal ones form a run, whose smallest doc_id keeps the window.  The sort is by
   a 64-bit hash and the words of neighbours are compared, so counts are exact.
4. Hits go back to their class as (start, windows) pairs, and the words they cover are removed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, SPACES, buffers, class_key, classes, even_keys, group_starts, lean, mix, ranges, slices, sliding_min, text_bytes, unpack_arrays, word_hashes, words_in
from .superkmers import HITS, SENT, Outbox, covered, hit_rows, passed_on, runs

WINDOW = 13
_MINI = 3
_LONGEST = 64
_R = np.uint64(0x9E3779B97F4A7C15)


def _cut(window: int, keys: list[int]):
    wide = window - min(_MINI, window) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=6 << 20):
            batch = batch.take(pa.array(np.argsort(batch.column("first_id").to_numpy(zero_copy_only=False), kind="stable")))
            c1, c2, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("c1", "c2", "first_id"))
            data, offsets = buffers(batch.column("text"))
            at, end, counts = words_in(data, offsets)
            out = Outbox(keys)
            n = len(at)
            if n >= window:
                h = word_hashes(data, at, end)
                size = end - at + 1  # the words again, one space after each
                stop = np.cumsum(size)
                raw = np.full(int(stop[-1]), 32, np.uint8)
                inside = ~SPACES[data]
                raw[ranges(stop - size, size - 1)] = data[inside]
                raw, open_, stop = raw.tobytes(), (stop - size).tolist(), (stop - 1).tolist()
                del data, at, end, inside
                m = window - wide + 1
                g = h[: n - m + 1].copy()
                for j in range(1, m):
                    g = g * _R + h[j : n - m + 1 + j]
                low = sliding_min(mix(g), wide)
                starts = np.cumsum(counts) - counts
                valid = np.zeros(n - window + 1, bool)
                valid[ranges(starts, np.maximum(counts - window + 1, 0))] = True
                first, count = runs(low, valid, _LONGEST)
                doc = np.searchsorted(starts, first, "right") - 1
                bucket = (low[first] % np.uint64(len(keys))).astype(np.int64)
                local, last = first - starts[doc], first + count + window - 1
                own = ids[doc].tolist()
                for f, e, k, b, d, i, p in zip(first.tolist(), last.tolist(), count.tolist(), bucket.tolist(), doc.tolist(), own, local.tolist(), strict=True):
                    out.add(b, d, i, p, k, raw[open_[f] : stop[e - 1]])
            yield out.rows(c1, c2, ids, b"\n")

    return cut


def _count(window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[bytes, int] = {}
        parts, docs, base = [], [], 0
        for batch in batches:
            if batch.num_rows:
                yield passed_on(batch)
            for payload in batch.column("payload").to_pylist():
                if payload is None:
                    continue
                c1, c2, ids, doc, start, windows, blob = unpack_arrays(payload)
                words = blob.tobytes().split()
                coded = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words))
                parts.append((doc + base, start, windows, coded))
                docs.append((c1, c2, ids))
                base += len(c1)
        if not parts:
            return
        doc, start, windows, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        c1, c2, ids = (np.concatenate(x) for x in zip(*docs, strict=True))
        del parts, docs, vocabulary
        lengths = windows.astype(np.int64) + window - 1
        offsets = np.cumsum(lengths) - lengths
        group = np.repeat(np.arange(len(doc)), windows)
        step = ranges(np.zeros(len(doc), np.int64), windows.astype(np.int64))
        at = offsets[group] + step
        h = np.zeros(len(words) - window + 1, np.uint64)
        coded = mix(words.astype(np.uint64) + np.uint64(1))
        for j in range(window):
            h = h * _R + coded[j : j + len(h)]
        h = mix(h)[at]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        pair = np.flatnonzero(same)
        differ = np.zeros(len(pair), bool)
        for j in range(window):
            differ |= words[at[order[pair]] + j] != words[at[order[pair + 1]] + j]
        if differ.any():  # two sequences with one hash: sort by the words themselves
            order = np.lexsort([words[at + j] for j in reversed(range(window))])
            rows = words[at[order][:, None] + np.arange(window)]
            same = (rows[1:] == rows[:-1]).all(1)
        starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
        owner = ids[doc][group]
        least = np.minimum.reduceat(owner[order], starts)
        hit = np.zeros(len(group), bool)
        hit[order] = owner[order] > np.repeat(least, np.diff(np.append(starts, len(order))))
        yield hit_rows(hit, group, start[group] + step, c1, c2, doc)

    return count


def hits(found: DataFrame, window: int, buckets: int) -> DataFrame:
    """Per class (c1, c2) of `found` the packed hit windows of all its buckets."""
    sent = found.mapInArrow(lean(_cut(window, even_keys(found.sparkSession, buckets))), SENT)
    counted = sent.repartition(buckets, "bucket").mapInArrow(lean(_count(window)), HITS)
    return counted.groupBy("c1", "c2").agg(F.collect_list("spans").alias("spans"))


def removed(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = 24 << 20, keep_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept, the words left, joined by one space).

    A word goes where a window of `window` words that covers it also starts in a document with a smaller doc_id; all
    windows are those of the input.  Null texts have no words; a null doc_id counts as one id above all others; rows
    with one doc_id are one document for the comparison (no repeat among them is removed); a document of fewer words
    than a window keeps all; an empty table gives an empty result; other columns of docs are ignored.
    """
    # a super-k-mer carries about three times its windows' text
    buckets = max(1, math.ceil(3 * text_bytes(docs) / bucket_bytes))
    found = classes(docs)
    marked = found.join(hits(found, window, buckets), ["c1", "c2"], "left")
    schema = "c1 long, c2 int, first_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, gone, sha, kept = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                if spans:
                    mask = covered(len(words), spans, window)
                    left = b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m])
                    gone.append(int(mask.sum()))
                else:
                    left = b" ".join(words)
                    gone.append(0)
                total.append(len(words)), sha.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    kept.append(left.decode("utf-8", "surrogatepass"))
            columns = [batch.column(c) for c in ("c1", "c2", "first_id")]
            columns += [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)] + [pa.array(kept, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    by_class = marked.select("c1", "c2", "first_id", "text", "spans").mapInArrow(lean(digest), schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *class_key())
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("first_id")) & (F.col("n_words") >= window)  # wholly in the first of its class
    out = [
        F.col("doc_id"), F.col("n_words"), F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ] + [F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] * keep_text
    return rows.join(by_class, ["c1", "c2"]).select(*out)
