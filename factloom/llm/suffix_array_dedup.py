"""Suffix-array dedup: repeated 50-byte strings by column-wise construction of collection BWTs.

1. Equal texts become one class with its smallest doc_id (superkmers.Outbox drops local copies before shuffles, too).
2. Every 50-byte string has a minimiser, its smallest 20-byte hash.  A count over all texts finds the minimisers that
   occur in two classes or more; only strings with such a minimiser can repeat.
3. Those travel as super-k-mers (runs of strings with one minimiser, as one byte string) to their minimiser's bucket.
4. In a bucket the distinct super-k-mers are the documents of a collection whose BWT is built column by column: every
   round inserts one symbol per document, right to left.  The order of the suffixes after a round is the terminators
   followed by the previous order sorted stably by BWT symbol (the LF mapping), so each round is one sequential pass
   over flat arrays, which stand for the external files of the single-machine method: a bucket is sized to memory and
   the shuffle's sorted, spilled files are Spark's.  Along with the order a round updates the common prefixes, as the
   classes of suffixes that agree up to a depth that rises by one a round and ends at the match length.
5. Each final class of equal 50-byte strings takes its smallest doc_id; later documents' strings are hits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, buffers, class_key, classes, eight_bytes, even_keys, group_starts, id_key, lean, mix, named_back, pack_arrays, positional, ranges, six_bytes, slices, sliding_min, spans_of, text_bytes, unpack_arrays
from .superkmers import HITS, PACKED, SENT, Outbox, covered, gathered, hit_rows, packed_hits, passed_on, runs

MATCH = 50
_GRAM = 20
_END = 255  # a byte that UTF-8 never has
_SLICE = 2 << 20
_BATCH = 1 << 18  # bytes of distinct super-k-mers whose BWT is built at once
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` consecutive bytes, by doubling."""
    h, have = _TABLE[data], 1
    out, done = None, 0
    while True:
        if gram & have:  # this power of two is part of the length
            if out is None:
                out, done = h, have
            else:
                n = len(h) - done
                out = out[:n] * np.uint64(0xD6E8FEB86659FD93 + 2 * have) + h[done : done + n] if n > 0 else out[:0]
                done += have
        have *= 2
        if have > gram:
            return mix(out)
        half = have // 2
        h = h[:-half] * np.uint64(0x9E3779B97F4A7C15 + 2 * have) + h[half:] if len(h) > half else h[:0]


def minimisers(data: np.ndarray, lengths: np.ndarray, match: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser of the string at every byte, and whether that string lies within one text."""
    if len(data) < match:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    low = sliding_min(gram_hashes(data, gram) >> np.uint64(16), match - gram + 1)  # 48 bits: six bytes each on the way
    valid = np.zeros(len(low), bool)
    valid[ranges(np.cumsum(lengths) - lengths, np.maximum(lengths - match + 1, 0))] = True
    return low, valid


def _by_id(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pa.array(np.argsort(batch.column("first_id").to_numpy(zero_copy_only=False), kind="stable")))


def _anchors(match: int, gram: int, keys: list[int]):
    """Distinct minimisers of each class, packed by bucket.  What two classes of a slice share is answered at once and sent once."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.uint64(len(keys))
        for batch in slices(batches, most_bytes=_SLICE):
            data, offsets = buffers(batch.column("text"))
            c1, c2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("c1", "c2"))
            low, valid = minimisers(data, np.diff(offsets), match, gram)
            first, _ = runs(low, valid, 1 << 40)
            value, doc = low[first], (np.searchsorted(offsets, first, "right") - 1).astype(np.int32)
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
            value, doc = value[new], doc[new]
            starts = group_starts(value)
            size = np.diff(np.append(starts, len(value)))
            shared = size > 1
            known = np.repeat(shared, size)
            rows = []
            own = np.argsort(doc[known], kind="stable")
            answered, whose = value[known][own], doc[known][own]
            for part in np.split(np.arange(len(own)), group_starts(whose)[1:]) if len(own) else ():
                c = whose[part[0]]
                rows.append((keys[int(c1[c]) % len(keys)], None, int(c1[c]), int(c2[c]), answered[part].tobytes()))
            bucket = (value[starts] % n).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, group_starts(bucket[order])[1:]) if len(order) else ():
                at = starts[part]
                used, local = np.unique(doc[at], return_inverse=True)
                packed = pack_arrays(c1[used], c2[used], local.astype(np.uint16 if len(used) < 65536 else np.int32), six_bytes(value[at]), shared[part])
                rows.append((keys[int(bucket[part[0]])], packed, None, None, None))
            if rows:
                kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "payload", "c1", "c2", "shared"])

    return anchors


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class the minimisers of this bucket that another class has, too."""
    parts, tables, base = [], [], 0
    for batch in batches:
        kept = batch.filter(batch.column("payload").is_null())
        if kept.num_rows:
            yield _by_class_rows(kept.column("c1"), kept.column("c2"), kept.column("shared"))
        for payload in batch.column("payload").to_pylist():
            if payload is not None:
                c1, c2, local, value, shared = unpack_arrays(payload)
                parts.append((local.astype(np.int32) + base, eight_bytes(value), shared))
                tables.append((c1, c2))
                base += len(c1)
    if not parts:
        return
    doc, value, shared = (np.concatenate(x) for x in zip(*parts, strict=True))
    c1, c2 = (np.concatenate(x) for x in zip(*tables, strict=True))
    order = np.argsort(value, kind="stable")
    value, doc, shared = value[order], doc[order], shared[order]
    owner = c1[doc]
    starts = group_starts(value)
    size = np.diff(np.append(starts, len(value)))
    many = np.logical_or.reduceat(shared, starts) | (np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts))
    keep = np.repeat(many, size)
    value, doc, owner = value[keep], doc[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    value, doc, owner = value[order], doc[order], owner[order]
    starts = group_starts(owner)
    if len(starts):
        packed = [p.tobytes() for p in np.split(value, starts[1:])]
        yield _by_class_rows(pa.array(owner[starts], pa.int64()), pa.array(c2[doc[starts]], pa.int32()), pa.array(packed, pa.binary()))


def _by_class_rows(c1: pa.Array, c2: pa.Array, spans: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c1, c2, spans], ["c1", "c2", "spans"])


def _cut(match: int, gram: int, keys: list[int]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=_SLICE):
            batch = _by_id(batch)
            data, offsets = buffers(batch.column("text"))
            lengths = np.diff(offsets)
            c1, c2, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("c1", "c2", "first_id"))
            low, valid = minimisers(data, lengths, match, gram)
            out = Outbox(keys)
            first, count = runs(low, valid, match - gram + 1)
            if len(first):
                doc = np.searchsorted(offsets, first, "right") - 1
                value = low[first]
                wanted = [np.frombuffer(b"".join(x), np.uint64) for x in batch.column("shared").to_pylist()]
                # a pair (class in the slice, minimiser) as one number; a chance equality only sends more
                pair = np.sort(np.concatenate([mix(w + np.uint64(d)) for d, w in enumerate(wanted)]))
                mine = mix(value + doc.astype(np.uint64))
                at = np.minimum(np.searchsorted(pair, mine), len(pair) - 1)
                keep = pair[at] == mine if len(pair) else np.zeros(len(first), bool)
                first, count, doc, value = first[keep], count[keep], doc[keep], value[keep]
                bucket = (value % np.uint64(len(keys))).astype(np.int64)
                raw = data.tobytes()
                for f, k, d, b, p, i in zip(first.tolist(), count.tolist(), doc.tolist(), bucket.tolist(), (first - offsets[doc]).tolist(), ids[doc].tolist(), strict=True):
                    out.add(b, d, i, p, k, raw[f : f + k + match - 1])
            yield out.rows(c1, c2, ids, b"")

    return cut


def equal_windows(text: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Column-wise collection BWT with common prefixes.

    text: the strings one after another, each with the symbol _END before it; lengths: without that symbol.  Returns
    where the suffixes of at least `depth` symbols begin, in suffix order, and the class of each: equal for suffixes
    that agree in `depth` symbols.
    """
    ends = np.cumsum(lengths + 1).astype(np.int32)
    n, rounds, shortest = len(lengths), int(lengths.max()), int(lengths.min())
    last = ends - 1
    left = last  # of each suffix in order: the place of the symbol before it, to be inserted next
    group = None  # of each suffix in order: its class; None while all are alike
    for j in range(1, rounds + 1):
        symbol = text[left]
        order = np.argsort(symbol, kind="stable")  # the LF mapping; _END sorts last
        symbol = symbol[order]
        if j > shortest:  # some strings are complete
            going = int(np.searchsorted(symbol, _END))
            order, symbol = order[:going], symbol[:going]
        if rounds - j < depth:  # from here on classes are wanted; a terminator is like no other
            new = np.empty(n + len(order), bool)
            new[: n + 1] = True
            tail = new[n + 1 :]
            np.not_equal(symbol[1:], symbol[:-1], out=tail)
            if group is not None:
                was = group[order]
                tail |= was[1:] != was[:-1]
            group = np.cumsum(new, dtype=np.int32)
        longer = np.empty(n + len(order), np.int32)
        longer[:n] = last
        np.subtract(left[order], 1, out=longer[n:])
        left = longer
    at, group = left[n:] + 1, group[n:]  # without the terminators
    long = ends[np.searchsorted(ends, at, "right")] - at >= depth
    return at[long], group[long]


def _find(match: int, keys: list[int]):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed_hits(find(batches), keys)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs, base = [], [], 0
        distinct: dict[bytes, int] = {}
        for batch in batches:
            if batch.num_rows:
                yield passed_on(batch)
            for payload in batch.column("payload").to_pylist():
                if payload is None:
                    continue
                c1, c2, ids, doc, start, windows, blob = unpack_arrays(payload)
                raw, at, which = blob.tobytes(), 0, []
                for k in windows.tolist():
                    which.append(distinct.setdefault(raw[at : at + k + match - 1], len(distinct)))
                    at += k + match - 1
                parts.append((doc + base, start, np.array(which, np.int32)))
                docs.append((c1, c2, ids))
                base += len(c1)
        if not parts:
            return
        doc, start, which = (np.concatenate(x) for x in zip(*parts, strict=True))
        c1, c2, ids = (np.concatenate(x) for x in zip(*docs, strict=True))
        del parts, docs
        strings = list(distinct)
        del distinct
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        windows = lengths - match + 1
        owner = ids[doc]
        first = np.full(len(strings), NO_ID, np.int64)  # smallest doc_id that has the string
        np.minimum.at(first, which, owner)
        offsets = np.cumsum(windows) - windows
        least = np.repeat(first, windows)  # smallest doc_id that has the window, by distinct string
        # strings that share a minimiser have it in common: its value orders them into batches of whole groups
        value = _string_minimisers(strings, lengths, match)
        order = np.argsort(value, kind="stable")
        starts = group_starts(value[order])
        size = np.diff(np.append(starts, len(order)))
        order = order[np.repeat(size > 1, size)]  # alone with its minimiser: its windows are in no other string
        if len(order):
            begin = group_starts(value[order])
            load = np.cumsum(np.add.reduceat(lengths[order], begin)) // _BATCH
            for part in np.split(order, begin[1:][load[1:] != load[:-1]]):
                text = np.frombuffer(b"".join(b"\xff" + strings[i] for i in part.tolist()), np.uint8)
                at, group = equal_windows(text, lengths[part], match)
                heads = np.cumsum(lengths[part] + 1) - lengths[part]
                string = np.searchsorted(heads, at, "right") - 1
                window = offsets[part[string]] + at - heads[string]
                edge = group_starts(group)
                low = np.minimum.reduceat(least[window], edge)
                least[window] = np.repeat(low, np.diff(np.append(edge, len(group))))
        for some in _batches(windows[which]):  # in bounded memory
            k = windows[which[some]]
            group = np.repeat(np.arange(len(k)), k)
            step = ranges(np.zeros(len(k), np.int64), k)
            hit = least[offsets[which[some]][group] + step] < owner[some][group]
            yield hit_rows(hit, group, start[some][group] + step, c1, c2, doc[some])

    return send


def _string_minimisers(strings: list[bytes], lengths: np.ndarray, match: int) -> np.ndarray:
    """The minimiser that all windows of a string have in common, by string; hashes take some 40 bytes a byte of text, so a batch of strings at a time."""
    out = np.empty(len(strings), np.uint64)
    for part in _batches(lengths):
        data = np.frombuffer(b"".join(strings[part]), np.uint8)
        low, _ = minimisers(data, lengths[part], match, min(_GRAM, match))
        out[part] = low[np.cumsum(lengths[part]) - lengths[part]]
    return out


def _batches(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of consecutive items whose sizes add up to about _BATCH."""
    edges = [*group_starts((np.cumsum(sizes) - 1) // _BATCH).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):  # noqa: B905 - one longer
        yield slice(a, b)


def hits(found: DataFrame, match: int, buckets: int) -> DataFrame:
    """Per class (c1, c2) of `found` the packed hit strings of all its buckets, as (first byte, count).

    All three readers of `found` take all its columns, so its texts are shuffled once.
    """
    keys, gram = even_keys(found.sparkSession, buckets), min(_GRAM, match)
    texts = found.select("c1", "c2", "first_id", "text").mapInArrow(lean(_anchors(match, gram, keys)), "bucket int, payload binary, c1 long, c2 int, shared binary")
    counted = texts.repartition(buckets, "bucket").mapInArrow(lean(lambda batches: packed_hits(_shared(batches), keys)), PACKED)
    shared = counted.repartition(buckets, "bucket").mapInArrow(lean(gathered), HITS).select("c1", "c2", F.array("spans").alias("shared"))
    sent = found.join(shared, ["c1", "c2"]).mapInArrow(lean(_cut(match, gram, keys)), SENT)
    found = sent.repartition(buckets, "bucket").mapInArrow(lean(_find(match, keys)), PACKED)
    return found.repartition(buckets, "bucket").mapInArrow(lean(gathered), HITS).select("c1", "c2", F.array("spans").alias("spans"))


def _by_class(docs: DataFrame, match: int, bucket_bytes: int, keep_text: bool) -> DataFrame:
    """Per class of equal texts: its key, first_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept) in its first document."""
    buckets = max(1, math.ceil(text_bytes(docs) / bucket_bytes))
    found = classes(docs)
    marked = found.join(hits(found, match, buckets), ["c1", "c2"], "left")
    schema = "c1 long, c2 int, first_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, gone, many, sha, kept = [], [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                total.append(len(raw))
                if spans:
                    mask = covered(len(raw), spans, match)
                    many.append(len(spans_of(mask)[0])), gone.append(int(mask.sum()))
                    raw = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                else:
                    many.append(0), gone.append(0)
                sha.append(hashlib.sha256(raw).hexdigest())
                if keep_text:
                    kept.append(raw.decode("utf-8", "ignore"))
            columns = [batch.column(c) for c in ("c1", "c2", "first_id")] + [pa.array(x, pa.int64()) for x in (total, gone, many)]
            columns += [pa.array(sha)] + [pa.array(kept, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return marked.select("c1", "c2", "first_id", "text", "spans").mapInArrow(lean(digest), schema)


def removed(docs: DataFrame, match: int = MATCH, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    A byte of the UTF-8 text goes where a string of `match` bytes that covers it also starts in a document with a
    smaller doc_id; strings are those of the input and never cross documents.  A null text is empty; a null doc_id
    counts as one id above all others; rows with one doc_id are one document for the comparison; a shorter text keeps
    all; an empty table gives an empty result; other columns are ignored.
    """
    by_class = _by_class(docs, match, bucket_bytes, False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *class_key())
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("first_id")) & (F.col("n_bytes") >= match)  # wholly in the first of its class
    return rows.join(by_class, ["c1", "c2"]).select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame, match: int = MATCH, bucket_bytes: int = 16 << 20) -> DataFrame:
    """docs with repeated strings cut out of their texts; documents of which nothing but white space is left go.

    Columns are those of docs, whatever their names.  n_chars, where there is one, follows the text.  A character of
    which only some bytes stay is left out.  Documents that lose nothing stay as they are, null and blank ones and
    repeated rows with one doc_id included.
    """
    by_class = _by_class(docs, match, bucket_bytes, True).select("c1", "c2", "first_id", "n_bytes", "n_removed", "kept")
    plain, at = positional(docs, "doc_id", "text", "n_chars")
    text = F.col(at["text"])
    rows = plain.withColumn("id", id_key(at["doc_id"])).select("*", text.isNull().alias("none"), *class_key(at["text"])).drop(at["text"])
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_bytes") >= match)
    left = F.when(F.col("none"), F.lit(None).cast("string")).when(copy, F.lit("")).otherwise(F.col("kept"))
    joined = rows.join(by_class, ["c1", "c2"]).withColumn("left", left).withColumn("less", copy | (F.col("n_removed") > 0))
    joined = joined.where(~F.col("less") | (F.trim(F.regexp_replace("left", r"\s+", " ")) != ""))
    joined = joined.withColumn(at["text"], F.col("left").cast(docs.schema["text"].dataType))
    if "n_chars" in at and isinstance(docs.schema["n_chars"].dataType, T.IntegralType):
        size = F.length("left").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn(at["n_chars"], F.when(F.col("less"), size).otherwise(F.col(at["n_chars"])))
    return named_back(joined, docs)
