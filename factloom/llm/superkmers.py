"""Super-k-mers: runs of consecutive windows that share a minimiser, as one packed string in the minimiser's bucket.

Two equal windows have the same minimiser, so they meet in one bucket.  What is common to words and bytes lives here:
cutting runs, dropping local copies before the shuffle, packing, and turning hits into one row per class of texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .common import group_starts, pack_arrays, unpack_arrays

#: bucket: where a row goes; payload: packed super-k-mers; or the hits of the class (c1, c2), as pairs (start, windows).
SENT = "bucket int, payload binary, c1 long, c2 int, spans binary"
HITS = "c1 long, c2 int, spans binary"
#: Hits of many classes together, on the way to the bucket of their classes.
PACKED = "bucket int, payload binary"


def runs(minimiser: np.ndarray, valid: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of valid windows with one minimiser, cut at `longest`."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (minimiser[at[1:]] != minimiser[at[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    parts = -(-count // longest)
    if (parts > 1).any():
        step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count = np.repeat(first, parts) + step * longest, np.minimum(longest, np.repeat(count, parts) - step * longest)
    return at[first], count


class Outbox:
    """Collects the super-k-mers of a slice, sorted by document, and gives Arrow rows.

    Where a later document of the slice repeats a whole super-k-mer of an earlier one, all its windows are hits and only
    the earlier one's string is sent: hot passages are thinned out before the shuffle.
    """

    def __init__(self, keys: list[int]) -> None:
        self.keys, self.n = keys, len(keys)
        self.first: dict[bytes, int] = {}
        self.sent: dict[int, list[tuple[int, int, int, bytes]]] = defaultdict(list)
        self.hits: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, bucket: int, doc: int, doc_id: int, start: int, windows: int, string: bytes) -> None:
        least = self.first.setdefault(string, doc_id)
        if least < doc_id:
            self.hits[doc].append((start, windows))
        else:
            self.sent[bucket].append((doc, start, windows, string))

    def rows(self, c1: np.ndarray, c2: np.ndarray, ids: np.ndarray, separator: bytes) -> pa.RecordBatch:
        buckets, payloads, k1, k2, spans = [], [], [], [], []
        for bucket, found in self.sent.items():
            doc, start, windows, strings = zip(*found, strict=True)
            used, local = np.unique(np.array(doc), return_inverse=True)
            blob = np.frombuffer(separator.join(strings), np.uint8)
            payloads.append(pack_arrays(c1[used], c2[used], ids[used], local.astype(np.int32), np.array(start, np.int32), np.array(windows, np.int32), blob, level=3))
            buckets.append(self.keys[bucket]), k1.append(None), k2.append(None), spans.append(None)
        for doc, found in self.hits.items():
            buckets.append(self.keys[int(c1[doc]) % self.n]), payloads.append(None), k1.append(int(c1[doc])), k2.append(int(c2[doc]))
            spans.append(np.array(found, np.int32).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary()), pa.array(k1, pa.int64()), pa.array(k2, pa.int32()), pa.array(spans, pa.binary())],
            ["bucket", "payload", "c1", "c2", "spans"],
        )


def passed_on(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that are hits already."""
    kept = batch.filter(batch.column("payload").is_null())
    return pa.RecordBatch.from_arrays([kept.column(c) for c in ("c1", "c2", "spans")], ["c1", "c2", "spans"])


def hit_rows(hit: np.ndarray, group: np.ndarray, position: np.ndarray, c1: np.ndarray, c2: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Hit windows as rows of HITS.  hit: by window; group: the super-k-mer of each window (in order); position: in its document; doc: by super-k-mer."""
    at = np.flatnonzero(hit)
    if not len(at):
        return _hits([], [], [])
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (group[at[1:]] != group[at[:-1]])
    first = np.flatnonzero(new)
    pairs = np.stack((position[at[first]], np.diff(np.append(first, len(at)))), 1).astype(np.int32)
    owner = doc[group[at[first]]]
    order = np.argsort(owner, kind="stable")
    starts = group_starts(owner[order])
    parts = np.split(pairs[order], starts[1:])
    own = owner[order][starts]
    return _hits(c1[own], c2[own], [p.tobytes() for p in parts])


def _hits(c1, c2, spans) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int32()), pa.array(spans, pa.binary())], ["c1", "c2", "spans"])


def covered(n: int, spans: Iterable[bytes] | None, window: int) -> np.ndarray:
    """Which of n units the hit windows cover."""
    edge = np.zeros(n + 1, np.int32)
    if spans is not None and len(spans):
        pairs = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 0] + pairs[:, 1] + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def packed_hits(found: Iterator[pa.RecordBatch], keys: list[int], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of HITS packed by the bucket of their class, in bounded memory: a few rows a task, however many classes it met."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        c1, c2, spans = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("c1", "c2", "spans"))
        held.clear()
        bucket = c1 % len(keys)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for part in np.split(order, group_starts(bucket[order])[1:]):
            own = [spans[i] for i in part.tolist()]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            rows.append((keys[int(bucket[part[0]])], pack_arrays(c1[part], c2[part], lengths, np.frombuffer(b"".join(own), np.int32))))
        b, p = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.binary())], ["bucket", "payload"])

    size = 0
    for batch in found:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > most_bytes:
            yield flush()
            size = 0
    if held:
        yield flush()


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed hits of a bucket of classes as one row of HITS per class."""
    by_class: dict[tuple[int, int], list[bytes]] = defaultdict(list)
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            c1, c2, lengths, blob = unpack_arrays(payload)
            raw, at = blob.tobytes(), 0
            for a, b, k in zip(c1.tolist(), c2.tolist(), lengths.tolist(), strict=True):
                by_class[a, b].append(raw[at : at + k])
                at += k
    known = list(by_class)
    for i in range(0, len(known), 4000):
        part = known[i : i + 4000]
        yield _hits([a for a, _ in part], [b for _, b in part], [b"".join(by_class[k]) for k in part])
