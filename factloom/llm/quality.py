"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors for its words, the character n-grams of its words and its word pairs, all
hashed into one table; a softmax over that average gives the label.  Table and output layer are trained together by
stochastic gradient descent in numpy.  Since the output is linear in the average, each table row counts for one number
when documents are scored.  Features are hashed for a whole slice of texts at a time, whatever their words' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, lean, mix, named_back, positional, slices, word_hashes

BITS = 16
#: After the hashed rows: a document without words, and a word that follows itself.
EMPTY, SAME = 1 << BITS, (1 << BITS) + 1
ROWS = (1 << BITS) + 2
SIZES = 4  # character n-grams of 1 to 4
_M, _F = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, a space before and after each, and where each text (with the space before it) begins."""
    whole = [f" {t}" if t else " " for t in texts]
    starts = np.cumsum([0, *map(len, whole)])
    return np.frombuffer("".join([*whole, " "]).encode("utf-32-le", "surrogatepass"), "<u4"), starts


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the table, weight 0 or 1, bounds) for every kind of feature; bounds: where the features of each text begin, and the end."""
    code, starts = _code_points(texts)
    space = (code == 32) | (code >= 9) & (code <= 13)
    symbol = np.where(space, np.uint32(32), code) * _M
    symbol ^= symbol >> np.uint32(15)
    last = len(code) - 1  # the closing space is part of the last text's n-grams only
    h, inner = symbol, None
    for n in range(1, SIZES + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        if n > 1:
            h = h[:size] * _M + symbol[n - 1 :]
        if n == 2:
            ok = ~(space[:size] & space[1:])
        elif n == 1:
            ok = ~space
        else:  # a space, which marks a word's end, may only be the first or the last character
            word = ~space[1 : 1 + size]
            inner = word if inner is None else inner[:size] & ~space[n - 2 : n - 2 + size]
            ok = inner
        x = h ^ (h >> np.uint32(15))
        bucket = ((x * _F) >> np.uint32(32 - BITS)).astype(np.int32)
        yield bucket, ok.astype(np.float32), np.minimum(starts, min(size, last))
    first, end = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))), np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    h = word_hashes(mix(symbol.astype(np.uint64)), first, end)
    bounds = np.searchsorted(first, starts)
    yield (h >> np.uint64(64 - BITS)).astype(np.int32), np.ones(len(h), np.float32), bounds
    a, b = h[:-1], h[1:]
    pair = np.where(a == b, SAME, (mix(a * np.uint64(0x9E3779B97F4A7C15) + b) >> np.uint64(64 - BITS)).astype(np.int32))
    within = np.ones(len(pair), np.float32)
    cross = bounds[1:-1]
    within[cross[(cross > 0) & (cross < len(h))] - 1] = 0  # the last word of a text and the first of the next
    yield pair, within, np.minimum(bounds, len(pair))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each text's values; it depends on these values alone."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[: bounds[-1]], bounds[full])
    return out


def log_odds(texts: list[str | None], adds: np.ndarray) -> np.ndarray:
    """The average of what the features of each text add; EMPTY's for a text without words."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, ok, bounds in features(texts):
        total += _sums(adds[bucket] * ok, bounds)
        count += _sums(ok, bounds)
    return np.where(count > 0, total / np.maximum(count, 1), adds[EMPTY])


def histogram(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of a document and the share of each in its average."""
    found = [bucket[: bounds[-1]][ok[: bounds[-1]] > 0] for bucket, ok, bounds in features([text])]
    bucket, count = np.unique(np.concatenate(found), return_counts=True)
    if not len(bucket):
        return np.array([EMPTY], np.int32), np.ones(1, np.float32)
    return bucket.astype(np.int32), (count / count.sum()).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int = 8, epochs: int = 12, rate: float = 2.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Table and output layer by stochastic gradient descent; returns what each table row adds to the log odds of label 1, and the bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / size, 1 / size, (ROWS, size)).astype(np.float32)
    out = np.zeros((size, 2), np.float32)
    share = float(np.mean([y for *_, y in rows]))
    bias = np.log(np.clip(np.array([1 - share, share]), 1e-3, 1)).astype(np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            bucket, weight, y = rows[i]
            now = rate * (1 - step / steps)
            step += 1
            x = weight @ table[bucket]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= now * np.outer(x, p)
            bias -= 0.1 * now * p
            table[bucket] -= (now * len(bucket) ** 0.5) * weight[:, None] * back
    return table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, most: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Histograms and labels of at most `most` labelled documents with crc32(doc_id as text) mod 5 not 0: those of the smallest hashes.

    A doc_id has one label, the largest, and one text, that of the smallest hash; equal texts with one label count once.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.col("quality").cast("int")) > 0).cast("int").alias("y"))
    n = marked.count()
    if not n:
        return []
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 2)
    drawn = marked.where(draw <= min(1.0, 1.2 * most / n) * 2.0**62).orderBy(draw, "doc_id").limit(most)  # a top-k: at most `most` ids, broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = texts.join(F.broadcast(drawn), "doc_id").withColumn("h", F.xxhash64("text"))
    one = own.groupBy("doc_id", "y").agg(F.min("h").alias("h"), F.min_by("text", "h").alias("text"))  # at most `most` rows from here on
    one = one.groupBy("h", "y").agg(F.first("text").alias("text"))

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            b, w = zip(*map(histogram, batch.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array([x.tobytes() for x in b], pa.binary()), pa.array([x.tobytes() for x in w], pa.binary())], ["h", "y", "b", "w"])

    rows = one.select("h", "y", "text").mapInArrow(lean(histograms), "h long, y int, b binary, w binary").collect()
    rows = sorted((r["h"], r["y"], bytes(r["b"]), bytes(r["w"])) for r in rows)
    return [(np.frombuffer(b, np.int32), np.frombuffer(w, np.float32), y) for _, y, b, w in rows]


def _scores(docs: DataFrame, labels: DataFrame, plain: DataFrame, most: int, threshold: float) -> DataFrame:
    """plain, which has a column text, with score and predicted in that column's place."""
    rows = sample(docs, labels, most)
    share = float(np.mean([y for *_, y in rows])) if rows else 0.5
    if len({y for *_, y in rows}) == 2:
        adds, bias = train(rows)
    else:
        adds, bias = None, 0.0
    kept = [c for c in plain.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 20):
            if adds is None:
                p = np.full(batch.num_rows, share)
            else:
                p = 1 / (1 + np.exp(-np.clip(log_odds(batch.column("text").to_pylist(), adds) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "text") + ", score double, predicted int"
    return plain.mapInArrow(lean(score), schema)


def scored(docs: DataFrame, labels: DataFrame, most: int = 4000, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (the probability of label 1) and predicted.

    Learns from at most `most` labelled documents (the bound of the sample) with crc32(doc_id as text) mod 5 not 0.
    Null and blank texts are scored, too; with labels of one value alone the score is that value's share (0 or 1), and
    0.5 without any; repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return _scores(docs, labels, plain, most, threshold)


def good(docs: DataFrame, labels: DataFrame, most: int = 4000, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that are predicted 1, each by its own text; columns are those of docs, whatever their names."""
    plain, at = positional(docs, "text")
    plain = plain.withColumn("text", F.col(at["text"]).cast("string"))
    return named_back(_scores(docs, labels, plain, most, threshold).where("predicted = 1"), docs)
