"""Language ID by hierarchical discrimination.

A softmax over hashed letter n-grams predicts the language family; within the family, one-versus-one linear support
vector machines separate the related languages.  All classifiers are linear in the mean of n-gram indicators over the
text, so a text is scored by one table lookup per n-gram, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, crc_mod, lean, mix, slices

UNKNOWN = "und"
# Language families by ISO 639-1 code; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt"),
    "austronesian": ("id", "jv", "mg", "ms", "su", "tl"),
}
BUCKETS = 1 << 13
ORDERS = (1, 2, 3, 4)
#: ASCII letters lower-cased, bytes above 127 kept, all else a space.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)
_MIXED = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.split("-")[0].lower() in members), lang)


def gram_buckets(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order n the bucket of the n-gram that ends at every byte from the n-th on."""
    h = b = _MIXED[_FOLD[data]]
    for n in ORDERS:
        if n > 1:
            h = h[:-1] * np.uint32(0x9E3779B1) + b[n - 1 :]
        x = h ^ (h >> np.uint32(15))
        yield n, ((x * np.uint32(0x85EBCA6B)) >> np.uint32(19)).astype(np.int32)


def _means(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over the orders of the mean weight row of each text's n-grams; 0 for an order that a text is too short for."""
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), weights.shape[1]))
    for n, bucket in gram_buckets(data) if len(data) >= max(ORDERS) else _padded(data, offsets):
        number = np.maximum(lengths - n + 1, 0)
        whole = np.flatnonzero(number)
        for k in range(weights.shape[1]):
            total = np.zeros(len(bucket) + 1)
            np.cumsum(weights[:, k][bucket], dtype=np.float64, out=total[1:])
            start = offsets[:-1][whole]
            out[whole, k] += (total[start + number[whole]] - total[start]) / number[whole]
    return out


def _padded(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for n, bucket in gram_buckets(np.concatenate((data, np.full(max(ORDERS), 32, np.uint8)))):
        yield n, bucket


def _histogram(data: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for n, bucket in gram_buckets(data) if len(data) >= max(ORDERS) else _padded(data, None):
        k = max(0, len(data) - n + 1)
        if k:
            out += np.bincount(bucket[:k], minlength=BUCKETS) / k
    return out


class Model:
    """Families, languages and the weights of all linear parts, one column each."""

    def __init__(self, families: list[str], languages: list[str], pairs: list[tuple[int, int]], weights: np.ndarray, bias: np.ndarray) -> None:
        self.families, self.languages, self.pairs, self.weights, self.bias = families, languages, pairs, weights, bias
        self.of = np.array([families.index(family(x)) for x in languages])

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        z = _means(data, offsets, self.weights) + self.bias
        nf = len(self.families)
        e = np.exp(z[:, :nf] - z[:, :nf].max(1, keepdims=True))
        pf = e / e.sum(1, keepdims=True)
        best = pf.argmax(1)
        votes, soft, met = (np.zeros((len(z), len(self.languages))) for _ in range(3))
        for k, (a, b) in enumerate(self.pairs):
            margin = np.clip(z[:, nf + k], -30, 30)
            p = 1 / (1 + np.exp(-2 * margin))
            votes[:, a] += margin > 0
            votes[:, b] += margin <= 0
            for c, q in ((a, p), (b, 1 - p)):
                soft[:, c] += q
                met[:, c] += 1
        within = np.where(met > 0, soft / np.maximum(met, 1), 1.0)
        rank = np.where(self.of[None] == best[:, None], votes + within * 0.5, -1.0)
        lang = rank.argmax(1)
        rows = np.arange(len(z))
        return [self.languages[i] for i in lang], np.clip(pf[rows, best] * within[rows, lang], 0, 1)


def _softmax(k: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by gradient descent; k: inner products of the rows.  Returns each row's share in the weights, and the bias."""
    a, b, va, vb = np.zeros((len(k), classes), np.float32), np.zeros(classes, np.float32), 0.0, 0.0
    target = np.eye(classes, dtype=np.float32)[y]
    per = (len(y) / (classes * np.maximum(np.bincount(y, minlength=classes), 1))).astype(np.float32)[y][:, None]  # families weigh alike
    for _ in range(rounds):
        z = k @ a + b
        e = np.exp(z - z.max(1, keepdims=True))
        g = (e / e.sum(1, keepdims=True) - target) * per / len(y)
        va, vb = 0.9 * va - rate * (g + decay * a), 0.9 * vb - rate * g.sum(0)
        a, b = a + va, b + vb
    return a, b


def _svm(k: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear support vector machine by subgradient descent on the hinge loss; y is 1 or -1.  Returns as _softmax."""
    a, b, va, vb = np.zeros(len(k), np.float32), 0.0, 0.0, 0.0
    per = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))).astype(np.float32)
    for _ in range(rounds):
        g = np.where(y * (k @ a + b) < 1, -y * per, 0).astype(np.float32) / len(y)
        va, vb = 0.9 * va - rate * (g + decay * a), 0.9 * vb - rate * g.sum()
        a, b = a + va, b + vb
    return a, float(b)


def drawn(labelled: DataFrame, per_lang: int, most: int) -> DataFrame | None:
    """(lang, text): of the distinct texts of each language those of the smallest hashes, at most per_lang, and at most `most` of all.

    Copies count once, so a text that a third of all rows hold takes one place.  None without a labelled row.
    """
    labelled = labelled.where("lang is not null and text is not null and trim(lang) <> ''").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return None
    share = max(1, min(per_lang, most // len(counts)))
    wide = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.2 * share + 100) / n))])  # a language at most once
    few = labelled.where(F.shiftrightunsigned("h", 2) <= wide[F.col("lang")] * 2.0**62)
    once = few.groupBy("lang", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 2), "h"))  # over some 1.2 share rows a language
    return once.withColumn("rank", rank).where(F.col("rank") <= share).select("lang", "text")


def train(labelled: DataFrame, per_lang: int = 400, most: int = 1600, chosen: DataFrame | None = None) -> Model | None:
    """A model from rows (lang, text); of each language at most per_lang distinct texts, and `most` in all, or from a drawn sample `chosen`.

    The sample is the only bound; its n-gram histograms are made by the executors.  None without a labelled row.
    """
    chosen = drawn(labelled, per_lang, most) if chosen is None else chosen
    if chosen is None:
        return None

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 20):
            data, offsets = buffers(batch.column("text"))
            packed = [_histogram(data[a:b]).astype(np.float16).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(packed, pa.binary())], ["lang", "x"])

    rows = chosen.mapInArrow(lean(histograms), "lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    names = sorted({r["lang"] for r in rows})
    lang = np.array([names.index(r["lang"]) for r in rows])
    x = np.empty((len(rows), BUCKETS), np.float32)
    while rows:  # one copy at a time
        i = len(rows) - 1
        x[i] = np.frombuffer(rows.pop()["x"], np.float16)
    mean, spread = x.mean(0), np.concatenate([part.std(0) for part in np.split(x, 16, 1)]) + 1e-4
    x -= mean
    x /= spread * np.sqrt(BUCKETS)
    families = sorted({family(n) for n in names})
    of = np.array([families.index(family(n)) for n in names])
    products = x @ x.T  # there are fewer rows than n-grams, so descent goes by the rows
    a, b = _softmax(products, of[lang], len(families))
    columns, bias = [*(x.T @ a).T], [*b]
    pairs = [(i, j) for i, j in combinations(range(len(names)), 2) if of[i] == of[j]]
    for i, j in pairs:
        own = np.flatnonzero((lang == i) | (lang == j))
        a1, b1 = _svm(products[np.ix_(own, own)], np.where(lang[own] == i, 1.0, -1.0).astype(np.float32))
        columns.append(x[own].T @ a1), bias.append(b1)
    weights = np.stack(columns, 1) / (spread * np.sqrt(BUCKETS))[:, None]
    return Model(families, names, pairs, weights.astype(np.float32), np.array(bias) - mean @ weights)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most_bytes=1 << 20):
        yield batch.filter(pa.array([_has_letter(t) for t in batch.column("text").to_pylist()], pa.bool_()))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score.  `und`, score 0, where the text is null or has no letter, or no model could be learned."""
    extra = [n for n in docs.columns if n not in ("lang_pred", "score")]
    docs = docs.select(*extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 20):
            texts = batch.column("text")
            letters = [_has_letter(t) for t in texts.to_pylist()]
            lang, p = [UNKNOWN] * len(letters), np.zeros(len(letters))
            if model is not None:
                data, offsets = buffers(texts)
                found, q = model.predict(data, offsets)
                lang = [f if ok else UNKNOWN for f, ok in zip(found, letters, strict=True)]
                p = np.where(letters, q, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(p)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lean(score), schema)


def identified(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred and score.

    Learns from rows whose crc32(doc_id as text) mod 3 is not 1 and whose lang is not null; predicts from the text
    alone.  Repeated rows are predicted each; an empty table gives an empty result; a null doc_id counts as ''.
    """
    held = crc_mod("doc_id", 3) == 1
    model = train(docs.where(~held).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model).drop("text")
