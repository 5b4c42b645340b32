"""Filtering by language: language ID with a reject option.

A closed set of languages always has a winner, however strange the text.  So what a text's letter n-grams are worth under
the pooled n-gram shares of all learned languages is compared with what texts of the predicted language are worth, in
units of the spread that texts of that length have.  Centre, spread and limit come from labelled texts that were held
out of the shares, and from windows cut out of them.  Shares are pooled, so a text in two learned languages is typical.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, crc_mod, cut, lean, named_back, positional, release, slices
from .language_id import BUCKETS, ORDERS, UNKNOWN, _has_letter, _histogram, _lettered, _means, drawn, train

LEAST_BYTES = 12  # shorter texts say too little to be rejected
WINDOWS = (12, 25, 50, 100, 200, 400)
_SMOOTH = 0.05  # share of the n-grams that is spread evenly


class Typical:
    """Worth of n-grams, and per language centre and spread of a text's worth by its length."""

    def __init__(self, worth: np.ndarray, languages: list[str], centre: np.ndarray, own: np.ndarray, by_length: np.ndarray, limit: float) -> None:
        self.worth, self.languages, self.centre, self.own, self.by_length, self.limit = worth, languages, centre, own, by_length, limit

    def oddness(self, data: np.ndarray, offsets: np.ndarray, lang: list[str]) -> np.ndarray:
        """How many spreads each text's worth lies below its language's centre; 0 for the shortest texts and for unknown languages."""
        n, fit = np.diff(offsets), _means(data, offsets, self.worth)[:, 0]
        at = np.array([self.languages.index(x) if x in self.languages else -1 for x in lang], np.int64)
        odd = (self.centre[at] - fit) / np.sqrt(self.own[at] + self.by_length[at] / np.maximum(n, 1))
        return np.where((n < LEAST_BYTES) | (at < 0), 0.0, odd)


def _worth(shares: np.ndarray) -> np.ndarray:
    """The logarithm of each bucket's share, times the number of buckets; shares sum to 1."""
    return np.log((1 - _SMOOTH) * shares * BUCKETS + _SMOOTH).astype(np.float32)[:, None]


def calibrated(rows: list[tuple[str, int, float]], worth: np.ndarray, tail: float = 0.9, times: float = 4.5) -> Typical:
    """From (lang, bytes, worth) of held-out texts and windows.

    Centres are medians of whole texts (the longest rows); spreads follow own + by_length / bytes; the limit is `times`
    the `tail` quantile of how odd the held-out rows are.  Both are robust: a tenth of the rows may be junk.
    """
    languages = sorted({r[0] for r in rows})
    centre, own, by_length, odd = (np.zeros(len(languages)) for _ in range(4))
    devs = []
    for k, lang in enumerate(languages):
        n = np.array([r[1] for r in rows if r[0] == lang], float)
        fit = np.array([r[2] for r in rows if r[0] == lang])
        long = n >= min(np.median(n), 400)
        centre[k] = np.median(fit[long])
        spread = lambda x: (1.4826 * np.median(np.abs(x - centre[k]))) ** 2 if len(x) else 0.0
        own[k] = max(spread(fit[long]), 1e-4)
        steps = [w * (spread(fit[n == w]) - own[k]) for w in WINDOWS if (n == w).sum() >= 8]
        by_length[k] = max([1e-3, *steps])
        devs.append((centre[k] - fit) / np.sqrt(own[k] + by_length[k] / n))
    return Typical(worth, languages, centre, own, by_length, times * max(1.0, float(np.quantile(np.concatenate(devs), tail))))


def learned(chosen: DataFrame) -> Typical | None:
    """From a bounded, stored sample (lang, text): one text in five is held out for the calibration.  None if the sample is too small for that.

    What goes to the driver are sums of shares by language and task, and three numbers a held-out text or window.
    """
    parted = chosen.select("lang", "text", (F.pmod(F.xxhash64("text", F.lit(5)), F.lit(5)) == 0).alias("held"))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in slices(batches, most_bytes=1 << 20):
            data, offsets = buffers(batch.column("text"))
            for lang, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                if b > a:
                    s = sums.setdefault(lang, [0, np.zeros(BUCKETS)])
                    s[0] += 1
                    s[1] += _histogram(data[a:b]) / len(ORDERS)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], ["lang", "n", "x"])

    total: dict[str, list] = {}
    for r in parted.where("not held").coalesce(16).mapInArrow(lean(shares), "lang string, n long, x binary").toLocalIterator():
        t = total.setdefault(r["lang"], [0, np.zeros(BUCKETS)])
        t[0] += r["n"]
        t[1] += np.frombuffer(r["x"])
    if not total:
        return None
    pooled = sum(x / n for n, x in total.values()) / len(total)
    worth = _worth(pooled / max(pooled.sum(), 1e-9))

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 20):
            langs, sizes, found = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                cuts = [(a, w) for w in WINDOWS for a in np.linspace(0, len(raw) - w, 4).astype(int) if len(raw) >= 2 * w]
                for a, w in [(0, len(raw)), *cuts]:
                    if w >= LEAST_BYTES:
                        langs.append(lang), sizes.append(w), found.append(float(_means(raw[a : a + w], np.array([0, w]), worth)[0, 0]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.float64())], ["lang", "n", "fit"])

    rows = [(r["lang"], r["n"], r["fit"]) for r in parted.where("held").mapInArrow(lean(fits), "lang string, n long, fit double").toLocalIterator()]
    rows.sort()
    many = {lang: sum(1 for r in rows if r[0] == lang) for lang in total}
    rows = [r for r in rows if many.get(r[0], 0) >= 20]
    return calibrated(rows, worth) if rows else None


def accepted(docs: DataFrame, per_lang: int = 400, most: int = 1600) -> DataFrame:
    """docs whose language could be told; the others go.  Columns are those of docs, whatever their names.

    A row goes whose text is null, has no letter, or is too odd for the language predicted: its letter n-grams are worth
    less than those of texts of that language and length by more than the limit that held-out labelled texts set (see
    calibrated()), as for noise and for languages that were not learned.  Texts under 12 bytes are not rejected for that.
    A row without a language (lang null or blank) gets the predicted one, where docs has a text column lang.  What is
    learned comes from a bounded sample (per_lang, most) of rows with a label and crc32(doc_id as text) mod 3 other than
    1; without any, only texts without a letter go.  Repeated rows are judged each; an empty table gives an empty result.
    """
    labelled = docs.where(crc_mod("doc_id", 3) != 1).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sample = drawn(labelled, per_lang, most)
    stored = cut(sample) if sample is not None else None
    model = train(stored, chosen=stored) if stored is not None else None
    typical = learned(stored) if model is not None else None
    release(stored)
    plain, at = positional(docs, "text", "lang")
    own = docs.schema["text"].dataType.simpleString() == "string"  # then it goes to the workers and back once
    plain = plain.withColumnRenamed(at["text"], "text") if own else plain.withColumn("text", F.col(at["text"]).cast("string"))
    back = lambda df: named_back(df.withColumnRenamed("text", at["text"]) if own else df, docs)
    if model is None:
        return back(plain.mapInArrow(lean(_lettered), plain.schema))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", lang_pred string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 20):
            texts = batch.column("text")
            kept = np.array([_has_letter(t) for t in texts.to_pylist()], bool)
            data, offsets = buffers(texts)
            lang, _ = model.predict(data, offsets)
            if typical is not None:
                kept &= typical.oddness(data, offsets, lang) <= typical.limit
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string())], [*batch.schema.names, "lang_pred"]).filter(pa.array(kept))

    kept = plain.mapInArrow(lean(judge), schema)
    if docs.schema["lang"].dataType.simpleString() == "string":
        lang = F.col(at["lang"])
        kept = kept.withColumn(at["lang"], F.when(F.trim(lang) != "", lang).otherwise(F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred"))))
    return back(kept)
