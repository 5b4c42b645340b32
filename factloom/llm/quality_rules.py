"""Quality rules, with DataFrame functions alone: base rules on counts, and a log-likelihood ratio of hashed n-grams.

1. Words and pairs of words are hashed into a fixed number of buckets.  One pass over the corpus counts them, for all
   documents and for the trusted ones (labelled good and not toxic), each as a multinomial over the buckets.
2. A bucket weighs the logarithm of its probability among the trusted documents over that in the raw corpus; the former
   is shrunk towards the latter, so what was hardly seen weighs next to nothing.
3. A document's score is the mean weight of its n-grams, so length does not count.  The threshold is a low percentile of
   the scores of trusted documents that were held out of the counts: it is computed once, exactly, and the same for all.

The weights are one row of fixed size, which goes to every task; each document is scored within its row, so nothing but
the counts by bucket is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, named_back, positional, release

BUCKETS = 1 << 16
MIN_WORDS = 50
_SYMBOLS = "[#*$%&|<>]"


def _pieces(text: Column) -> Column:
    """text cut at every single space character: its words, and an empty string where two of these meet."""
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.split(text, " ")  # by one plain character no pattern is run


def _after(array: Column) -> Column:
    """The array without its first element."""
    return F.slice(array, 2, F.greatest(F.size(array), F.lit(1)))


def _next(array: str, f: Callable[[Column, Column], Column]) -> Column:
    """f of all neighbours in the array."""
    return F.zip_with(F.slice(array, 1, F.greatest(F.size(array) - 1, F.lit(0))), _after(F.col(array)), f)


def _grams() -> dict[str, Column]:
    """The hashes of all words and of all pairs of neighbours."""
    return {"_one": F.transform("words", lambda w: F.xxhash64(w)), "_two": _next("words", lambda x, y: F.xxhash64(x, y))}


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)) if buckets & (buckets - 1) else h.bitwiseAND(F.lit(buckets - 1))  # the same for powers of two


def _settled(df: DataFrame, *columns: str) -> DataFrame:
    """df, whose filters on these columns stay above it: pushed below they would compute the columns again, once for each use in them."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*columns))))


def _repeated(rows: DataFrame) -> DataFrame:
    """rows (with _two) and n_repeat_words; a window of three words is known by the hashes of its two pairs.

    Only where a hash of 64 bits comes twice the hashes are sorted, with the places of their windows as lower half.
    Neighbours of equal upper half are candidates, and only these are compared by both pairs.
    """
    low = (1 << 31) - 1  # an array has fewer places
    rows = rows.withColumn("_keys", _next("_two", lambda x, y: F.xxhash64(x, y)))
    placed = F.transform("_keys", lambda x, i: x.bitwiseAND(F.lit(-1 - low)).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_keys")) < F.size("_keys"), F.sort_array(placed))).drop("_keys")
    places = lambda pairs: F.array_distinct(F.flatten(F.array_compact(pairs)))
    alike = _next("_sorted", lambda x, y: F.when(F.shiftright(x.bitwiseXOR(y), 31) == 0, F.array(x.bitwiseAND(F.lit(low)), y.bitwiseAND(F.lit(low)))))
    pairs = F.transform(places(alike), lambda i: F.struct(F.col("_two")[i].alias("a"), F.col("_two")[i + 1].alias("b"), i.alias("i")))
    rows = rows.withColumn("_sorted", F.sort_array(pairs))
    rows = rows.withColumn("_at", F.sort_array(places(_next("_sorted", lambda x, y: F.when((x["a"] == y["a"]) & (x["b"] == y["b"]), F.array(x["i"], y["i"])))))).drop("_sorted")
    covered = F.aggregate(F.zip_with("_at", _after(F.col("_at")), lambda x, y: F.coalesce(F.least(y - x, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with words (array), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text is empty.

    Windows of three words are compared by 128 bits within their document.  _one and _two: the hashes of words and pairs.
    """
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumns({"_plain": plain, "_lines": lines, "_pieces": _pieces(plain)})
    without = F.length(F.regexp_replace("_plain", _SYMBOLS, ""))
    rows = rows.withColumns(
        {
            "words": F.array_remove("_pieces", ""),
            "word_chars": (F.length("_plain") - F.size("_pieces") + 1).cast("long"),  # all but the space characters
            "n_symbols": F.when(F.col("_plain").rlike(_SYMBOLS), F.length("_plain") - without).otherwise(0).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_plain", "_lines", "_pieces")
    rows = _repeated(rows.withColumns({"n_words": F.size("words").cast("long"), **_grams()}))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return _settled(rows, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_one", "_two")


def trusted(labels: DataFrame, most: int | None = None) -> DataFrame:
    """(id, held_out) of all documents labelled good and not toxic in every label they have; of about `most` of them, drawn by a hash, if given.

    One in five is held out.
    """
    each = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic"))
    chosen = each.where("quality = 1 and toxic = 0").withColumn("h", F.xxhash64(F.lit(77), "id"))
    if most is not None:
        share = min(1.0, most / max(1, chosen.count()))
        chosen = chosen.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    return chosen.select("id", (F.pmod(F.shiftright("h", 20), F.lit(5)) == 0).alias("held_out"))


def _small(ids: DataFrame, most: int = 4_000_000) -> DataFrame:
    """ids, to be broadcast while they are few, so that no text is shuffled for them."""
    return F.broadcast(ids) if ids.count() <= most else ids


def weights(docs: DataFrame, chosen: DataFrame, buckets: int = BUCKETS, shrink: float = 1.0) -> DataFrame | None:
    """One row (weights): for each bucket the logarithm of its probability in the chosen documents over that in all docs.

    Of the chosen ones those held out do not count as trusted.  shrink: how many n-grams a bucket is worth of the raw
    corpus' evidence.  None where no trusted n-gram is found.
    """
    words = F.array_remove(_pieces(F.coalesce(F.col("text").cast("string"), F.lit(""))), "")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), words.alias("words"))
    rows = _settled(rows.select("id", F.concat(*_grams().values()).alias("grams")), "grams")  # what is exploded is filtered, too
    target = F.coalesce((~F.col("held_out")).cast("int"), F.lit(0))
    grams = rows.join(_small(chosen), "id", "left").select(target.alias("good"), F.explode("grams").alias("h"))
    counts = cut(grams.groupBy(_bucket(F.col("h"), buckets).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")))  # a row a bucket at most
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    if not total["good"]:
        release(counts)
        return None
    p, prior = F.col("raw") / total["raw"], shrink * buckets
    weight = F.log((F.col("good") + prior * p) / ((total["good"] + prior) * p)).cast("float")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    listed = every.select(F.struct("bucket", F.coalesce(weight, F.lit(0.0)).cast("float").alias("w")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("all"))
    return cut(listed.select(F.transform("all", lambda x: x["w"]).alias("weights")))


def _scored(rows: DataFrame, table: DataFrame, buckets: int) -> DataFrame:
    """rows (of measured()) and score, the mean weight of the n-grams of a document; null where it has none or has failed the base rules."""
    met = rows.crossJoin(F.broadcast(table.select(F.col("weights").cast("array<double>"))))  # one row of fixed size
    add = lambda a, h: a + F.col("weights")[_bucket(h, buckets)]
    total, n = F.aggregate("_two", F.aggregate("_one", F.lit(0.0), add), add), F.size("_one") + F.size("_two")
    return met.withColumn("score", F.when(~F.col("base_failed") & (n > 0), total / n)).drop("_one", "_two", "weights")


def _low(scored: DataFrame, percentile: float):
    """A row (n, low): how many scores there are, and their percentile, interpolated; scores by 9 digits are counted in parallel.

    A first count by 4 digits says between which steps the two scores lie that the percentile stands between.
    """
    scores = cut(scored.where("score is not null").select(F.round("score", 9).alias("score")))
    coarse = F.floor(F.col("score") * 10_000)
    steps = sorted((r["s"], r["n"]) for r in scores.groupBy(coarse.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())  # a mean of logarithms: some 10^5 steps at most
    number = sum(n for _, n in steps)
    at = percentile * max(0, number - 1)
    seen, wanted = 0, {}
    for step, n in steps:
        for place in {int(at), min(int(at) + 1, number - 1)}:
            if seen <= place < seen + n:
                wanted[place] = (step, place - seen)
        seen += n
    value = {}
    for place, (step, nth) in wanted.items():
        counts = scores.where(coarse == step).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy("score").collect()  # 10^5 different ones at most
        for r in counts:
            if nth < r["n"]:
                value[place] = r["score"]
                break
            nth -= r["n"]
    release(scores)
    below, above = value.get(int(at)), value.get(min(int(at) + 1, number - 1))
    return {"n": number, "low": None if below is None else below + (above - below) * (at - int(at))}


def judged(docs: DataFrame, labels: DataFrame, percentile: float = 0.005, slack: float = 0.03, most_trusted: int | None = None, buckets: int = BUCKETS, min_trusted: int = 20) -> DataFrame:
    """docs with the base counts, base_failed, score and kept.

    The trusted target is learned from all documents labelled good that are not held out (from about most_trusted of them,
    if given); the raw counts are of all docs.  The threshold lies `slack` under the given percentile of the scores, counted
    by 9 digits, of all held-out trusted documents that pass the base rules.  With fewer than min_trusted of these, the base rules alone decide.

    Null texts are empty and fail; a null doc_id has no label; repeated rows are judged each; a repeated label must be
    good in all its rows; an empty table gives an empty result.  Columns of docs with the new names are replaced.
    """
    new = ("words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    docs = docs.drop(*new, "_plain", "_lines", "_pieces", "_one", "_two", "_keys", "_sorted", "_at", "weights")
    chosen = cut(trusted(labels, most_trusted))
    table = weights(docs, chosen, buckets)
    rows, least = measured(docs), None
    if table is not None:
        held = chosen.where("held_out").select(F.col("id").alias("_id"))
        tested = measured(docs.join(_small(held), F.col("doc_id").cast("long") == F.col("_id"), "left_semi"))
        found = _low(_scored(tested, table, buckets), percentile)
        least = found["low"] - slack if found["n"] >= min_trusted else None
    if least is None:
        out = rows.drop("_one", "_two").withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    else:
        out = _scored(rows, table, buckets).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= least, F.lit(True)))
    return _settled(out.drop("words"), "score", "kept")


def report(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score, as in judged()."""
    rows = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, **how)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 9).alias("score"))


def clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs, whatever their names."""
    plain, at = positional(docs, "doc_id", "text")
    named = plain.withColumns({"doc_id": F.col(at["doc_id"]), "text": F.col(at["text"])})
    return named_back(judged(named, labels, **how).where("kept"), docs)
