"""N-gram Jaccard join by vertical partitioning, giving the components of all links.

The n-grams of all documents have one global order.  It is cut into fragments, and every step that touches n-grams
works fragment by fragment:

1. Each distinct text sends its shingles to their fragments (ranges of the n-gram hash), packed per slice of texts.  A
   fragment counts in how many texts each of its n-grams occurs and answers with those that two texts or more have.
2. A text that shares fewer than 75 % of its n-grams with any other cannot link.  The others (survivors) keep their
   shared n-grams in global order: rare first, ties by hash.
3. Linking texts share an n-gram of their prefixes (n - ceil(t n) + 1 first n-grams, unshared ones included), and their
   first one leaves room behind it for the overlap needed.  Candidates come from these postings.
4. That order (rare n-grams first, ties by hash) is cut into fragments at fixed places; a candidate pair's overlap is
   counted in each fragment separately and summed per pair.

Only components are asked for, so texts that are linked already need no comparison: each round first compares every text
of a posting list with one member of it (a star), merges what links, and only what is still apart in a list is compared
pair by pair in the last round, where bitmaps of all n-grams rule most pairs out; a long list is dealt to several tasks
there.  A thousand near copies cost a few thousand comparisons, and no link between different components is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, buffers, cut, even_keys, group_starts, id_key, lean, mix, named_back, pack_arrays, positional, ranges, release, slices, text_bytes, unpack_arrays, word_hashes, words_in
from .components import components

WORDS = 5
PERCENT = 75
_R = np.uint64(0x9E3779B97F4A7C15)
SIGNATURE = 1024  # bits of a text's n-gram bitmap in the last round
LIST = 4096  # members of a posting list that one task compares with all others of the list
_PACKED = "bucket int, payload binary"
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Where the global order is cut: below these (texts that have the n-gram, hash).
PIVOTS = ((2, 1 << 62), (2, 2 << 62), (2, 3 << 62), (3, 0), (6, 0))


def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of the texts, one text after another and sorted within each without repeats, and their numbers."""
    data, offsets = buffers(texts)
    data = _LOWER[data]
    start, end, counts = words_in(data, offsets)
    h = word_hashes(data, start, end)
    starts = np.cumsum(counts) - counts
    rolled = h[: max(0, len(h) - k + 1)].copy()
    for j in range(1, k if len(rolled) else 0):
        rolled = rolled * _R + h[j : j + len(rolled)]
    number = np.maximum(counts - k + 1, 0)
    at = ranges(starts, number)
    doc, value = np.repeat(np.arange(len(counts)), number), mix(rolled[at]) if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = []
        for i in short.tolist():
            x = np.array([counts[i]], np.uint64)  # a length tag: a short text is no shingle of a long one
            for w in h[starts[i] : starts[i] + counts[i]]:
                x = mix(x * _R + w)
            whole.append(x[0])
        doc, value = np.concatenate((doc, short)), np.concatenate((value, np.array(whole, np.uint64)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=len(counts))


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    b, p = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.binary())], ["bucket", "payload"])


def _scatter(k: int, keys: list[int]):
    """Texts to ranges of the hash: (classes, numbers of n-grams in the range, the n-grams), and sizes to class buckets."""
    n = len(keys)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=3 << 20):
            c1 = batch.column("c1").to_numpy(zero_copy_only=False)
            _, own = np.unique(c1, return_index=True)  # equal texts of the slice once
            c1 = c1[own]
            value, sizes = shingle_hashes(batch.column("text").take(pa.array(own)), k)
            fragment = ((value >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            doc = np.repeat(np.arange(len(c1)), sizes)
            order = np.argsort(fragment.astype(np.int32), kind="stable")  # keeps documents, and values within them, in order
            value, doc, fragment = value[order], doc[order], fragment[order]
            rows = []
            for part in np.split(np.arange(len(value)), group_starts(fragment)[1:]) if len(value) else ():
                low, own = value[part], doc[part]
                starts = group_starts(own)
                numbers = np.diff(np.append(starts, len(own))).astype(np.int32)
                rows.append((keys[int(fragment[part[0]])], pack_arrays(c1[own[starts]], numbers, low)))
            rows.append((keys[int(abs(int(c1[0])) % n)], pack_arrays(c1, sizes.astype(np.int32))))
            yield _rows(rows)

    return scatter


def _fragment(keys: list[int]):
    """Counts the n-grams of a fragment over all texts; to class buckets: the shared ones with their counts, and all sizes."""
    n = len(keys)

    def by_class(c: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
        bucket = np.abs(c % n)
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        for part in np.split(order, group_starts(bucket[order])[1:]) if len(order) else ():
            yield keys[int(bucket[part[0]])], pack_arrays(c[part], *(m[part] for m in more))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, numbers, values = [], [], []
        for batch in batches:
            rows = []
            for payload in batch.column("payload").to_pylist():
                arrays = unpack_arrays(payload)
                if len(arrays) == 2:
                    rows += by_class(*arrays)
                else:
                    table.append(arrays[0]), numbers.append(arrays[1]), values.append(arrays[2])
            if rows:
                yield _rows(rows)
        if not table:
            return
        c, size, value = np.concatenate(table), np.concatenate(numbers), np.concatenate(values)
        del table, numbers, values
        owner = np.repeat(np.arange(len(c), dtype=np.int32), size)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], c[owner[order]]
        # a text that several slices have comes several times: equal (n-gram, class) pairs count once
        starts = group_starts(value)
        runs = np.diff(np.append(starts, len(value)))
        many = np.repeat(runs > 1, runs)
        value, owner = value[many], owner[many]
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        starts = group_starts(value)
        runs = np.diff(np.append(starts, len(value)))
        df = np.repeat(runs, runs)
        many = df > 1
        if many.any():
            yield _rows(list(by_class(owner[many], value[many], np.minimum(df[many], 2**31 - 1).astype(np.int32))))

    return count


def _survivors(percent: int):
    """Per class: its size and, if it may link, its shared n-grams in global order."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, values, dfs, classes, sizes = [], [], [], [], []
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                arrays = unpack_arrays(payload)
                if len(arrays) == 2:
                    classes.append(arrays[0]), sizes.append(arrays[1])
                else:
                    owners.append(arrays[0]), values.append(arrays[1]), dfs.append(arrays[2])
        if not classes:
            return
        c, at = np.unique(np.concatenate(classes), return_index=True)
        n = np.concatenate(sizes)[at]
        none = np.zeros(0, np.int64)
        owner = np.searchsorted(c, np.concatenate(owners)) if owners else none
        value = np.concatenate(values) if values else none.astype(np.uint64)
        df = np.concatenate(dfs) if dfs else none.astype(np.int32)
        del owners, values, dfs, classes, sizes
        shared = np.bincount(owner, minlength=len(c))
        may = 100 * shared >= percent * n
        keep = may[owner]
        owner, value, df = owner[keep], value[keep], df[keep]
        order = np.lexsort((value, df, owner))
        owner, value, df = owner[order], value[order], df[order]
        count = np.where(may, shared, 0)
        offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.astype(np.int64)))
        # how many of a text's n-grams lie below each pivot of the global order
        ends = np.stack([np.bincount(owner[(df < d) | (df == d) & (value < np.uint64(v))], minlength=len(c)) for d, v in PIVOTS], 1).astype(np.int32)
        ends = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * len(PIVOTS)), pa.array(ends.reshape(-1)))
        for i in range(0, len(c), 2000):
            part = slice(i, i + 2000)
            size = len(c[part])
            yield pa.RecordBatch.from_arrays([pa.array(c[part]), pa.array(n[part].astype(np.int64)), grams.slice(i, size), ends.slice(i, size)], ["c", "n", "grams", "ends"])

    return gather


def shared_grams(docs: DataFrame, k: int, percent: int, fragment_bytes: int) -> DataFrame:
    """Per distinct text c: its hash, n: size of its set, grams: its shared n-grams if it may link, ends: where PIVOTS cut these."""
    n = max(1, math.ceil(text_bytes(docs) / fragment_bytes))
    keys = even_keys(docs.sparkSession, n)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sent = docs.select(F.xxhash64(text).alias("c1"), text.alias("text")).mapInArrow(lean(_scatter(k, keys)), _PACKED)
    answered = sent.repartition(n, "bucket").mapInArrow(lean(_fragment(keys)), _PACKED)
    return answered.repartition(n, "bucket").mapInArrow(lean(_survivors(percent)), "c long, n long, grams array<long>, ends array<int>")


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """Least overlap of a link: 100 o >= p (na + nb - o)."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100.0 + percent) - 1e-9)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted per fragment of the order, then summed per pair."""
    edges = F.concat(F.array(F.lit(0)), "ends", F.array(F.size("grams")))
    parts = F.transform(F.sequence(F.lit(0), F.lit(len(PIVOTS))), lambda i: F.slice("grams", F.get(edges, i) + 1, F.get(edges, i + 1) - F.get(edges, i)))
    cuts = sets.select("c", "n", F.posexplode(parts).alias("fragment", "part")).where(F.size("part") > 0)
    a = cuts.select(F.col("c").alias("a"), F.col("n").alias("na"), "fragment", F.col("part").alias("pa"))
    b = cuts.select(F.col("c").alias("b"), F.col("n").alias("nb"), "fragment", F.col("part").alias("pb"))
    partial = pairs.join(a, "a").join(b, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(F.lit(100) * F.col("o") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _fits(x: str, y: str, percent: int) -> Column:
    """Can this be the first n-gram that two texts have in common, and they link?  By their sizes and the shared n-grams behind it."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = 1 + F.least(F.col(f"{x}.behind"), F.col(f"{y}.behind"))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (most >= _needed(nx, ny, percent))


def _signatures(sets: DataFrame) -> DataFrame:
    """(c, shared, s0, s1, ...): the shared n-grams of a text as a bitmap of SIGNATURE bits, in longs."""
    words = SIGNATURE // 64

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("grams")
            counts = np.diff(grams.offsets.to_numpy())
            value = grams.flatten().to_numpy().astype(np.uint64) >> np.uint64(8)
            out = np.zeros((batch.num_rows, words), np.uint64)
            np.bitwise_or.at(out, (np.repeat(np.arange(len(counts)), counts), ((value >> np.uint64(6)) % np.uint64(words)).astype(np.int64)), np.uint64(1) << (value & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(counts.astype(np.int64)), *(pa.array(w.astype(np.int64)) for w in out.T)], ["c", "shared", *(f"s{i}" for i in range(words))])

    return sets.select("c", "grams").mapInArrow(lean(sign), "c long, shared long, " + ", ".join(f"s{i} long" for i in range(words)))


def _may_overlap(x: str, y: str, percent: int) -> Column:
    """Bits that differ are n-grams that differ: overlap <= (shared x + shared y - differing bits) / 2."""
    differ = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(SIGNATURE // 64)), F.lit(0))
    return F.col(f"{x}.shared") + F.col(f"{y}.shared") - differ >= 2 * _needed(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)


def linked_classes(sets: DataFrame, percent: int = PERCENT, star_rounds: int = 2) -> DataFrame:
    """(c, root) for the texts of `sets` that link with others; root is the smallest c of the component."""
    may = sets.where(F.size("grams") > 0)
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1 - (F.col("n") - F.size("grams"))
    posting = may.select("c", "n", F.size("grams").alias("shared"), F.posexplode(F.slice("grams", F.lit(1), prefix.cast("int"))).alias("i", "gram"))
    posting = cut(posting.select("gram", "c", "n", (F.col("shared") - F.col("i") - 1).alias("behind"), F.col("c").alias("label")))
    roots = known = None
    for round_ in range(star_rounds + 1):
        current = posting
        if roots is not None:
            moved = roots.select(F.col("node").alias("c"), F.col("root").alias("new"))
            current = posting.drop("label").join(moved, "c", "left").select("gram", "c", "n", "behind", F.coalesce("new", "c").alias("label"))
        order = F.xxhash64(F.lit(round_), "c") if round_ == 0 else F.xxhash64(F.lit(round_), "c", "gram")
        open_ = current.groupBy("gram").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("c", "n", "behind", "label"), order).alias("hub"), F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("parts")
        )
        open_ = open_.where("lo < hi").select("gram", "hub", "parts")
        apart = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") != F.col("y.label")) & _fits("x", "y", percent)
        signed = stuck = None
        if round_ < star_rounds:
            x, y = current.alias("x"), open_.select("gram", "hub.*").alias("y")
        else:  # what is still apart: pair by pair, past a bitmap of all n-grams, a long list part by part
            stuck = cut(current.join(open_.select("gram", "parts"), "gram"))
            signed = cut(_signatures(may.join(stuck.select("c").distinct(), "c", "left_semi")))
            both = stuck.join(signed, "c")
            x = both.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")).alias("x")
            y = both.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
            apart &= (F.col("x.part") == F.col("y.part")) & (F.col("x.c") < F.col("y.c")) & _may_overlap("x", "y", percent)
        pairs = x.join(y, apart).select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
        found = cut(_verified(pairs, may, percent).select(F.col("a").alias("u"), F.col("b").alias("v")))
        links = found if roots is None else found.unionByName(known.select(F.col("node").alias("u"), F.col("root").alias("v")))
        before, known = known, components(links)
        roots = known.select("node", "root")
        release(found, stuck, signed, before)
    release(posting)
    return roots.select(F.col("node").alias("c"), "root")


def _classes(docs: DataFrame, k: int, percent: int, fragment_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (doc_id, id, c), and per class of equal texts (c, n, root, own: its smallest id, low: that of the component)."""
    sets = cut(shared_grams(docs, k, percent, fragment_bytes))
    roots = linked_classes(sets, percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("id"), _class().alias("c"))
    known = sets.select("c", "n").join(roots, "c", "left").select("c", "n", F.coalesce("root", "c").alias("root"))
    known = rows.groupBy("c").agg(F.min("id").alias("own")).join(known, "c")
    least = known.groupBy("root").agg(F.min("own").alias("low"))
    return rows, known.join(least, "root").select("c", "n", "root", "own", "low")


def _class(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def linked(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, fragment_bytes: int = 8 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, the smallest doc_id reachable by links, itself included.

    A null or blank text has the empty set and links with nothing, not even its like.  A text of fewer than k words has
    one shingle, the whole sequence.  A null doc_id sorts above all others and stays null only where no document with
    an id is reachable; rows with one doc_id and different texts are different documents; equal rows come out each; an
    empty table gives an empty result; other columns of docs are ignored.
    """
    rows, found = _classes(docs, k, percent, fragment_bytes)
    component = F.when(F.col("n") > 0, F.nullif(F.col("low"), F.lit(NO_ID))).otherwise(F.col("doc_id"))
    return rows.join(found.select("c", "n", "low"), "c").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def representatives(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, fragment_bytes: int = 8 << 20) -> DataFrame:
    """docs with one row of each component, one of the smallest doc_id.  Columns are those of docs, whatever their names.

    Documents that link with nothing stay, each blank one included.  Where several texts of a component have the
    smallest doc_id, that of the smallest text hash stays; of equal rows one.
    """
    plain, at = positional(docs, "doc_id", "text")
    plain = plain.withColumn("id", id_key(at["doc_id"])).withColumn("c", _class(at["text"]))
    rows, found = _classes(docs, k, percent, fragment_bytes)
    first = found.where("own = low").groupBy("root").agg(F.min("c").alias("c")).select("c", F.lit(True).alias("first"))
    chosen = found.join(first, "c", "left").where("n = 0 or first").select("c", "n", "own")
    kept = rows.join(chosen, "c").where("n = 0 or id = own").select("id", "c", (F.col("n") == 0).alias("blank")).distinct()
    joined = plain.join(kept, ["id", "c"])
    one = joined.withColumn("row", F.when(F.col("blank"), F.monotonically_increasing_id()).otherwise(F.lit(0)))
    return named_back(one.dropDuplicates(["id", "c", "row"]), docs)
