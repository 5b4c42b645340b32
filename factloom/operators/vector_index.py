"""An inverted-file index over vectors.

Centroids are fitted on a bounded sample; every vector is stored with its nearest centroid (its cell) and its angle to
it.  A query meets the items of the few cells nearest to it, whose scores are computed exactly; how many cells is tuned
on a bounded set of queries against the exact answer.  With a threshold nothing is left to chance: by the triangle
inequality on angles a cell's ring of angles can be skipped if it cannot hold a vector near enough, and all others are met.

Cells are cut into blocks of bounded size, so a hot cell is many groups.  A search deals the blocks to bins and sends each
query once to a bin, with the cells that it probes there: its work grows with items times probes, its shuffle does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .graph import _saved
from .search import _products, neighbours

_SLACK = 1e-6  # on angles, for rounding


def _units(rows: list | np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (a row of zeros stays); without columns if their lengths differ."""
    same = len({len(r) for r in rows}) == 1
    x = np.array(rows if isinstance(rows, np.ndarray) else [list(r) for r in rows], np.float64) if same else np.zeros((len(rows), 0))
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fit_centroids(items: DataFrame, cells: int, sample: int = 20_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means over about `sample` vectors, those of the smallest hashes of their ids; at most `cells` centroids, fewer for fewer vectors.

    The sample is the only thing that the driver holds.  Vectors of norm 0 and null ones do not take part.
    """
    rows = items.where("embedding is not null").select("embedding", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1 << 30)).alias("h"))
    share = min(1.0, sample / max(1, rows.count()))
    drawn = rows.where(F.col("h") < share * (1 << 30)).orderBy("h").toPandas()["embedding"].tolist()  # ordered, so that the fit does not depend on the input's split
    lengths = [len(r) for r in drawn]
    usual = max(set(lengths), key=lengths.count, default=0)  # other lengths cannot be compared
    x = _units([r for r in drawn if len(r) == usual])
    x = x[np.linalg.norm(x, axis=1) > 0] if x.size else np.zeros((0, 0))
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 1e-12, sums / np.maximum(n, 1e-12), c)  # an empty cell keeps its place
    return c


@dataclass
class Index:
    """centroids; items: the stored (id, embedding, cell, angle, block) of every item; blocks: (cell, block, low, high) angles of each block."""

    centroids: np.ndarray
    items: DataFrame
    blocks: DataFrame
    probes: int = 8
    id_type: str = field(default="bigint")


def _located(df: DataFrame, centroids: np.ndarray, number: int | None, together: bool = False) -> DataFrame:
    """(id, embedding, cell, angle) for the `number` nearest centroids of each vector, or for all of them; vectors of another length meet none.

    together: one row (id, embedding, cells) a vector instead, nearest first.
    """
    c = centroids

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(2048, 65_536 // max(1, len(c) if number is None else min(number, len(c)))))  # rows times cells, so that a batch stays small
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                batch = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), c.shape[1])) if c.shape[1] else batch.slice(0, 0)
                if not batch.num_rows:
                    continue
                x = _units(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1]))
                dots = np.clip(x @ c.T, -1, 1)
                k = len(c) if number is None else min(number, len(c))
                near = np.argsort(-dots, axis=1, kind="stable")[:, :k]
                if together:
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(near.ravel().astype(np.int32)))], ["id", "embedding", "cells"])
                    continue
                each = pa.array(np.repeat(np.arange(len(x)), k))
                angle = np.arccos(np.take_along_axis(dots, near, 1)).ravel()
                yield pa.RecordBatch.from_arrays([batch.column("id").take(each), batch.column("embedding").take(each), pa.array(near.ravel().astype(np.int32)), pa.array(angle)], ["id", "embedding", "cell", "angle"])

    kind = df.schema["id"].dataType.simpleString()
    of = df.schema["embedding"].dataType.simpleString()
    of = of if of == "array<float>" else "array<double>"  # float is half as much to send, and exact in double
    rows = df.where("embedding is not null").select("id", F.col("embedding").cast(of).alias("embedding"))
    return rows.mapInArrow(locate, f"id {kind}, embedding {of}, " + ("cells array<int>" if together else "cell int, angle double"))


def build(items: DataFrame, cells: int | None = None, block_rows: int = 4096, sample: int = 20_000) -> Index:
    """The index of all items (id, embedding); by default about the square root of their number of cells, at most 4,096.

    Every item is stored once, in the cell of its nearest centroid; a cell of more than block_rows is cut into blocks by
    angle, by ranges that follow from its own angles' histogram of 64 steps, and these by a hash of the id.
    """
    number = items.where("embedding is not null").count()
    cells = cells or int(min(4096, max(1, round(number**0.5))))
    centroids = fit_centroids(items, cells, sample)
    placed = _saved(_located(items, centroids, 1))
    step = F.floor(F.col("angle") / (np.pi / 64)).cast("int")
    counts = placed.groupBy("cell", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))  # at most 65 rows a cell
    rings = counts.withColumn("ring", F.floor(F.coalesce(before, F.lit(0)) / block_rows).cast("int"))
    wide = rings.withColumn("in_ring", F.sum("n").over(Window.partitionBy("cell", "ring"))).withColumn("parts", F.ceil(F.col("in_ring") / block_rows).cast("int"))
    met = placed.withColumn("step", step).join(wide.select("cell", "step", "ring", "parts"), ["cell", "step"])  # a row for each cell and step
    stored = _saved(met.select("id", "embedding", "cell", "angle", (F.col("ring") * 65_536 + F.pmod(F.xxhash64(F.col("id").cast("string")), F.col("parts").cast("long")).cast("int")).alias("block")))
    blocks = _saved(stored.groupBy("cell", "block").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")))
    return Index(centroids, stored, blocks, id_type=items.schema["id"].dataType.simpleString())


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")  # k rows for each block that was met
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _bins(n: int, most: int) -> int:
    """Up to 8 of 1,024 rows or more, then of `most` rows."""
    return max(1, -(-n // min(most, max(1024, -(-n // 8)))))


def _by_bin(near: DataFrame, of_cell: DataFrame) -> DataFrame:
    """(id, embedding, bin, cells): each query once for each bin that holds one of its cells; of_cell: (cell, bin), at most a row a block."""
    held = np.array(sorted((r["cell"], r["bin"]) for r in of_cell.collect()), np.int64).reshape(-1, 2)
    top = held[-1, 0] + 1 if len(held) else 0
    first, many = np.searchsorted(held[:, 0], np.arange(top)), np.bincount(held[:, 0], minlength=top)  # of a cell in held

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probed = batch.column("cells")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(probed).to_numpy(zero_copy_only=False))
            cell = probed.flatten().to_numpy(zero_copy_only=False)
            row, cell = row[cell < top], cell[cell < top]
            n = many[cell]
            at = np.repeat(first[cell] + n - np.cumsum(n), n) + np.arange(n.sum())
            row, cell, to = np.repeat(row, n), np.repeat(cell, n), held[at, 1]
            order = np.lexsort((to, row))  # stable: the cells stay nearest first
            row, cell, to = row[order], cell[order], to[order]
            starts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(to, prepend=-1))
            if len(starts):
                each, bounds = pa.array(row[starts]), pa.array(np.append(starts, len(row)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(each), batch.column("embedding").take(each), pa.array(to[starts].astype(np.int32)), pa.ListArray.from_arrays(bounds, pa.array(cell.astype(np.int32)))], ["id", "embedding", "bin", "cells"])

    kind = {c: near.schema[c].dataType.simpleString() for c in ("id", "embedding")}
    return near.mapInArrow(deal, f"id {kind['id']}, embedding {kind['embedding']}, bin int, cells array<int>")


def search(index: Index, queries: DataFrame, k: int, minimum: float = -1.0, probes: int | None = None, exclude_self: bool = True, most: int = 65_536) -> DataFrame:
    """(query_id, id, score, rank): the k best of the items in the `probes` cells nearest to each query; scores are exact, ties by id.

    Each pair of a bin of blocks and a part of the queries, both of at most about `most` rows, is one group, worked through
    in matrix products of which the k best a query go on: a row is sent N / most times at most, whatever the probes.
    """
    k = max(1, k)
    wanted = k + 1 if exclude_self else k
    bins, parts = _bins(index.items.count(), most), _bins(queries.count(), most)
    bin_of = F.pmod(F.xxhash64("cell", "block"), F.lit(bins)).cast("int")
    near = _by_bin(_located(queries, index.centroids, probes or index.probes, True), index.blocks.select("cell", bin_of.alias("bin")).distinct())
    asked = near.select(F.col("id").alias("query_id"), "embedding", "cells", "bin", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(3)), F.lit(parts)).cast("int").alias("part"))
    some = index.items.select("id", F.col("embedding"), "cell", bin_of.alias("bin_"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part_"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = right.sort_values("id", kind="stable", ignore_index=True)
            copy = pd.Series([v.tobytes() for v in right["embedding"]])
            right = right[(right.groupby([copy, "cell"]).cumcount() < wanted).to_numpy()].reset_index(drop=True)  # of equal vectors the first ids are as many as can be wanted
            left = left.assign(_near=[c[0] for c in left["cells"]]).sort_values("_near", kind="stable", ignore_index=True)  # strips of queries that probe the same cells
            ids, own = right["id"].to_numpy(), left["query_id"].to_numpy()
            found = [pd.DataFrame({"query_id": own[i], "id": ids[j], "score": score}) for i, j, score in _products(left, right, minimum, wanted, probed=True)]
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "score": []})

    schema = f"query_id {queries.schema['id'].dataType.simpleString()}, id {index.id_type}, score double"
    found = asked.groupBy("bin", "part").cogroup(some.groupBy("bin_", "part_")).applyInPandas(meet, schema)
    return _best(found.where("query_id <> id") if exclude_self else found, k)


def within(index: Index, queries: DataFrame, minimum: float, k: int | None = None, exclude_self: bool = True, most: int = 65_536) -> DataFrame:
    """(query_id, id, score) of all items at or above the threshold, or of the k best of them: exact, by the bound on angles.

    For a query at angle a to a centroid, an item at angle x to it is no nearer than |a - x|; blocks whose angles all lie
    further than the threshold's angle from a are not met.  As in search(), a pair of a bin of blocks and a part of the
    queries is one group, so a row is sent N / most times at most; a query learns its angles to the bin's centroids there.
    """
    limit, centroids = float(np.arccos(np.clip(minimum, -1, 1))) + _SLACK, index.centroids
    wanted = None if k is None else max(1, k) + 1 if exclude_self else max(1, k)
    bins, parts = _bins(index.items.count(), most), _bins(queries.count(), most)
    bin_of = lambda *by: F.pmod(F.xxhash64(*by), F.lit(bins)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = queries.schema["id"].dataType.simpleString()
    null = lambda of: F.lit(None).cast(of)
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(3)), F.lit(parts)).cast("int")
    asked = queries.where("embedding is not null").select(F.col("id").alias("query_id"), null(index.id_type).alias("id"), "embedding", null("int").alias("cell"), null("double").alias("angle"), null("int").alias("block"), every(bins).alias("bin"), part.alias("part"))
    some = index.items.select(null(kind).alias("query_id"), "id", "embedding", "cell", "angle", "block", bin_of("cell", "block").alias("bin"), every(parts).alias("part"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        own = pc.is_null(both.column("cell"))
        left, right = both.filter(own).to_pandas(), both.filter(pc.invert(own)).to_pandas()
        left = left[left["embedding"].map(len) == centroids.shape[1]]
        if not len(left) or not len(right):
            return
        right = right.sort_values("id", kind="stable", ignore_index=True)
        of_block = right.groupby(["cell", "block"])
        blocks = of_block["angle"].agg(["min", "max"]).reset_index()
        near, low, high = centroids[blocks["cell"].to_numpy(np.int64)].T, blocks["min"].to_numpy() - limit, blocks["max"].to_numpy() + limit
        right["cell"] = of_block.ngroup()  # the blocks of the bin, in their order
        ids = right["id"].to_numpy()
        for start in range(0, len(left), 8192):
            mine = left.iloc[start : start + 8192]
            a = np.arccos(np.clip(_units(mine["embedding"].tolist()) @ near, -1, 1))
            mine = mine.assign(cells=[np.flatnonzero(m).astype(np.int32) for m in (a >= low) & (a <= high)]).iloc[np.argsort(a.argmin(1), kind="stable")]  # strips of queries that meet the same blocks
            mine = mine[mine["cells"].map(len) > 0]
            q_ids = mine["query_id"].to_numpy()
            for i, j, score in _products(mine, right, minimum, wanted, strip=512 if k else 128, probed=True):  # without k a strip may find all
                for at in range(0, len(i), 65_536):
                    x, y, z = i[at : at + 65_536], j[at : at + 65_536], score[at : at + 65_536]
                    out = pa.RecordBatch.from_arrays([pa.array(q_ids[x], types[0]), pa.array(ids[y], types[1]), pa.array(z)], ["query_id", "id", "score"])
                    yield out.filter(pa.array(q_ids[x] != ids[y])) if exclude_self else out

    types = [to_arrow_type(df.schema["id"].dataType) for df in (queries, index.items)]
    found = asked.unionByName(some).groupBy("bin", "part").applyInArrow(meet, f"query_id {kind}, id {index.id_type}, score double")
    return found if k is None else _best(found, k).drop("rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: pairs (query_id, id) in the exact answer, how many of them were found, and their share (1 where there are none)."""
    hit = exact.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    counted = hit.agg(F.count(F.lit(1)).alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    return counted.withColumn("recall", F.coalesce(F.try_divide("found", "wanted"), F.lit(1.0)))


def tuned(index: Index, items: DataFrame, k: int, target: float = 0.95, asked: int = 200) -> Index:
    """The index with the fewest probes (doubled, then refined by halves) whose recall is at least `target` for about `asked` of its items as queries.

    The queries are those of the smallest hashes of their ids: a bounded number, measured against the exact answer.
    """
    share = min(1.0, asked / max(1, items.count()))
    some = _saved(items.select("id", "embedding").where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(1 << 20)) < share * (1 << 20)))
    exact = _saved(neighbours(some, items, k).select("query_id", "id"))
    cells = max(1, len(index.centroids))
    # one search with all cells ranked tells each wanted pair's cell, hence the recall of every number of probes
    order = _located(some, index.centroids, None).select(F.col("id").alias("query_id"), "cell", F.row_number().over(Window.partitionBy("id").orderBy("angle", "cell")).alias("probe"))
    where = exact.join(index.items.select("id", "cell"), "id").join(order, ["query_id", "cell"])
    counts = {r["probe"]: r["n"] for r in where.groupBy("probe").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row a cell
    total, seen = sum(counts.values()), 0
    for probe in range(1, cells + 1):
        seen += counts.get(probe, 0)
        if seen >= target * total:
            index.probes = probe
            break
    return index
