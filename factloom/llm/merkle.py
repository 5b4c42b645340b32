"""Merkle manifest of a table, and the proof of every row, by Octopus multiproofs.

Rows are the leaves of one tree per group, sorted by key; the groups' roots are the leaves of a tree above them.

1. The leaves are dealt by range to leaf partitions of bounded size, so a group that holds a third of all rows lies in many.
2. Each leaf partition hashes the nodes whose leaves it holds; those without a parent there are its frontier.  Nodes
   over several partitions are hashed from frontiers, level by level, 16 at a time.
3. Each leaf partition works out the minimal union of the nodes that the proofs of all its leaves need and it cannot
   derive: at each level only the rest of the first and of the last run.  These are fetched by one join, the interiors
   derived again from them, once for all leaves, and the proof of each leaf is read off locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, placed, release, shuffle_width
from .sharding import _starts

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
_TOP = -1  # the number of the tree over the groups
_NODE = "tree long, level int, idx long, number long, hash binary"
_PROOF = "id long, grp string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_hash(*values: Column) -> Column:
    """SHA-256 (hex) of the values in order: `-` for null, else the number of its UTF-8 bytes, `:` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _hash(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _frontier(nodes: list[str], at: int, number: int) -> Iterator[tuple[int, int, int, str]]:
    """(level, index, number of nodes on the level, hash) of the nodes at, at + 1, ... of a tree that have no parent among what follows from them."""
    level = 0
    while nodes:
        end, first = at + len(nodes), -(-at // ARITY)
        last = number // ARITY + (number % ARITY > 0) if end == number else end // ARITY  # runs from first to last - 1 are whole
        if number == 1 or last <= first:
            yield from ((level, at + i, number, h) for i, h in enumerate(nodes))
            return
        low, high = first * ARITY - at, min(last * ARITY, number) - at
        yield from ((level, at + i, number, nodes[i]) for i in (*range(low), *range(high, len(nodes))))
        nodes = [_hash(nodes[i : min(i + ARITY, high)]) for i in range(low, high, ARITY)]
        at, number, level = first, -(-number // ARITY), level + 1


def _missing(at: int, count: int, number: int) -> Iterator[tuple[int, int, int]]:
    """(level, start, end) of the indices that the proofs of `count` leaves from `at` on need and that do not follow from these leaves."""
    level, low, high = 0, at, at + count
    while number > 1:
        first, last = low // ARITY, (high - 1) // ARITY
        yield level, first * ARITY, low
        yield level, high, min((last + 1) * ARITY, number)
        low, high, number, level = first, last + 1, -(-number // ARITY), level + 1


class _Branch:
    """All nodes above consecutive leaves of a tree: the fetched ones and those derived from both."""

    def __init__(self, nodes: list[str], at: int, number: int, fetched: dict[tuple[int, int], str]) -> None:
        self.levels: list[tuple[int, list[str], int]] = []  # (index of the first, hashes, number of nodes on the level)
        gaps = {}
        for level, a, b in _missing(at, len(nodes), number):
            gaps.setdefault(level, []).append((a, b))
        level = 0
        while number > 1:
            (a, b), (c, d) = gaps[level]
            nodes = [*(fetched[level, i] for i in range(a, b)), *nodes, *(fetched[level, i] for i in range(c, d))]
            self.levels.append((a, nodes, number))
            nodes = [_hash(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
            at, number, level = a // ARITY, -(-number // ARITY), level + 1
        self.root = nodes[0]

    def siblings(self, index: int) -> list[tuple[str, str]]:
        """Per level the hashes left and right of the node over leaf `index` within its run."""
        out = []
        for at, nodes, _ in self.levels:
            i = index - at
            low = i - i % ARITY
            out.append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + ARITY])))
            index //= ARITY
        return out


def _own_part(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each leaf partition in a task, as columns; a task has one."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    part = table.column("part").to_numpy()
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield table.slice(a, b - a)


def _segments(part: pa.Table) -> tuple[list[dict], list[str], pa.Table]:
    """The groups of a leaf partition in order, the hashes of its leaves, and these as a table."""
    kind = part.column("kind").to_numpy()
    groups = part.filter(pa.array(kind == 0)).select(["tree", "first", "n", "at", "number"]).to_pylist()
    leaves = part.filter(pa.array(kind == 2))
    return sorted(groups, key=lambda g: g["first"]), [h.hex() for h in leaves.column("hash").to_pylist()], leaves


def _frontiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _own_part(batches):
        groups, hashes, _ = _segments(part)
        rows = [(g["tree"], *node) for g in groups for node in _frontier(hashes[g["first"] : g["first"] + g["n"]], g["at"], g["number"])]
        tree, level, idx, number, found = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(number, pa.int64()), pa.array(map(bytes.fromhex, found), pa.binary())],
            ["tree", "level", "idx", "number", "hash"],
        )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [c.split() for c in _PROOF.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _own_part(batches):
        groups, hashes, leaves = _segments(part)
        nodes = part.filter(pa.array(part.column("kind").to_numpy() == 1)).select(["tree", "level", "idx", "hash"]).to_pydict()
        fetched: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, idx, h in zip(*nodes.values(), strict=True):
            fetched.setdefault(tree, {})[level, idx] = h.hex()
        own = [_Branch(hashes[g["first"] : g["first"] + g["n"]], g["at"], g["number"], fetched.get(g["tree"], {})) for g in groups]
        above = _Branch([b.root for b in own], groups[0]["tree"], part.column("trees")[0].as_py(), fetched.get(_TOP, {}))
        ids, sources, others = (leaves.column(c).to_pylist() for c in ("id", "grp", "other"))
        out: list[tuple] = []
        for g, branch in zip(groups, own, strict=True):
            upper = above.siblings(g["tree"])
            for k in range(g["n"]):
                i = g["first"] + k
                path = branch.siblings(g["at"] + k) + upper
                now = others[i].hex() if others[i] is not None else hashes[i]
                for left, right in path:
                    now = sha256(f"{left}{now}{right}".encode()).hexdigest()
                proof = sha256("".join(x for pair in path for x in pair).encode()).hexdigest()
                out.append((ids[i], sources[i], hashes[i], branch.root, above.root, proof, now, now == above.root))
                if len(out) == 4096:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, tree, level, idx): the nodes that a leaf partition must fetch."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            rows += [(r["part"], r["tree"], level, i) for level, a, b in _missing(r["at"], r["n"], r["number"]) for i in range(a, b)]
        part, tree, level, idx = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(tree, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64())], ["part", "tree", "level", "idx"])


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes over runs of at most 16 of these; those alone on their level have none."""
    run = F.sort_array(F.collect_list(F.struct("idx", F.lower(F.hex("hash")).alias("h"))))
    up = nodes.where("number > 1").groupBy("tree", F.floor(F.col("idx") / ARITY).alias("idx")).agg(run.alias("run"), F.max("number").alias("number"))
    h = F.unhex(F.sha2(F.array_join(F.transform("run", lambda x: x["h"]), ""), 256))
    return up.select("tree", F.lit(level + 1).alias("level"), "idx", F.ceil(F.col("number") / ARITY).alias("number"), h.alias("hash"))


def _levels(number: int) -> int:
    n = 0
    while number > 1:
        number, n = -(-number // ARITY), n + 1
    return n


def _kept(tables: list[DataFrame], df: DataFrame) -> DataFrame:
    tables.append(cut(df))
    return tables[-1]


class Forest:
    """The stored leaves, leaf partitions and nodes of one table; close() deletes them."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, other: Column | None = None, part_rows: int = 32_768) -> None:
        """other: the hash (hex) of a leaf that a verifier holds instead of the true one, null where it is the same."""
        spark = docs.sparkSession
        own = leaf_hash(*[F.col(f) for f in fields])
        rows = docs.select(
            F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("grp"), F.unhex(own).alias("hash"), (F.lit(None).cast("binary") if other is None else F.unhex(other)).alias("other")
        ).withColumn("name", F.when(F.col("grp").isNull(), "").otherwise(F.concat(F.lit("+"), "grp")))  # null before the empty name
        flat = cut(rows)
        self.rows = flat.count()
        self.leaves, segments = placed(flat, ["name"], ["id", "hash"], max(1, shuffle_width(spark), math.ceil(self.rows / part_rows)))
        release(flat)
        self.tables = [self.leaves, segments]
        if not self.rows:
            return
        # the groups, numbered in order: partitions and what is in them are in order already
        begun = segments.where("at = 0")
        bases = _starts(_kept(self.tables, begun.groupBy(F.col("part").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))))
        in_part = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1  # at most the rows of a leaf partition
        numbered = begun.withColumn("k", in_part).join(bases.withColumnRenamed("bucket", "part"), "part").select("name", (F.col("start") + F.col("k")).alias("tree"))
        self.groups = _kept(self.tables, segments.join(numbered, "name").select("part", "name", "tree", "first", "n", "at", F.col("total").alias("number")))
        most = self.groups.agg(F.max("part").alias("part"), F.max("number").alias("number"), F.max("tree").alias("tree")).first()
        self.parts, self.trees, depth = most["part"] + 1, most["tree"] + 1, _levels(most["number"])
        frontier = _kept(self.tables, self._by_part(None, _frontiers, _NODE))
        made, at_level = [frontier], frontier.where("level = 0")
        for level in range(depth):
            made.append(_kept(self.tables, _parents(at_level, level)))
            at_level = frontier.where(F.col("level") == level + 1).unionByName(made[-1])
        nodes = made[0]
        for more in made[1:]:
            nodes = nodes.unionByName(more)
        tops = nodes.where("number = 1").select(F.lit(_TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(self.trees).cast("long").alias("number"), "hash")
        self.subroots = tops = _kept(self.tables, tops)
        nodes = nodes.unionByName(tops)
        for level in range(_levels(self.trees)):
            tops = _kept(self.tables, _parents(tops, level))
            nodes = nodes.unionByName(tops)
        self.nodes, self.root = nodes, tops

    def close(self) -> None:
        release(*self.tables)

    def _by_part(self, nodes: DataFrame | None, run, schema: str) -> DataFrame:
        """run over each leaf partition: its groups (kind 0), these nodes (kind 1), then its leaves (kind 2)."""
        rows = self.groups.select("part", F.lit(0).alias("kind"), "tree", "first", "n", "at", "number")
        if nodes is not None:
            rows = rows.unionByName(nodes.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        rows = rows.unionByName(self.leaves.select("part", F.lit(2).alias("kind"), "row", "id", "grp", "hash", "other"), allowMissingColumns=True)
        dealt = rows.withColumn("trees", F.lit(self.trees).cast("long")).repartitionById(self.parts, F.col("part")).sortWithinPartitions("part", "kind", "row")
        return dealt.mapInArrow(lean(run), schema)

    def proofs(self) -> DataFrame:
        """(id, grp, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf."""
        whole = self.groups.groupBy("part").agg(F.min("tree").alias("at"), F.count(F.lit(1)).alias("n")).select("part", F.lit(_TOP).cast("long").alias("tree"), "at", "n", F.lit(self.trees).cast("long").alias("number"))
        wanted = self.groups.select("part", "tree", "at", "n", "number").unionByName(whole).mapInArrow(lean(_wanted), "part int, tree long, level int, idx long")
        fetched = wanted.join(self.nodes.select("tree", "level", "idx", "hash"), ["tree", "level", "idx"])
        return self._by_part(fetched, _proofs, _PROOF)


def proved(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, other: Column | None = None, part_rows: int = 32_768) -> DataFrame:
    """Per row of docs: the key and the group by their names, leaf, subroot, root, proof_sha256, folded_root and verified.

    The proof is that of the stored table; folded_root is what a verifier gets from it who holds `other` (the hash of a
    changed row) or, where that is null, the row itself.  Null keys come first, rows with equal keys in order of their
    hashes; a null group is one of its own, before the empty name.  Repeated rows are leaves of their own, an empty
    table gives an empty result, columns that are no fields do not count.  At most part_rows leaves (about) meet in a task.
    """
    forest = Forest(docs, key, group, fields, other, part_rows)
    if not forest.rows:
        forest.close()
        out = docs.sparkSession.createDataFrame([], _PROOF)
    else:
        out = forest.proofs()
    return out.withColumnsRenamed({"id": key, "grp": group})


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per group of docs: its name, n_leaves, subroot and the table's root: what is kept to verify rows later.

    Without proofs no leaf partition fetches anything.  Null and repeated rows as in proved(); an empty table has none.
    """
    forest = Forest(docs, key, group, fields)
    schema = "grp string, n_leaves long, subroot string, root string"
    if not forest.rows:
        forest.close()
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("grp", group)
    names = forest.groups.where("at = 0").select("tree", "name", F.col("number").alias("n_leaves"))
    root = forest.root.select(F.lower(F.hex("hash")).alias("root"))  # one row
    out = names.join(forest.subroots.select(F.col("idx").alias("tree"), F.lower(F.hex("hash")).alias("subroot")), "tree").crossJoin(F.broadcast(root))
    return out.select(F.when(F.col("name") != "", F.expr("substring(name, 2)")).alias(group), "n_leaves", "subroot", "root")


def audited(docs: DataFrame) -> DataFrame:
    """The rows of documents proved, where every fifth (by the CRC-32 of doc_id) is tampered with: its text's A-Z in lower case.

    A null doc_id counts as an empty text in the CRC; a null text stays null.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    changed = leaf_hash(*[F.col(f) if f != "text" else F.translate(F.col(f).cast("string"), upper, lower) for f in FIELDS])
    return proved(docs, other=F.when(tampered, changed)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
