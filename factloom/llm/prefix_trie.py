"""The prefix trie of rebuilt conversations, by whole-sequence collapse.

1. A turn becomes the digest of its role and text; turns are ranked by range within their conversations, so that even a
   conversation that holds a third of all rows is spread.
2. Each conversation is rebuilt; a prefix is known by its length and the exclusive or of keyed hashes of its turns and
   their places (two of 64 bits), so prefixes of one conversation are running sums, in blocks of turns.
3. Identical rebuilt conversations collapse into one weighted sequence with its list of ends.
4. Sequences that are a proper prefix of another go by an anti-join; those left are the leaves.
5. Weighted prefixes of the sequences are aggregated to nodes.  Each node is counted once for its subtree, on one of the
   leaves below it, as a suffix sum along that leaf.

All but the hashing of end lists is DataFrame code; that streams through sorted blocks of ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, placed, release, shuffle_width

BLOCK = 4096  # turns of a conversation that are summed in one window
_NODE = ("depth", "p1", "p2")


def n_words(text: Column) -> Column:
    """How many words [^\\x20\\x09-\\x0D]+ a text has, without a list of them."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", "")).cast("long")


def _running(df: DataFrame, key: str, place: str, values: dict[str, str], combine, down: bool = False, ties: bool = False) -> DataFrame:
    """df with the running value of each of `values` (column to new name) over the rows of a key in order of place (from 0).

    Within blocks of BLOCK places by a window, and over the blocks by another with a row a block; down: from the last
    place to the first.  With ties, rows of one place all get the value that includes the others.  df is read twice.
    """
    block = F.floor(F.col(place) / BLOCK)
    rows = df.withColumn("_block", block)
    within = Window.partitionBy(key, "_block").orderBy(F.desc(place) if down else F.asc(place))
    within = within.rangeBetween(Window.unboundedPreceding, 0) if ties else within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({new: combine(old).over(within) for old, new in values.items()})
    # the last place of a block has its whole value; only keys with more than one block have something to hand on
    full = df.withColumn("_block", block).join(df.where(F.col(place) == BLOCK).select(key).distinct(), key, "left_semi")
    blocks = full.groupBy(key, "_block").agg(*[combine(old).alias(f"_{new}") for old, new in values.items()])
    over = Window.partitionBy(key).orderBy(F.desc("_block") if down else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(key, "_block", *[combine(f"_{new}").over(over).alias(f"_{new}") for new in values.values()])
    merged = rows.join(bases, [key, "_block"], "left")
    add = (lambda a, b: a + b) if combine is F.sum else (lambda a, b: a.bitwiseXOR(b))
    return merged.withColumns({new: add(F.col(new), F.coalesce(F.col(f"_{new}"), F.lit(0))) for new in values.values()}).drop("_block", *[f"_{n}" for n in values.values()])


def rebuilt(conversations: DataFrame, span: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, turn digest t, words) of every rebuilt conversation, and all conv_id.

    With h the CRC-32 of the decimal conv_id modulo `most`, a conversation takes the first h turns of conversation
    conv_id - conv_id % span, then its own turns after its first h.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = cut(
        conversations.where("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("t"), n_words(text).alias("words"),
        )
    )
    rows, segments = placed(turns, ["conv_id"], ["turn", "t"], shuffle_width(spark))
    release(turns)
    ids = segments.where("at = 0").select("conv_id")
    donors = rows.where(F.col("conv_id") % span == 0).join(segments.where(F.col("at") < most - 1), ["part", "conv_id"])
    donors = donors.withColumn("place", F.col("row") - F.col("first") + F.col("at")).where(F.col("place") < most - 1).select(F.col("conv_id").alias("donor"), "place", "t", "words")
    donors = cut(donors)  # at most 3 turns of every 20th conversation
    held = donors.groupBy("donor").agg(F.count(F.lit(1)).alias("given"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    wide = segments.withColumn("h", head).withColumn("donor", F.col("conv_id") - F.col("conv_id") % span).join(held, "donor", "left")
    wide = wide.withColumn("given", F.least("h", F.coalesce("given", F.lit(0)))).select("part", "conv_id", "first", "at", "h", "given")
    own = rows.join(wide, ["part", "conv_id"]).withColumn("place", F.col("row") - F.col("first") + F.col("at")).where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "t", "words")
    taken = ids.withColumn("h", head).withColumn("donor", F.col("conv_id") - F.col("conv_id") % span).join(donors, "donor").where("place < h")
    return own.unionByName(taken.select("conv_id", "place", "t", "words")), ids


def _blocks_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, p1, p2, first, ids) from sorted rows: runs of conv_ids of one sequence, comma-joined."""
    key, ids, done, size = None, [], [], 0

    def out() -> pa.RecordBatch:
        rows = list(zip(*done, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:4]), pa.array(rows[4], pa.string())], [*_NODE, "first", "ids"])

    for batch in batches:
        for *now, conv in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv_id")), strict=True):
            if ids and (now != key or len(ids) == 8192):
                done.append((*key, ids[0], ",".join(map(str, ids))))
                size, ids = size + len(ids), []
                if size >= 65_536:
                    yield out()
                    done.clear()
                    size = 0
            key = now
            ids.append(conv)
    if ids:
        done.append((*key, ids[0], ",".join(map(str, ids))))
    yield out()


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, p1, p2, ends): SHA-256 over the blocks of a sequence, which come in order; only the state is held."""
    key, state, done = None, None, []

    def out() -> pa.RecordBatch:
        rows = list(zip(*done, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.string())], [*_NODE, "ends"])

    for batch in batches:
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
            if now != key:
                if state is not None:
                    done.append((*key, state.hexdigest()))
                key, state = now, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(done) >= 4096:
            yield out()
            done.clear()
    if state is not None:
        done.append((*key, state.hexdigest()))
    yield out()


def end_lists(convs: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends) from (depth, p1, p2, conv_id): the SHA-256 of the comma-joined sorted ids of each sequence.

    Ids are sorted by range, so those of a hot sequence lie in many tasks; its blocks of 8,192 ids are then streamed.
    """
    width = shuffle_width(convs.sparkSession)
    order = [*_NODE, "conv_id"]
    sorted_ids = convs.select(*order).repartitionByRange(width, *order).sortWithinPartitions(*order)
    blocks = sorted_ids.mapInArrow(_blocks_of_ids, "depth long, p1 long, p2 long, first long, ids string")
    return blocks.repartition(width, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_hash_blocks, "depth long, p1 long, p2 long, ends string")


def nodes(conversations: DataFrame, span: int = 20, most: int = 4) -> DataFrame:
    """Per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn (null first), equal ones by the digest of role and text; repeated rows are turns of their own.  A
    null role or text is empty.  A turn without conv_id belongs to no conversation.  An empty table has no node.  A
    conversation may have any number of turns, and a sequence any number of conversations.  Other columns do not count.
    """
    turns, ids = rebuilt(conversations, span, most)
    keyed = cut(turns.select("conv_id", "place", F.xxhash64(F.lit(11), "place", "t").alias("z1"), F.xxhash64(F.lit(23), "place", "t").alias("z2"), "words"))
    prefixes = _running(keyed, "conv_id", "place", {"z1": "p1", "z2": "p2"}, F.bit_xor)
    prefixes = cut(prefixes.select("conv_id", (F.col("place") + 1).alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("z1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("z2")).alias("q2"), "words"))
    release(keyed)
    zero = F.lit(0).cast("long")
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("last"))
    convs = cut(ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"last.{c}", zero).alias(c) for c in _NODE]))

    # identical conversations as one weighted sequence, known by its smallest conv_id
    sequences = cut(convs.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")))
    own = sequences.select("conv_id", "weight", F.col("depth").alias("length"))
    along = prefixes.join(own, "conv_id").unionByName(
        own.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), zero.alias("words"), "weight", "length")
    )
    along = cut(along)
    proper = along.where("depth < length").select(*_NODE).distinct()
    leaves = cut(sequences.join(proper, [*_NODE], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf")))
    marked = along.join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", zero))

    counted = cut(
        marked.groupBy(*_NODE).agg(
            F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.max("words").alias("words"),
            F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"),
        )
    )
    # what each node saves, once, on the leaf that owns it; then the sums from each depth of a leaf to its end
    saved = counted.select(F.col("owner").alias("conv_id"), *_NODE, ((F.col("n_convs") - 1) * F.col("words")).alias("own"), F.lit(0).alias("on_path"))
    path = marked.where("leaf = 1").select("conv_id", *_NODE, zero.alias("own"), F.lit(1).alias("on_path"))
    summed = cut(path.unionByName(saved))
    below = _running(summed, "conv_id", "depth", {"own": "saved"}, F.sum, down=True, ties=True).where("on_path = 1")

    null = F.lit(None).cast("long")
    fields = {"conv_id": null, "n_convs": null, "q1": null, "q2": null, "n_leaves": null, "n_children": null, "saved_tokens": null, "ends": F.lit(None).cast("string")}
    put = lambda df, **have: df.select(*_NODE, *[have.get(k, v).alias(k) for k, v in fields.items()])
    children = counted.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    parts = [
        put(counted, **{c: F.col(c) for c in ("conv_id", "n_convs", "q1", "q2", "n_leaves")}),
        put(children, n_children=F.lit(1).cast("long")),
        put(below, saved_tokens=F.col("saved")),
        put(end_lists(convs), ends=F.col("ends")),
    ]
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    whole = cut(
        union.groupBy(*_NODE).agg(
            *[F.max(c).alias(c) for c in ("conv_id", "n_convs", "q1", "q2", "n_leaves", "ends")], F.coalesce(F.sum("n_children"), zero).alias("n_children"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens")
        )
    )
    parents = whole.where("n_children > 0 and depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    root = F.broadcast(whole.where("depth = 0").select(F.col("conv_id").alias("root_conv_id")))  # one row at most
    found = whole.join(parents, ["depth", "q1", "q2"], "left").crossJoin(root)
    parent = F.when(F.col("depth") == 1, F.col("root_conv_id")).otherwise(F.col("parent_conv_id"))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))
