"""Scans, lookups, optional filters, paging, set operations and keyed writes over snapshots.

A write is a function from the old snapshot to the new one; the caller overwrites or versions the table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, **equal) -> DataFrame:
    """Rows with these values; None and '' mean no filter, and no filter reaches the plan."""
    for column, value in equal.items():
        if value is not None and value != "":
            df = df.where(F.col(column) == F.lit(value))
    return df


def lookup(df: DataFrame, key: str, values: Iterable | DataFrame) -> DataFrame:
    """Rows with one of the ids, given as a short list or as a table (then by a semi-join)."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(key)).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(list(values)))


def in_range(df: DataFrame, column: str, start=None, end=None, closed: bool = False) -> DataFrame:
    """[start, end), or [start, end] when closed; None leaves a side open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end) if closed else F.col(column) < F.lit(end))
    return df


def equal_fold(a: Column, b: Column) -> Column:
    """P4"""
    return F.lower(a) == F.lower(b)


def contains_fold(column: Column, q: str) -> Column:
    """`%` and `_` in q are wildcards."""
    return column.ilike(f"%{q}%") if q else F.lit(True)


def has_tag(json_tags: Column, tag: str) -> Column:
    """The tag is an element of a JSON array of strings."""
    return F.coalesce(F.array_contains(F.from_json(json_tags, "array<string>"), tag), F.lit(False))


def clamp(limit: int | None, offset: int | None, default: int = 100, most: int = 200) -> tuple[int, int]:
    """P25"""
    limit = default if not isinstance(limit, int) or limit < 1 else min(limit, most)
    return limit, max(0, offset or 0)


def page(df: DataFrame, *order: Column | str, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page in a total order (the last key should be unique); one TakeOrdered, no global sort."""
    limit, offset = clamp(limit, offset)
    out = df.orderBy(*order)
    return out.offset(offset).limit(limit) if offset else out.limit(limit)


def cursor(offset: int) -> str:
    """R16"""
    return base64.urlsafe_b64encode(str(offset).encode()).decode().rstrip("=")


def read_cursor(text: str) -> int:
    if not text:
        return 0
    value = int(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    if value < 0:
        raise ValueError("a cursor is no negative offset")
    return value


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in that order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed append: rows whose key is new, each key once."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those with their key."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in `keys` go."""
    return table.join(keys, keys.columns, "left_anti")


def update(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The values where the condition holds."""
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def update_from(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The other columns of `rows` replace those of matching rows."""
    changed = [c for c in rows.columns if c not in keys]
    new = rows.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in changed])
    joined = table.join(new, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in table.columns])


def zip_rows(df: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays as rows."""
    return df.select(F.explode(F.arrays_zip(*arrays)).alias("z")).select("z.*")


def id_kinds(ids: DataFrame, facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Each id with its kind; a fact wins over a concept."""
    both = facts.select(F.col("fact_id").alias("id"), F.lit("fact").alias("kind")).unionByName(concepts.select(F.col("concept_id").alias("id"), F.lit("concept").alias("kind")))
    return latest(both.join(ids.select("id").distinct(), "id", "left_semi"), ["id"], F.desc("kind"))


def ancestors(tree: DataFrame, start: int | str, most: int = 100) -> DataFrame:
    """The chain from the root to a node: (id, depth), depth 0 at the node itself."""
    return tree.sparkSession.sql(
        """WITH RECURSIVE up(id, parent_id, depth) AS (
          SELECT id, parent_id, 0 FROM {tree} WHERE id = :start
          UNION ALL
          SELECT t.id, t.parent_id, u.depth + 1 FROM up u JOIN {tree} t ON t.id = u.parent_id WHERE u.depth < :most AND u.parent_id IS NOT NULL
        ) SELECT id, min(depth) AS depth FROM up GROUP BY id ORDER BY depth DESC""",
        args={"start": start, "most": most}, tree=tree,
    )


def valid_parent(tree: DataFrame, node, parent) -> bool:
    """The parent exists, is not the node itself and no descendant of it."""
    if parent is None:
        return True
    if node == parent or tree.where(F.col("id") == F.lit(parent)).isEmpty():
        return False
    return ancestors(tree, parent).where(F.col("id") == F.lit(node)).isEmpty()


def fact_order(by_sources: bool) -> list[Column]:
    """Facts with most sources first where asked (unknown counts last), then the newest."""
    return [*([F.desc_nulls_last("source_count")] if by_sources else []), F.desc("created_at")]


def part_order() -> list[Column]:
    """Pages before all else, then by page number (none last), then by position."""
    return [F.when(F.col("kind") == "page", 0).otherwise(1), F.asc_nulls_last("page_number"), F.asc("position")]


def lateral_counts(outer: DataFrame, inner: DataFrame, keys: list[str], **counts: Column) -> DataFrame:
    """Aggregates of the inner rows of each outer row; counts are 0 where there is none, other aggregates null."""
    per = inner.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()])
    joined = outer.join(per, keys, "left")
    zero = [n for n, c in counts.items() if "count" in str(c)]
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in zero})


def lengths(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Rows and the shortest and longest text of each class."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(F.length(text)).alias("shortest"), F.max(F.length(text)).alias("longest"))


def search_any(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle in any of the columns, in whatever case; an empty needle matches all."""
    hit = F.lit(needle == "")
    for c in columns:
        hit = hit | F.coalesce(contains_fold(F.col(c), needle), F.lit(False))
    return df.where(hit)


def valid_parents(tree: DataFrame, moves: DataFrame, most: int = 10_000) -> DataFrame:
    """T44 for many moves at once: (node, parent, valid); a parent is valid if it is null, or exists, is not the node and no descendant of it.

    tree: (id, parent_id), without cycles.  All moves climb from their parents to the roots together, a level a join.
    """
    up = tree.select(F.col("id").alias("at"), F.col("parent_id").alias("next"))
    asked = moves.select("node", "parent").distinct()
    met = asked.where("parent is not null").join(up, F.col("parent") == F.col("at"), "left")
    state = _stored(met.select("node", "parent", "next", F.col("at").isNotNull().alias("exists"), F.coalesce(F.col("at") == F.col("node"), F.lit(False)).alias("below")))
    for _ in range(most):
        if state.where("next is not null and not below").isEmpty():
            break
        met = state.withColumnRenamed("next", "here").join(up, F.col("here") == F.col("at"), "left")
        below = F.col("below") | F.coalesce(F.col("here") == F.col("node"), F.lit(False))
        state = _stored(met.select("node", "parent", F.when(~below, F.col("next")).alias("next"), "exists", below.alias("below")))
    else:
        raise RuntimeError("the tree is deeper than that")
    told = state.select("node", "parent", (F.col("exists") & ~F.col("below")).alias("valid"))
    return told.unionByName(asked.where("parent is null").withColumn("valid", F.lit(True)))


def _stored(df: DataFrame) -> DataFrame:
    from .graph import _saved

    return _saved(df)
