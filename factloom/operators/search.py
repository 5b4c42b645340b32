"""Full text, vector and fused search.

The full-text tier is T1: ASCII words and digits (letters beyond ASCII kept), lower-cased, English stop words removed,
no stemming unless `stem=True`, which strips plural and verb endings by rule (T2, not a Snowball stemmer).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .graph import _saved

# English stop words.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
# Weights of the labels D, C, B, A.
LABEL_WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}
RRF_K = 60
_WORD = r"([a-z0-9\x{80}-\x{10FFFF}]+)"


def tokens(text: Column) -> Column:
    """All words in order, stop words included (they count as positions)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), 1)


def stemmed(word: Column) -> Column:
    word = F.when(word.rlike("[^s]s$") & (F.length(word) > 3), F.regexp_replace(word, "(?:ies)$", "y")).otherwise(word)
    word = F.when(F.length(word) > 3, F.regexp_replace(word, "(?<=[^su])s$", "")).otherwise(word)
    return F.when(F.length(word) > 5, F.regexp_replace(word, "(?:ing|ed)$", "")).otherwise(word)


def lexemes(text: Column, stem: bool = False) -> Column:
    """array<struct<lexeme,pos>> without stop words; positions count from 1."""
    words = F.transform(tokens(text), lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("pos")))
    kept = F.filter(words, lambda x: ~x["lexeme"].isin(*STOP_WORDS))
    return F.transform(kept, lambda x: F.struct(stemmed(x["lexeme"]).alias("lexeme"), x["pos"].alias("pos"))) if stem else kept


def postings(df: DataFrame, key: str, text: Column, label: str = "D", stem: bool = False) -> DataFrame:
    """The index as a table: (key, lexeme, positions, label); partition or bucket it by lexeme.

    A row's lexemes are sorted and cut into runs within the row, so nothing is shuffled; rows with equal keys stay apart.
    """
    lex = F.sort_array(lexemes(text, stem))
    rows = df.select(key, lex.alias("_l")).where(F.size("_l") > 0)
    rows = rows.select(key, "_l", F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: (i == 0) | (F.col("_l")[i]["lexeme"] != F.col("_l")[F.greatest(i - 1, F.lit(0))]["lexeme"])).alias("_at"))
    ends = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.size("_l")))
    runs = F.zip_with("_at", ends, lambda a, b: F.struct(F.col("_l")[a]["lexeme"].alias("lexeme"), F.transform(F.slice("_l", a + 1, b - a), lambda x: x["pos"]).alias("positions")))
    return rows.select(key, F.explode(runs).alias("r")).select(key, "r.lexeme", "r.positions", F.lit(label).alias("label"))


Tree = tuple


def parse_query(q: str) -> Tree | None:
    """words are ANDed, "quoted words" are a phrase, `or` joins alternatives, a leading `-` excludes; None matches all."""
    clauses: list[list[Tree]] = []
    join = False
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', q or ""):
        minus, raw = (m[1], m[2]) if m[2] is not None else (m[3], m[4])
        if m[2] is None and raw.lower() == "or" and not minus:
            join = bool(clauses)
            continue
        words = [w for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", raw.lower())]
        kept = [(i, w) for i, w in enumerate(words) if w not in STOP_WORDS]
        if not kept:
            continue
        node: Tree = ("word", kept[0][1]) if len(kept) == 1 else ("phrase", tuple(kept))
        if minus:
            node = ("not", node)
        if join:
            clauses[-1].append(node)
        else:
            clauses.append([node])
        join = False
    ands = [c[0] if len(c) == 1 else ("or", tuple(c)) for c in clauses]
    return None if not ands else ands[0] if len(ands) == 1 else ("and", tuple(ands))


def matches(lex: Column, tree: Tree | None, stem: bool = False) -> Column:
    """Does an array of lexemes fulfil the query?"""
    if tree is None:
        return F.lit(True)
    word: Callable = (lambda w: stemmed(F.lit(w))) if stem else F.lit
    kind, arg = tree
    if kind == "word":
        return F.exists(lex, lambda x: x["lexeme"] == word(arg))
    if kind == "not":
        return ~matches(lex, arg, stem)
    if kind == "phrase":
        first = arg[0]

        def follows(x: Column, w: str, gap: int) -> Column:
            return F.exists(lex, lambda y: (y["lexeme"] == word(w)) & (y["pos"] == x["pos"] + gap))

        return F.exists(lex, lambda x: (x["lexeme"] == word(first[1])) & _all(follows(x, w, i - first[0]) for i, w in arg[1:]))
    parts = [matches(lex, t, stem) for t in arg]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if kind == "and" else out | p
    return out


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def words_of(tree: Tree | None) -> list[str]:
    if tree is None or tree[0] == "not":
        return []
    if tree[0] == "word":
        return [tree[1]]
    return [w for _, w in tree[1]] if tree[0] == "phrase" else [w for t in tree[1] for w in words_of(t)]


def full_text(df: DataFrame, text: Column, q: str, stem: bool = False) -> DataFrame:
    """rows that match, with `rank`: the weighted number of query words, damped by 1 / position count.

    rank is compatible in order with a term-frequency rank, not in value.
    """
    tree = parse_query(q)
    lex = lexemes(text, stem)
    wanted = words_of(tree)
    rank = F.lit(0.0) if not wanted else F.size(F.filter(lex, lambda x: x["lexeme"].isin(*wanted))) * F.lit(LABEL_WEIGHTS["D"])
    return df.where(matches(lex, tree, stem)).withColumn("rank", rank.cast("double"))


def by_postings(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    """F2 over an index: keys that have every word; the lexeme filter prunes a bucketed index."""
    wanted = list(dict.fromkeys(words))
    return index.where(F.col("lexeme").isin(wanted)).groupBy(key).agg(F.count_distinct("lexeme").alias("n")).where(F.col("n") == len(wanted)).select(key)


def cover_density(lex: Column, words: list[str], weight: float = LABEL_WEIGHTS["A"]) -> Column:
    """the sum over minimal covers of all words of weight * words / extent; one word: its weight per occurrence."""
    wanted = sorted(set(words))
    if not wanted:
        return F.lit(0.0)
    if len(wanted) == 1:
        return (F.size(F.filter(lex, lambda x: x["lexeme"] == wanted[0])) * F.lit(weight)).cast("double")

    @F.pandas_udf("double")
    def covers(rows: pd.Series) -> pd.Series:
        def one(row) -> float:
            at = sorted((x["pos"], x["lexeme"]) for x in row if x["lexeme"] in wanted)
            total, last, begin = 0.0, {}, -1
            for pos, word in at:
                last[word] = pos
                if len(last) == len(wanted) and min(last.values()) > begin:
                    begin = min(last.values())
                    total += weight * len(wanted) / max(1, pos - begin + 1)
            return total

        return rows.map(one)

    return covers(lex)


# ---- J15, V3 - V5: nearest neighbours -------------------------------------------------------------------------------


def neighbours(queries: DataFrame, items: DataFrame, k: int, minimum: float = -1.0, exclude_self: bool = True, repository: str | None = None, block: int | None = None) -> DataFrame:
    """Exact top-k by cosine: (query_id, id, score, rank); ties by id.

    Equal vectors meet once: each different one of the items stands for its smallest ids, as many as can be among the k
    best, and what it finds holds for all queries that have it.  The different ones are dealt to blocks; each pair of
    blocks is one group, worked through in matrix products, and only its best per vector go on.
    """
    k = max(1, k)
    wanted = k + 1 if exclude_self else k
    own = ["_h", "_g"] + ([repository] if repository else [])  # a vector is known by 128 bits
    keyed = lambda df: df.where("embedding is not null").withColumns({"_h": F.xxhash64("embedding"), "_g": F.xxhash64(F.lit(7), "embedding")})
    asked = keyed(queries.select("id", "embedding", *own[2:]))
    first = F.row_number().over(Window.partitionBy(*own).orderBy("id"))
    some = keyed(items.select("id", "embedding", *own[2:])).withColumn("_n", first).where(F.col("_n") <= wanted)
    some = _saved(some.groupBy(*own).agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("embedding").alias("embedding")))
    different = _saved(asked.groupBy(*own).agg(F.first("embedding").alias("embedding")))
    kind = items.schema["id"].dataType.simpleString()
    repo = f", {repository} {queries.schema[repository].dataType.simpleString()}" if repository else ""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.assign(_first=[x[0] for x in right["ids"]]).sort_values("_first", kind="stable", ignore_index=True)
        found = [left.loc[i, own].reset_index(drop=True).assign(ids=right["ids"].to_numpy()[j], score=score) for i, j, score in _products(left, right, minimum, wanted, repository)]
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in (*own, "ids", "score")})

    found = _in_blocks(different, some, F.col("_h"), F.col("_h"), meet, f"_h long, _g long{repo}, ids array<{kind}>, score double", block)
    # of each vector the best others, in order of score and smallest id; each query takes the ids from them
    w = Window.partitionBy(*own).orderBy(F.desc(F.round("score", 9)), F.col("ids")[0])
    best = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= wanted).groupBy(*own).agg(F.collect_list(F.struct("score", "ids")).alias("best"))
    met = asked.select(F.col("id").alias("query_id"), *own).join(best, own).select("query_id", F.explode("best").alias("b"))
    met = met.select("query_id", F.explode("b.ids").alias("id"), F.col("b.score").alias("score"))
    return _ranked(met.where("query_id <> id") if exclude_self else met, k)


def pairs_above(items: DataFrame, minimum: float, block: int | None = None, thin: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """All (query_id, id, score) of different items at or above the threshold, both ways.

    thin, on (query_id, id, score) with query_id < id, keeps of the pairs of a strip, then of those kept in a pair of
    blocks, what the caller needs of them; then each pair comes once, the smaller id first.
    """
    kind = items.schema["id"].dataType.simpleString()
    rows = items.where("embedding is not null").select("id", "embedding")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        found = []
        for i, j, score in _products(left, right, minimum):
            met = pd.DataFrame({"query_id": a[i], "id": b[j], "score": score})
            met = met[met["query_id"] != met["id"]]
            found.append(met if thin is None else thin(met[met["query_id"] < met["id"]]))
        met = pd.concat(found, ignore_index=True) if found else pd.DataFrame({"query_id": [], "id": [], "score": []})
        return met if thin is None else thin(met)

    return _in_blocks(rows, rows, F.xxhash64("id"), F.xxhash64("id"), meet, f"query_id {kind}, id {kind}, score double", block)


def _in_blocks(left: DataFrame, right: DataFrame, by_left: Column, by_right: Column, meet: Callable, schema: str, block: int | None) -> DataFrame:
    """meet(left rows, right rows) for each pair of blocks, to which rows are dealt by a hash.

    Up to 8 blocks a side of 1,024 rows or more, then blocks of 65,536, so each row is sent at most N / 65,536 times.
    """

    def number(df: DataFrame) -> int:
        n = df.count()
        return max(1, -(-n // (block or min(65_536, max(1024, -(-n // 8))))))

    n_l, n_r = number(left), number(right)
    own = lambda by, n: F.pmod(by, F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = left.withColumn("_lb", own(by_left, n_l)).withColumn("_rb", every(n_r))
    y = right.withColumn("_rb", own(by_right, n_r)).withColumn("_lb", every(n_l))
    y = y.toDF(*[f"{c}_" for c in y.columns])  # both sides may be one table
    both = lambda a, b: meet(a, b.rename(columns=lambda c: c[:-1])) if len(a) and len(b) else meet(a.iloc[:0], b.iloc[:0].rename(columns=lambda c: c[:-1]))
    return x.groupBy("_lb", "_rb").cogroup(y.groupBy("_lb_", "_rb_")).applyInPandas(both, schema)


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a mask in which little is set: it looks at 8 places at once."""
    if mask.shape[1] % 8:
        at = np.flatnonzero(mask)
    else:
        words = np.flatnonzero(mask.ravel().view(np.uint64) != 0)
        word, bit = np.nonzero(mask.reshape(-1, 8)[words])
        at = words[word] * 8 + bit
    return np.divmod(at, mask.shape[1])


def _products(left: pd.DataFrame, right: pd.DataFrame, minimum: float, k: int | None = None, repository: str | None = None, strip: int = 512, span: int = 1024, probed: bool = False):
    """(i, j, score) by strips of left rows: the pairs of rows (embedding) with a score at or above minimum, or for each i the k best of them.

    Equal scores (to 9 digits) go by the order of the right rows.  Products in single precision find what may be wanted,
    within their rounding error; the scores are computed in double precision.  Vectors of unlike lengths do not meet.
    A tile of strip times span products stays in a core's cache; what it finds is ranked once it is twice what is kept.
    probed: a left row meets those right rows alone whose `cell` is among its `cells`; a strip passes over what none of it
    meets.  Not together with repository.
    """
    minimum = max(minimum, -1.0)
    la, lb = (np.array([len(v) for v in df["embedding"]], np.int64) for df in (left, right))
    for width in np.intersect1d(la, lb):
        rows, others = np.flatnonzero(la == width), np.flatnonzero(lb == width)
        if not width:
            continue
        b = np.array(right["embedding"].iloc[others].tolist(), np.float64)
        nb = np.linalg.norm(b, axis=1)
        units = (b / np.where(nb > 0, nb, 1)[:, None]).astype(np.float32)
        codes = pd.factorize(pd.concat([left[repository].iloc[rows], right[repository].iloc[others]]))[0] if repository else None
        cells, cell = np.unique(right["cell"].to_numpy()[others], return_inverse=True) if probed else (None, None)
        place_of = np.full(cells[-1] + 1, -1) if probed else None  # of a cell's number among those of the right rows
        if probed:
            place_of[cells] = np.arange(len(cells))
        slack = np.float32(1e-7 * width + 1e-6)
        every = others, units, nb, cell, b
        tile = np.empty((strip, span), np.float32)
        for start in range(0, len(rows), strip):
            mine = rows[start : start + strip]
            a = np.array(left["embedding"].iloc[mine].tolist(), np.float64)
            na = np.linalg.norm(a, axis=1)
            u = (a / np.where(na > 0, na, 1)[:, None]).astype(np.float32)
            least = np.full(len(mine), minimum, np.float32) - slack
            others, units, nb, cell, b = every
            if probed:
                asked = left["cells"].iloc[mine].tolist()
                meets = np.zeros((len(mine), len(cells)), bool)
                to, row = np.concatenate(asked), np.repeat(np.arange(len(mine)), [len(x) for x in asked])
                row, to = row[to < len(place_of)], place_of[to[to < len(place_of)]]
                meets[row[to >= 0], to[to >= 0]] = True
                pool = np.flatnonzero(meets.any(0)[cell])
                if len(pool) < 0.8 * len(others):  # else the copies cost more than they save
                    others, units, nb, cell, b = others[pool], units[pool], nb[pool], cell[pool], b[pool]
            kept = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            fresh, many = [], 0  # found since kept was ranked
            for at in range(0, len(others), span):
                some = units[at : at + span].T
                wide = some.shape[1]
                near = np.matmul(u, some, out=tile) if (len(mine), wide) == tile.shape else u @ some
                zero = nb[at : at + span] == 0
                if zero.any() or not na.all():
                    near[na == 0] = -1
                    near[:, zero] = -1
                if codes is not None:
                    near[codes[start : start + len(mine)][:, None] != codes[len(rows) + at : len(rows) + at + span][None]] = -np.inf
                maybe = near >= least[:, None]
                if k is not None and k < wide and np.count_nonzero(maybe) > 8 * k * len(mine):
                    if probed:
                        near[~meets[:, cell[at : at + span]]] = -np.inf
                    least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k] - 2 * slack)
                    maybe = near >= least[:, None]
                ni, nj = _places(maybe)
                if probed:
                    met = meets[ni, cell[at + nj]]
                    ni, nj = ni[met], nj[met]
                nj = nj + at
                new = np.full(len(ni), -1.0)
                for part in range(0, len(ni), 100_000):
                    p, q = ni[part : part + 100_000], nj[part : part + 100_000]
                    n = na[p] * nb[q]
                    np.divide(np.einsum("ij,ij->i", a[p], b[q]), n, out=new[part : part + 100_000], where=n > 0)
                good = new >= minimum
                fresh.append((ni[good], nj[good], new[good]))
                many += len(fresh[-1][0])
                if k is None or (many < 2 * k * len(mine) and len(kept[0]) and at + span < len(others)) or not many:
                    continue
                i, j, score = (np.concatenate(x) for x in zip(kept, *fresh))
                order = np.lexsort((j, -np.round(score, 9), i))
                i, j, score = i[order], j[order], score[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                full = place == k - 1
                least[i[full]] = np.maximum(least[i[full]], score[full].astype(np.float32) - 2 * slack)
                kept = i[place < k], j[place < k], score[place < k]
                fresh, many = [], 0
            i, j, score = (np.concatenate(x) for x in zip(kept, *fresh))
            yield mine[i], others[j], score


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_search(items: DataFrame, query: list[float], k: int, minimum: float = -1.0) -> DataFrame:
    """V3: (id, score) of the k best for one vector; k <= 0 is 1."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = items.select("id", cosine(F.col("embedding"), q).alias("score")).where(F.col("score") >= minimum)
    return scored.orderBy(F.desc("score"), "id").limit(max(1, k))


# ---- R6 - R9, R13, R14: fusion --------------------------------------------------------------------------------------


def fuse(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) lists with ranks from 0: (id, lex_rank, sem_rank, score, fused).

    Ties by lexical rank (absent last), then semantic rank, then id.
    """
    k = RRF_K if k <= 0 else k
    a = lexical.groupBy("id").agg(F.min("rank").alias("lex_rank"))
    b = semantic.groupBy("id").agg(F.min("rank").alias("sem_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = a.join(b, "id", "full").withColumn("score", part("lex_rank") + part("sem_rank"))
    order = Window.orderBy(F.desc("score"), F.asc_nulls_last("lex_rank"), F.asc_nulls_last("sem_rank"), "id")  # at most two result lists
    return both.withColumn("fused", F.row_number().over(order) - 1)


def over_fetch(limit: int, most: int = 200, times: int = 3) -> int:
    return min(max(limit * times, limit), most)


def hybrid_facts(facts: DataFrame, vectors: DataFrame, q: str, vector: list[float] | None, limit: int = 20, offset: int = 0, k: int = RRF_K, minimum: float = -1.0, status: str | None = "stable", compat_unfiltered: bool = False) -> DataFrame:
    """(id, text, score, fused, search_mode); without a vector the search is lexical alone.

    The semantic channel keeps the status filter unless compat_unfiltered.  facts: (id, text[, status]).
    """
    n = over_fetch(limit + offset)
    wanted = facts if status is None or "status" not in facts.columns else facts.where(F.col("status") == status)
    lex = full_text(wanted, F.col("text"), q).orderBy(F.desc("rank"), "id").limit(n)
    lex = lex.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rank"), "id")) - 1).select("id", "rank")
    if vector is None:
        out = lex.select("id", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.col("rank").alias("fused")).withColumn("search_mode", F.lit("lexical"))
    else:
        pool = vectors if compat_unfiltered else vectors.join(wanted.select("id"), "id", "left_semi")
        sem = vector_search(pool, vector, n, minimum)
        sem = sem.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).select("id", "rank")
        out = fuse(lex, sem, k).select("id", "score", "fused").withColumn("search_mode", F.lit("hybrid"))
    page = out.where((F.col("fused") >= offset) & (F.col("fused") < offset + limit))
    return facts.join(F.broadcast(page), "id").select("id", "text", "score", "fused", "search_mode")  # a page: at most `limit` rows


def hybrid_concepts(concepts: DataFrame, vectors: DataFrame, q: str, vector: list[float], floor: int = 5, k: int = RRF_K, most: int = 500) -> DataFrame:
    """Groups of concepts (name_key, total_fact_count, score), best fused score of each; the lexical list is whole."""
    lex = full_text(concepts, F.col("name"), q)
    lex = lex.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rank"), "id")) - 1).select("id", "rank")
    sem = vector_search(vectors, vector, most)
    sem = sem.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).select("id", "rank")
    fused = fuse(lex, sem, k).select("id", "score")
    rows = concepts.join(fused, "id").groupBy(F.lower("name").alias("name_key")).agg(F.sum("fact_count").alias("total_fact_count"), F.max("score").alias("score"))
    return rows if floor <= 0 else rows.where(F.col("total_fact_count") >= floor)


def merged_queries(hits: DataFrame) -> DataFrame:
    """(query, rank, id) of several queries as one list: each id where it appears first."""
    first = hits.groupBy("id").agg(F.min(F.struct("query", "rank")).alias("at"))
    return first.select("id", F.col("at.query").alias("query"), F.col("at.rank").alias("rank"))


def first_query_with_hits(hits: DataFrame, key: str) -> DataFrame:
    """Per key the hits of its first query that has any; query -1 is the unfiltered list, used last."""
    order = F.when(F.col("query") < 0, F.lit(2**31 - 1)).otherwise(F.col("query"))
    best = F.min(order).over(Window.partitionBy(key))
    return hits.withColumn("_o", order).withColumn("_b", best).where("_o = _b").drop("_o", "_b")
