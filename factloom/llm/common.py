"""What the training-data operators share: shared-folder tables, text buffers, bounded caches and key columns."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A missing doc_id counts as one identifier above all others.
NO_ID = 2**63 - 1

_made: dict[str, SparkSession] = {}
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Where that is unset a local session gets a folder of its own; on a cluster, whose machines share no such folder, it
    is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dirs.setdefault(context.applicationId, "")
        if not base:
            base = _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that later plans start from files that outlive any executor.

    Unlike DataFrame.checkpoint() this computes df once.  The folder is deleted by release() or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._stored = path
    return back


def release(*tables: DataFrame | None) -> None:
    """Delete the folders behind these results of cut(); other tables (and None) are left alone."""
    for df in tables:
        _delete(getattr(df, "_stored", None))


def _delete(path: str | None) -> None:
    spark = _made.pop(path, None)
    if spark is None:
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


@atexit.register
def _delete_all() -> None:
    for path in list(_made):
        _delete(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; at its end a worker, which Spark keeps for later tasks, gives its free memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def positional(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called _0, _1, ..., so that no name of the caller meets one of an operator, and the new names of `used`."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), {c: names[docs.columns.index(c)] for c in used if c in docs.columns}


def named_back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df, whose columns include those of positional(docs), with the columns of docs alone and their names."""
    return df.select(*[F.col(f"_{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)


def id_key(column: str = "doc_id") -> Column:
    """doc_id as a long without null: a missing one sorts last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value written as text, modulo n; of an empty text where it is null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte array with all texts of an Arrow string column back to back, and the n + 1 offsets; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds few bytes of text (or a single row): bounds the memory of what follows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


class Cache(dict):
    """A dict of bytes to bytes (or a number) that fills itself by make(key) and is emptied before it takes `most_bytes`."""

    def __init__(self, make, most_bytes: int = 48 << 20) -> None:
        super().__init__()
        self.make, self.most, self.size = make, most_bytes, 0

    def __missing__(self, key):
        value = self.make(key)
        size = 200 + len(key) + (len(value) if isinstance(value, bytes) else 0)  # two objects and a slot of the table
        if self.size + size > self.most:
            self.clear()
            self.size = 0
        if size <= self.most:
            self[key] = value
            self.size += size
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = np.asarray(x, np.uint64)
    if not x.ndim:  # numpy warns of overflow in scalars alone
        return mix(x[None])[0]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ASCII white space, as bytes.split() has it.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHORT = 40  # symbols up to which words are hashed together, one symbol of all of them at a time


def words_in(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts lie that stand back to back in `data` (see buffers()): starts, ends, and their number by text."""
    inside = ~breaks[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if len(data):
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]  # no word crosses from one text to the next
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, offsets))


def word_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; symbols: bytes, or 64-bit hashes of larger symbols."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, sizes = start[order], length[order]
    h = sizes.astype(np.uint64)
    long = int(np.searchsorted(-sizes, -_SHORT, "left"))
    of = (lambda x: _SYMBOLS[x]) if symbols.dtype == np.uint8 else (lambda x: x)
    for j in range(int(sizes[long]) if long < len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -j, "left"))  # words that have a symbol j
        h[long:n] = h[long:n] * _STEP + of(symbols[at[long:n] + j])
    if long:
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(sizes[0]) - 1, _STEP))))
        for i in range(long):
            n = int(sizes[i])
            h[i] += (of(symbols[at[i] : at[i] + n]) * power[:n]).sum(dtype=np.uint64)
    out = np.empty(len(h), np.uint64)
    out[order] = mix(h)
    return out


def placed(df: DataFrame, group: list[str], order: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """df dealt by range and sorted by group and order, with `part` and `row` (its place there), and the segments of the parts.

    A segment is what a part holds of a group: part, the group's columns, first (row), n, at (how many rows of the group
    lie in earlier parts) and total (rows of the group), so a row's place in its group is row - first + at.  Neither a
    group nor rows with equal keys need fit one part: ties are dealt by their place in df, which should be a stored table.
    """
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = spread.repartitionByRange(parts, *group, *order, "_tie").sortWithinPartitions(*group, *order, "_tie").drop("_tie")
    m = F.monotonically_increasing_id()
    rows = cut(dealt.withColumn("m", m).withColumn("part", F.shiftright("m", 33).cast("int")).withColumn("row", F.col("m").bitwiseAND(F.lit(2**33 - 1))).drop("m"))
    held = rows.groupBy("part", *group).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*group)  # at most a row for each part
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, cut(held.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(own)))


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def classes(docs: DataFrame) -> DataFrame:
    """Equal texts as one row: c1, c2 (two hashes of the text, together its key), first_id (smallest id_key) and text.

    Copies meet map-side first, so a text that a third of all rows share costs one row per input split.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(id_key().alias("id"), text.alias("text")).select("id", "text", *class_key())
    return rows.groupBy("c1", "c2").agg(F.min("id").alias("first_id"), F.first("text").alias("text"))


def class_key(text: str = "text") -> tuple[Column, Column]:
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.xxhash64(plain).alias("c1"), F.hash(plain, F.octet_length(plain)).alias("c2")


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that repartition(n, column) deals to n different partitions."""
    if n == 1:
        return [0]
    rows = spark.range(0, 40 * n + 400, 1, 1).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
    found = {r.p: r.k for r in rows.groupBy("p").agg(F.min("k").alias("k")).collect()}
    return [found.get(p, p) for p in range(n)]


def six_bytes(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of unsigned integers, as bytes; eight_bytes() gives them back."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def eight_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = x.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def pack_arrays(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays in one compressed string; unpack_arrays() gives them back."""
    import zstandard

    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), a.nbytes))], "<i8")
    return zstandard.compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), level)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 * (2 * n + 1), []
    for code, size in head.reshape(-1, 2).tolist():
        kind = np.dtype(chr(code))
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count values each."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
