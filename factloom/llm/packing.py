"""Packing of tokenised documents into fixed-length training sequences.

First-fit decreasing with a tournament tree of bin capacities, run independently in randomised groups of documents.
A document longer than a sequence gives full pieces, which need no partner, and one rest; the rests of a group are
sorted by length and each goes to the first bin with room, found by descending a tree whose inner nodes hold the
largest free capacity below them.  A piece's group is drawn by a seeded hash of its place in the input, and there are
enough groups for the most pieces that the bytes of the corpus can give: whatever its ids, texts and lengths, a group
holds a fair mixture of lengths and at most about `group_pieces` pieces.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, lean, slices

EOS = 2
_END = struct.pack("<I", EOS)
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: The pre-tokens of lower-cased text of which all characters above 127 are letters, as bytes; white space falls out.
_PARTS = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff\s]+")
#: Letters that normalisation and lower-casing leave alone: a to z and the lower-case ones of Latin-1 and Latin Extended-A.
_PLAIN = re.compile("[a-z" + "".join(c for c in map(chr, range(0xDF, 0x17F)) if c.islower()) + "]+")
_tokenizers: dict[str, object] = {}


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write a byte: printable Latin-1 as itself, the others as the letters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTER_OF = _byte_letters()


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class Coder:
    """Texts to ids (little-endian unsigned 32-bit bytes), by a cache of pre-tokens whose bytes are bounded.

    Exact for tokenizers that lower-case, drop white space and then split contractions, letters, single digits and
    marks: the ids of a text are those of its pre-tokens, one after another.  Where a character above 127 is no letter,
    the text is taken chunk by chunk between spaces and a chunk with such a character is encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.merges = self.tokenizer.model.tokenize
        self.known = Cache(self._part, 56 << 20)
        self.whole = Cache(self._encoded, 8 << 20)

    def _encoded(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: bytes) -> bytes | None:
        word = part.decode()
        if part.isascii() and word.isprintable() or _PLAIN.fullmatch(word):
            ids = [t.id for t in self.merges(word if part.isascii() else "".join([_LETTER_OF[b] for b in part]))]
            return struct.pack(f"<{len(ids)}I", *ids)
        return self._encoded(part) if word.isalpha() and word.lower().isalpha() else None

    def ids(self, text: str | None) -> bytes:
        """The ids of one text with the end id, packed."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        get = self.known.__getitem__
        try:
            if b"<|" in raw:
                raise TypeError
            return b"".join([*map(get, _PARTS.findall(raw.lower())), _END])
        except TypeError:  # a special token, or a part that is not plain
            out = []
            for chunk in raw.replace(b"\n", b" ").split(b" "):
                parts = [None] if b"<|" in chunk else [*map(get, _PARTS.findall(chunk.lower()))]
                out.append(self.whole[chunk] if None in parts else b"".join(parts))
            return b"".join([*out, _END])


def pieces(docs: DataFrame, tokenizer: str, seq_len: int = 4096) -> DataFrame:
    """One row per piece: whole sequences of seq_len ids, then what is left.  A null text is empty: the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(tokenizer)
        for batch in slices(batches, most_bytes=4 << 20):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = coder.ids(text)
                n = len(ids) // 4
                for start in range(0, n, seq_len):
                    part = ids[4 * start : 4 * (start + seq_len)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], list(names))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), _PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items are placed longest first, ties in the order given."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    width = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * width)  # a tournament: each inner node holds the larger of its two children
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < width:
            node *= 2
            if free[node] < need:
                node += 1
        bins[i], offsets[i] = node - width, capacity - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 4096, group_pieces: int = 16_384, seed: int = 17) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence of at most seq_len ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset; `offset` is gapless from 0 within a
    sequence.  Null texts are empty documents (one end id); rows with the same or a null doc_id, and equal rows, are
    packed like any others; an empty table gives an empty result; other columns of docs are ignored.  Which pieces
    share a sequence depends on how the input is split, as groups are drawn by a row's place in it.
    """
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0))
    most = docs.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.floor(size / seq_len)), F.lit(0))).first()[0]  # a token has a byte or more
    place = F.monotonically_increasing_id()
    drawn = F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(max(1, math.ceil(most / group_pieces)))).cast("long")
    found = pieces(docs, tokenizer, seq_len).withColumn("place", place).withColumn("pack_group", drawn)
    return found.groupBy("pack_group").applyInPandas(placed(seq_len), _PIECES + ", sequence_id long, offset long")


def placed(seq_len: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "place"], ascending=[False, True], kind="stable")
        full = int((group["length"] >= seq_len).sum())  # these come first and fill a bin each
        bins, offsets = first_fit_decreasing(group["length"].to_numpy()[full:], seq_len)
        base = int(group["pack_group"].iloc[0]) << 32
        group["sequence_id"] = base + np.concatenate((np.arange(full), full + bins))
        group["offset"] = np.concatenate((np.zeros(full, np.int64), offsets))
        return group.drop(columns=["pack_group", "place"])

    return place


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order and its length, for a writer."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("pieces"), F.sum("length").alias("n_tokens"))


def flat(ids: list[bytes]) -> list[int]:
    return list(chain.from_iterable(np.frombuffer(x, "<u4").tolist() for x in ids))
