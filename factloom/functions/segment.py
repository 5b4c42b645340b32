"""Sentence segmentation of Markdown, as a table function over Arrow batches.

Headings, code, tables and list items are whole units; prose is split after `.`, `!` or `?` before white space.  Offsets
count code points.  The per-text work is a small state machine; Spark spreads it over rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_ATX = re.compile(r"[ \t]*#{1,6}(?:[ \t]|$)")
_SETEXT = re.compile(r"[ \t]*(?:={3,}|-{3,})[ \t]*$")
_ITEM = re.compile(r"[ \t]*(?:[-*+] |[0-9]+[.)] )")
_MORE = re.compile(r"\t|  |[ \t]*$")
_END = re.compile(r"[.!?](?=[ \t\n\r]|\Z)[ \t\n\r]*", re.S)


def _kind(line: str, after_prose: bool) -> str:
    bare = line.rstrip("\n")
    if not bare.strip(" \t\r"):
        return "blank"
    if _FENCE.match(bare):
        return "fence"
    if line.startswith(("\t", "    ")):
        return "code"
    if _ATX.match(bare):
        return "heading"
    if after_prose and _SETEXT.match(bare):
        return "underline"
    if "|" in bare:
        return "table"
    return "item" if _ITEM.match(bare) else "prose"


def _units(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is prose) of each block."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    units: list[list] = []  # [first line, line after the last, prose]
    i, n = 0, len(lines)
    while i < n:
        after_prose = bool(units) and units[-1][2] and units[-1][1] == i
        kind, first = _kind(lines[i], after_prose), i
        i += 1
        if kind == "blank":
            continue
        if kind == "fence":
            mark = _FENCE.match(lines[first])[1]
            while i < n and not re.match(rf"[ \t]*{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i].rstrip("\r\n")):
                i += 1
            i = min(n, i + 1)
        elif kind == "code":
            while i < n and lines[i].startswith(("\t", "    ")):
                i += 1
        elif kind == "underline":
            units[-1][1:] = [i, False]
            continue
        elif kind == "table":
            while i < n and "|" in lines[i]:
                i += 1
        elif kind == "item":
            while i < n and _MORE.match(lines[i].rstrip("\r\n")) and not _ITEM.match(lines[i]):
                i += 1
        elif kind == "prose":
            while i < n and _kind(lines[i], False) == "prose" and not _SETEXT.match(lines[i].rstrip("\r\n")):
                i += 1
        units.append([first, i, kind == "prose"])
    for a, b, prose in units:
        yield starts[a], starts[b], prose


def segment(text: str | None, most: int = 0) -> list[tuple[int, str, int, int]]:
    """(index, text, start, end) of every sentence; `most` > 0 cuts longer ones into slices of that many characters."""
    out: list[tuple[int, str, int, int]] = []

    def add(a: int, b: int, trim: bool) -> None:
        piece = text[a:b]
        if not piece.strip():
            return
        if trim:
            lead = len(piece) - len(piece.lstrip())
            a, b = a + lead, a + len(piece.rstrip())
        for k in range(a, b, most) if most > 0 else (a,):
            end = min(b, k + most) if most > 0 else b
            out.append((len(out), text[k:end], k, end))

    for a, b, prose in _units(text or ""):
        if not prose:
            add(a, b, True)
            continue
        at = a
        for m in _END.finditer(text, a, b):
            add(at, m.end(), True)
            at = m.end()
        add(at, b, True)
    return out


_SCHEMA = "array<struct<idx:int,text:string,start:int,end:int>>"


def sentences(text: Column, most: int = 0) -> Column:
    """array<struct<idx,text,start,end>> of a Markdown text; explode it for one row per sentence."""

    @F.pandas_udf(_SCHEMA)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("idx", "text", "start", "end"), s, strict=True)) for s in segment(t, most)])

    return cut(text)


def salvage_array(text: str | None) -> str | None:
    """The JSON array that begins at the first `[` of a text and ends where it closes; None if none does or it is not valid.

    Only brackets outside of quoted strings count, so the text is read once and parsed once.
    """
    import json

    start = (text or "").find("[")
    if start < 0:
        return None
    try:
        found, end = json.JSONDecoder().raw_decode(text, start)
    except (ValueError, RecursionError):
        return None
    return text[start:end] if isinstance(found, list) else None


def salvaged(text: Column) -> Column:
    """T43 on a column."""

    @F.pandas_udf("string")
    def salvage(texts: pd.Series) -> pd.Series:
        return texts.map(salvage_array)

    return salvage(text)
