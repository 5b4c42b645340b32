"""Documents from HTML pages and front matter."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SKIP = frozenset(("script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe", "svg"))
_BREAK = frozenset(("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "blockquote", "pre"))
_META = {"author": "author", "article:author": "author", "og:site_name": "site", "description": "excerpt", "og:description": "excerpt", "og:title": "title", "article:published_time": "date", "date": "date"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.images: list[tuple[str, str]] = []
        self.skipped: list[str] = []
        self.in_title = self.in_main = 0
        self.title, self.every, self.main = [], [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html" and a.get("lang"):
            self.meta.setdefault("lang", a["lang"])
        if tag == "meta":
            name = _META.get((a.get("name") or a.get("property") or "").lower())
            if name and a.get("content"):
                self.meta.setdefault(name, a["content"])
        if tag == "img" and a.get("src"):
            self.images.append((a["src"], a.get("alt") or ""))
        if tag in _SKIP:
            self.skipped.append(tag)
        self.in_title += tag == "title"
        self.in_main += tag in ("article", "main")
        if tag in _BREAK:
            self._say(" ")

    def handle_endtag(self, tag):
        if tag in self.skipped:
            while self.skipped and self.skipped.pop() != tag:
                pass
        self.in_title -= tag == "title" and self.in_title > 0
        self.in_main -= tag in ("article", "main") and self.in_main > 0
        if tag in _BREAK:
            self._say(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skipped:
            self._say(data)

    def _say(self, data):
        self.every.append(data)
        if self.in_main:
            self.main.append(data)


def read_page(html: str | None) -> dict:
    """Title, author, site, excerpt, language, date, text and images of one page; an empty page is an error."""
    if not (html or "").strip():
        return {"error": "empty input"}
    r = _Reader()
    r.feed(html)
    r.close()
    text = " ".join("".join(r.main).split()) or " ".join("".join(r.every).split())
    title = r.meta.get("title") or " ".join("".join(r.title).split()) or None
    return {"title": title, "text": text, "images": [{"url": u, "alt": a} for u, a in r.images], "error": None, **{k: r.meta.get(k) for k in ("author", "site", "excerpt", "lang", "date")}}


_FIELDS = ("title", "author", "site", "excerpt", "lang", "date", "text", "images", "error")


def documents(pages: DataFrame, html: str = "html") -> DataFrame:
    """S3: pages with their parsed fields."""
    keep = [c for c in pages.columns if c != html]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html)
    schema += ", title string, author string, site string, excerpt string, lang string, date string, text string, images array<struct<url:string,alt:string>>, error string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [read_page(h) for h in pdf[html]]
            out = pdf[keep].copy()
            for f in _FIELDS:
                out[f] = [p.get(f) for p in parsed]
            yield out

    return pages.select(*keep, html).mapInPandas(read, schema)


def image_refs(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, url, alt): each url once, with its first alt, in order."""
    each = rows.select(key, F.posexplode("images").alias("pos", "i")).select(key, "pos", F.col("i.url").alias("url"), F.col("i.alt").alias("alt"))
    return each.groupBy(key, "url").agg(F.min("pos").alias("pos"), F.min_by("alt", "pos").alias("alt"))


def plain_text(html: Column) -> Column:
    """The part of S3 that SQL expresses: scripts, styles and tags out, white space to one space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")


def front_matter(markdown: Column) -> Column:
    """struct(title, author, site, date) of a YAML front matter block."""
    block = F.regexp_extract(markdown, r"(?s)\A---\s*\n(.*?)\n---", 1)

    def field(*names: str) -> Column:
        raw = F.regexp_extract(block, rf"(?m)^(?:{'|'.join(map(re.escape, names))}):[ \t]*(.*)$", 1)
        bare = F.regexp_replace(F.trim(raw), r"^[\"']|[\"']$", "")
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            bare = F.replace(bare, F.lit(entity), F.lit(char))
        return F.nullif(unescape_u(bare), F.lit(""))

    date = field("date", "published", "published_at")
    return F.struct(field("title").alias("title"), field("author").alias("author"), field("sitename", "site", "site_name").alias("site"), F.coalesce(*[F.try_to_timestamp(date, F.lit(f)) for f in _FORMATS]).cast("date").alias("date"))


def unescape_u(text: Column) -> Column:
    """`\\uXXXX` as the character it stands for."""
    parts = F.split(text, r"\\u(?=[0-9a-fA-F]{4})")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.decode(F.unhex(F.substr(p, F.lit(1), F.lit(4))), "UTF-16BE"), F.substr(p, F.lit(5))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))
