"""HTML extraction by consensus host paths.

1. Every page is parsed once and its containers are scored; the page votes for the generalised tag-class path of the
   container that holds its text, and reports each path's own text: its hash, and how much of it stands in links.
2. Per host and path the votes are summed over distinct pages.  Paths whose text is the same on most pages, or is mostly
   links, are boilerplate of that host, in whatever language their names are.
3. Each page looks up the paths it has: the one with most votes is its container, the boilerplate among them is left out.
   A page with none of the host's paths uses its own.

Within the chosen container menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts and
styles are left out.  A class or id name (or a form) marks such a part only while the page's text is elsewhere: a container
that holds most of it stays, whatever its name.  Parsing takes time in proportion to the page, however broken it is.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_key, cut, lean, release, slices

_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "select", "object", "canvas", "audio", "video", "title")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINER = frozenset("html body div section article main aside header footer nav form ul ol dl table tbody thead tfoot tr td th fieldset dialog details figure menu center".split())
_BLOCK = _CONTAINER | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre address figcaption caption summary legend hr br option".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_DROPPED = frozenset("nav aside footer menu dialog button fieldset label input".split())
#: Tokens of class and id names that mark what is not the article: English, German, French, Spanish.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored teaser nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside footer foot masthead topbar cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login register "
    "share sharing social related recommended recommendations popular trending comment comments commentlist respond reply replies disqus discussion form search popup modal "
    "overlay widget widgets pagination pager toolbar tags taglist copyright legal disclaimer skip hidden "
    "werbung anzeige anzeigen werbebanner seitenleiste randspalte fusszeile kopfzeile hinweis hinweise kommentar kommentare leserbrief leserbriefe leserkommentare anmelden anmeldung registrieren teilen verwandt empfehlungen suche impressum datenschutz "
    "publicite annonce annonces pub encart pied barre laterale commentaire commentaires avis reponse reponses inscription connexion partage partager abonnement recherche mentions "
    "anuncio anuncios publicidad patrocinado barra lateral pie aviso avisos comentario comentarios respuesta respuestas opiniones suscripcion suscribirse compartir relacionados relacionado buscar busqueda registro".split()
)
#: Those that an article may well use for its own parts: there they mark only what is mostly links.
_WEAK = frozenset("related social discussion popular trending legal tags alert side skip hidden search register recommended widget overlay avis mentions pie pied pub barre barra lateral laterale hinweis teilen verwandt suche opiniones relacionado relacionados".split())
#: First words of names of what readers wrote, which can be longer than the article.
_READERS = frozenset("comment comments commentlist respond reply replies disqus discussion kommentar kommentare leserkommentare leserbriefe commentaire commentaires reponses comentario comentarios respuestas".split())
_MILD = "~"  # before the names of a container that only weak marks make boilerplate, within an article
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A tag.  Nothing in it can match in two ways, and an unquoted `<` ends it, so a tag that never closes fails where the next begins.
_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^'\"<>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>[^<>]*+)>")
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in _RAW}
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What ends in a dash or underline and then five or more letters and digits that no word has: a digit, a capital inside, or no vowel.
_MADE = re.compile(r"(?<=[-_])(?=[A-Za-z0-9]{5,}\b)(?:(?=[A-Za-z]*[0-9])|(?=[A-Za-z][a-z]*[A-Z])|(?=[^aeiouyAEIOUY]+\b))[A-Za-z0-9]+\b")


class Node:
    """A container: its path step, its parent, whether it is boilerplate, and its text as (text, in a link, in prose) or children.

    key: a hash of its path.  named: the names by which alone it is boilerplate, else ''.
    """

    __slots__ = ("dropped", "items", "key", "named", "parent", "step", "tag")

    def __init__(self, tag: str, step: str, parent: Node | None, dropped: bool, named: str = "") -> None:
        self.tag, self.step, self.parent, self.dropped, self.named, self.items = tag, step, parent, dropped or bool(named), "" if dropped else named, []
        raw = step.encode("utf-8", "surrogatepass")
        low, high = (parent.key >> 32, parent.key & 0xFFFFFFFF) if parent else (1, 2)
        self.key = zlib.crc32(raw, low) << 32 | zlib.crc32(b"/" + raw, high)


def generalised(name: str) -> str:
    """A class name without numbers and without what style tools make up."""
    return re.sub(r"\d+", "#", _MADE.sub("#", name).lower())


def _look(tag: str, attrs: str, within_article: bool) -> tuple[str, bool, str]:
    """The generalised step of a container, whether it is boilerplate by its tag or role, and the names that say so."""
    names, said, marked, strong, dropped = [], [], tag == "form", tag == "form", tag in _DROPPED or tag == "header" and not within_article
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "class":
            names = [generalised(c) for c in value.split()[:2]]
        if key in ("class", "id"):
            words = {w.lower() for w in _WORDS.findall(value)}
            hits = words & _MARKS
            marked |= bool(hits) or "header" in words and not within_article
            strong |= bool(hits - _WEAK) or not within_article
            said.append(re.sub(r"\d+", "#", value.lower()))
        elif key == "role":
            dropped |= value.lower() in _ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            dropped = True
    exempt = tag in ("html", "body", "article", "main")
    return ".".join([tag, *names]), dropped and not exempt, ("" if strong else _MILD) + " ".join([tag, *said]) if marked and not exempt else ""


def _tags(text: str) -> Iterator[tuple[int, int, str, bool, str, str]]:
    """(start, end, tag, is an end tag, attributes, plain text) of all markup in order; tag is '' for comments and character data."""
    at, last = 0, text.rfind(">")
    while (at := text.find("<", at)) >= 0:
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            end = len(text) if end < 0 else end + 3
            yield at, end, "", False, "", ""
        elif text.startswith("<![CDATA[", at):
            end = text.find("]]>", at + 9)
            yield at, len(text) if end < 0 else end + 3, "", False, "", text[at + 9 : len(text) if end < 0 else end]
            end = len(text) if end < 0 else end + 3
        elif at > last:  # no tag ends any more
            return
        elif text.startswith(("<!", "<?"), at):
            end = text.find(">", at) + 1
            yield at, end, "", False, "", ""
        elif m := _TAG.match(text, at) or _LOOSE.match(text, at):
            end, tag = m.end(), m["tag"].lower()
            if tag in _RAW_END and not m["end"]:
                close = _RAW_END[tag].search(text, end)
                end = close.end() if close else len(text)
                yield at, end, "", False, "", ""
            else:
                yield at, end, tag, bool(m["end"]), m["attrs"], ""
        else:
            end = at + 1
        at = end


class _Open:
    """The open tags that are no containers, innermost last, with their numbers within each open container."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.levels: list[tuple[int, dict[str, int]]] = [(0, {})]  # where each container's tags begin, and how many of each there are
        self.links = self.prose = 0

    def push(self, tag: str) -> None:
        self.tags.append(tag)
        here = self.levels[-1][1]
        here[tag] = here.get(tag, 0) + 1
        self.links += tag == "a"
        self.prose += tag in _PROSE

    def pop(self) -> str:
        tag = self.tags.pop()
        self.levels[-1][1][tag] -= 1
        self.links -= tag == "a"
        self.prose -= tag in _PROSE
        return tag

    def has(self, tag: str) -> bool:
        return self.levels[-1][1].get(tag, 0) > 0

    def close(self, tag: str) -> None:
        while self.pop() != tag:
            pass

    def close_blocks(self, tag: str) -> None:
        """What is open from the first paragraph on, or from the first list item where another begins."""
        ends = [*_PROSE, tag] if tag in ("li", "dt", "dd") else _PROSE
        while any(map(self.has, ends)):
            self.pop()

    def enter(self) -> None:
        self.levels.append((len(self.tags), {}))

    def leave(self) -> None:
        while len(self.tags) > self.levels[-1][0]:
            self.pop()
        self.levels.pop()


def parse(text: str) -> Node:
    """The tree of containers of a page, however broken its markup."""
    root = node = Node("", "", None, False)
    inline = _Open()
    depth: dict[str, int] = {}  # open containers by tag
    at = article = 0

    def say(s: str) -> None:
        if s:
            node.items.append((s, inline.links > 0, inline.prose > 0))

    for start, stop, tag, ends, attrs, plain in _tags(text):
        say(text[at:start])
        at = stop
        say(plain)
        if not tag or tag == "head":  # the head's end may be left out; what is text in it belongs to the body
            continue
        if tag in _BLOCK:
            say(" ")
        if ends:
            if depth.get(tag):
                closed = ""
                while closed != tag:
                    closed = node.tag
                    depth[closed] -= 1
                    article -= closed in ("article", "main")
                    node = node.parent
                    inline.leave()
            elif tag not in _CONTAINER and inline.has(tag):
                inline.close(tag)
        elif tag in _VOID:
            continue
        elif tag in _CONTAINER or tag in ("button", "label"):
            if tag in _CONTAINER and inline.has("p"):
                inline.close("p")
            if not attrs.endswith("/") or tag not in _CONTAINER:
                step, dropped, named = _look(tag, attrs, article > 0) if tag in _CONTAINER else (tag, True, "")
                child = Node(tag, step, node, dropped, named)
                node.items.append(child)
                node = child
                article += tag in ("article", "main")
                depth[tag] = depth.get(tag, 0) + 1
                inline.enter()
        else:
            if tag in _BLOCK:  # a new block ends an open paragraph and what is open in it
                inline.close_blocks(tag)
            inline.push(tag)
    say(text[at:])
    _restore(root)
    return root


def _size(s: str) -> int:
    return len(s) - s.count(" ") if not s.isspace() else 0


def _restore(root: Node) -> None:
    """Keeps containers dropped by name alone that hold most of the text around them, or without which next to none is left.

    Containers with the same names are judged together: by prose, or by all text where little is prose.  Those of links
    stay dropped while there is other text, as do those beside an article and readers' comments beside some text.  Within
    an article weak names drop only what is mostly links.
    """
    order, weigh = [root], {}
    for node in order:
        order.extend(x for x in node.items if isinstance(x, Node) and (x.named or not x.dropped))
    if not any(node.named for node in order):
        return
    for node in reversed(order):  # characters outside links, of these in prose, and in links
        text = prose = linked = 0
        for x in node.items:
            if not isinstance(x, Node):
                n = _size(x[0])
                text, prose, linked = (text, prose, linked + n) if x[1] else (text + n, prose + n * x[2], linked)
            elif id(x) in weigh:
                a, b, c = weigh[id(x)]
                text, prose, linked = text + a, prose + b, linked + c
        weigh[id(node)] = text, prose, linked
        if node.named.startswith(_MILD) and text > linked:
            node.dropped = False
    scopes = [root]
    while scopes:
        scope = scopes.pop()
        all_text, all_prose, _ = weigh[id(scope)]
        by = 1 if 4 * all_prose >= all_text else 0
        whole = weigh[id(scope)][by]
        groups: dict[str, list[Node]] = {}
        within: dict[str, set[int]] = {}  # by group the innermost articles of the scope around its containers, or -1
        articles: list[tuple[Node, int]] = []  # with the place of the article around each, or -1
        todo = [(scope, -1)]
        for node, around in todo:
            for x in node.items:
                if isinstance(x, Node) and x.named and x.dropped:
                    groups.setdefault(x.named, []).append(x)
                    within.setdefault(x.named, set()).add(around)
                elif isinstance(x, Node) and not x.dropped:
                    if x.tag in ("article", "main"):
                        articles.append((x, around))
                        todo.append((x, len(articles) - 1))
                    else:
                        todo.append((x, around))
        held = {k: [sum(weigh[id(x)][i] for x in g) for i in range(3)] for k, g in groups.items()}
        left = whole - sum(h[by] for h in held.values())
        for key in sorted(groups, key=lambda k: (-held[k][by], k)):
            text, _, linked = held[key]
            own = held[key][by]
            if not own or linked > text and left:
                continue
            above: set[int] = set()
            for i in within[key]:
                while i >= 0 and i not in above:
                    above.add(i)
                    i = articles[i][1]
            beside = any(i not in above and 10 * weigh[id(a)][by] >= whole for i, (a, _) in enumerate(articles))
            words = _WORDS.findall(key.split(" ", 1)[-1])
            scarce = 10 if words and words[0] in _READERS else 4
            if scarce * left < whole if beside or scarce == 10 else 2 * own >= whole or scarce * left < whole:
                for x in groups[key]:
                    x.dropped = False
                    scopes.append(x)
                left += own


def _mass(node: Node, found: dict[int, tuple[float, float]]) -> tuple[float, float]:
    """Characters of text outside links, all and in prose, of what is not boilerplate; found: the same by node."""
    total = prose = 0.0
    stack: list[tuple[Node, int, float, float]] = [(node, 0, 0.0, 0.0)]
    while stack:
        now, i, total, prose = stack.pop()
        while i < len(now.items):
            x = now.items[i]
            i += 1
            if isinstance(x, Node):
                if not x.dropped:
                    stack.append((now, i, total, prose))
                    now, i, total, prose = x, 0, 0.0, 0.0
            elif not x[1]:
                n = _size(x[0])
                total += n
                prose += n * x[2]
        found[id(now)] = (total, prose)
        if stack:
            up, j, t, p = stack.pop()
            stack.append((up, j, t + total, p + prose))
    return total, prose


def best(root: Node) -> tuple[str, float]:
    """The path of the container that holds the page's text, and its share of all text that is no boilerplate.

    From the top, the walk goes on to the group of children with one path that holds most of the text, as long as no
    prose is left behind; it ends at an article.
    """
    mass: dict[int, tuple[float, float]] = {}
    whole, _ = _mass(root, mass)
    nodes, path = [root], ""
    while nodes[0].tag != "article":
        groups: dict[str, list[Node]] = {}
        for n in nodes:
            for x in n.items:
                if isinstance(x, Node) and not x.dropped:
                    groups.setdefault(x.step, []).append(x)
        have = sum(mass[id(n)][0] for n in nodes), sum(mass[id(n)][1] for n in nodes)
        weigh = {s: (sum(mass[id(n)][0] for n in g), sum(mass[id(n)][1] for n in g)) for s, g in groups.items()}
        articles = [s for s, g in groups.items() if g[0].tag in ("article", "main") and weigh[s][0] > 0]
        step = max(articles or weigh, key=lambda s: (weigh[s][1], weigh[s][0], s), default=None)
        if step is None or not weigh[step][0] or not articles and (weigh[step][1] < 0.98 * have[1] or weigh[step][0] < 0.5 * have[0]):
            break
        nodes, path = groups[step], f"{path}/{step}"
    held = sum(mass[id(n)][0] for n in nodes)
    return path, held / whole if whole else 0.0


def text_at(root: Node, path: str, without: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of all containers with that path, in page order: blocks joined by one space; containers whose key is in `without` are left out."""
    wanted = [s for s in path.split("/") if s]
    nodes = [root]
    for step in wanted:
        there = [x for n in nodes for x in n.items if isinstance(x, Node) and x.step == step]
        nodes = [x for x in there if not x.dropped]
        if not nodes:  # the host's pages have their text here, though little of it is on this one
            nodes = [x for x in there if x.named]
            for x in nodes:
                _restore(x)
    parts: list[str] = []
    for top in nodes:
        stack = [(top, 0)]
        while stack:
            node, i = stack.pop()
            while i < len(node.items):
                x = node.items[i]
                i += 1
                if isinstance(x, Node):
                    if not x.dropped and x.key not in without:
                        stack.append((node, i))
                        node, i = x, 0
                else:
                    parts.append(x[0])
            parts.append(" ")
    return " ".join(_html.unescape("".join(parts)).split())


def key_of(path: str) -> int:
    """The key of the containers with that path."""
    node = Node("", "", None, False)
    for step in path.split("/"):
        if step:
            node = Node("", step, node, False)
    return node.key


def own_texts(root: Node) -> dict[int, tuple[int, int, int]]:
    """Per path (by its key) of the page: a hash of the text its containers have themselves, and its characters outside and in links."""
    found: dict[int, list[int]] = {}
    todo = [root]
    for node in todo:
        mine = found.setdefault(node.key, [0, 0, 0])
        for x in node.items:
            if isinstance(x, Node):
                todo.append(x)
            elif not x[0].isspace():
                words = " ".join(x[0].split())
                mine[0] = zlib.crc32(words.encode("utf-8", "surrogatepass"), mine[0])
                mine[2 if x[1] else 1] += len(words)
    return {k: tuple(v) for k, v in found.items()}


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


_PAGE = ("host", "c1", "c2")
_BLOCK_ROW = "host string, c1 long, c2 int, key long, path string, vote double, hash long, chars long, links long"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _BLOCK_ROW.split(", ")]
    for batch in slices(batches, "html", 2 << 20):
        rows = []
        for *page, text in zip(*(batch.column(c).to_pylist() for c in (*_PAGE, "html")), strict=True):
            root = parse(text or "")
            path, share = best(root)
            main = key_of(path) if path else None
            for key, (h, chars, links) in own_texts(root).items():
                rows.append((*page, key - 2**63, path if key == main else None, share if key == main else 0.0, h, chars, links))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def reported(pages: DataFrame) -> DataFrame:
    """What each distinct page says of its paths: host, c1, c2 (its key), key of the path, its vote and path if it is the page's own choice, text hash, chars, links.

    Pages without a host report together.  Copies of a page meet map-side first and vote together, but are one page.
    """
    rows = pages.select(host().alias("host"), *class_key("html"), F.col("html").cast("string").alias("html"))
    found = rows.mapInArrow(lean(_reports), _BLOCK_ROW).groupBy(*_PAGE, "key")
    return found.agg(F.max("path").alias("path"), F.sum("vote").alias("vote"), *[F.max(c).alias(c) for c in ("hash", "chars", "links")])


def consensus(reports: DataFrame, least_pages: int = 4, repeated: float = 0.6, linked: float = 0.7) -> DataFrame:
    """(host, key, path, votes, boilerplate) of every path of a host; path and votes are null where no page chose it.

    A path is boilerplate if at least least_pages pages of the host have text there and, for the share `repeated` of
    them, it is the text of three pages or more, or if the share `linked` of its characters stands in links; not if half
    of these pages chose it.  Sums by host and path are made map-side first, so a host may hold any share of the pages.
    """
    same = reports.groupBy("host", "key", "hash").agg(F.sum(F.when(F.col("chars") + F.col("links") > 0, 1).otherwise(0)).alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("vote").alias("votes"), F.max("path").alias("path"))
    path = same.groupBy("host", "key").agg(
        F.sum("n").alias("pages"), F.sum(F.when(F.col("n") >= 3, F.col("n")).otherwise(0)).alias("again"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.round(F.sum("votes"), 6).alias("votes"), F.max("path").alias("path")
    )
    poor = (F.col("again") >= repeated * F.col("pages")) | (F.col("links") >= linked * (F.col("chars") + F.col("links")))
    boilerplate = (F.col("pages") >= least_pages) & poor & (F.col("votes") < 0.5 * F.col("pages"))
    return path.select("host", "key", "path", F.when(F.col("path").isNotNull(), F.col("votes")).alias("votes"), boilerplate.alias("boilerplate"))


def looked_up(reports: DataFrame, found: DataFrame, salts: int = 32) -> DataFrame:
    """(host, c1, c2, paths, without): of the paths that a page has those its host chose, most votes first (ties by path), and its boilerplate.

    The pages of a host meet its paths in `salts` groups, so one host may hold a third of all pages.
    """
    told = found.where("boilerplate or votes is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = reports.select(*_PAGE, "key", F.pmod("c1", F.lit(salts)).cast("int").alias("salt")).join(told, ["host", "key", "salt"])
    chosen = F.array_sort(F.collect_list(F.when(F.col("votes").isNotNull(), F.struct((-F.col("votes")).alias("less"), "path"))))
    out = met.groupBy(*_PAGE).agg(chosen.alias("chosen"), F.collect_list(F.when(F.col("boilerplate"), F.col("key"))).alias("without"))
    return out.select(*_PAGE, F.transform("chosen", lambda x: x["path"]).alias("paths"), "without")


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", 2 << 20):
        out = []
        for h, paths, without in zip(*(batch.column(c).to_pylist() for c in ("html", "paths", "without")), strict=True):
            root, gone = parse(h or ""), {k + 2**63 for k in without or ()}
            path, text = next(((p, t) for p in paths or () if (t := text_at(root, p))), (None, None))
            if text is None:
                path = best(root)[0]
                text = text_at(root, path)
            if gone:  # unless the host's other pages are too unlike this one
                less = text_at(root, path, gone)
                text = less if 3 * len(less) >= len(text) else text
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Per row of pages: page_id, url, text and n_chars.

    Null html is empty and gives an empty text; pages without a host (or url) vote together; repeated rows come out
    each; an empty table gives an empty result; other columns are ignored.  What a page looks up of its own paths is
    written first and joined by page: broadcast up to broadcast_bytes, shuffled beyond.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host().alias("host"), *class_key("html"))
    reports = cut(reported(pages))
    found = cut(looked_up(reports, consensus(reports)))
    release(reports)
    size = found.agg(F.sum(F.octet_length("host") + 60 + 8 * F.size("without") + F.aggregate("paths", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p) + 16))).first()[0] or 0
    met = rows.join(F.broadcast(found) if size <= broadcast_bytes else found, [*_PAGE], "left")
    return met.select("page_id", "url", "html", "paths", "without").mapInArrow(lean(_take), "page_id long, url string, text string, n_chars long")
