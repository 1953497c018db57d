"""Main text of web pages: nearest-URL page differencing, and the pages' own structure.

A page is cut into text lines, one for each block of its markup. Pages are sorted by host and URL path; a page is paired with its
nearest neighbours of other paths on the same host, the one before and the one after. Its lines are aligned with those of each by
longest common subsequence, and lines that a neighbour shares are deleted: what neighbours have in common is furniture. Pages
also share paragraphs of their articles; so within an element that a page itself marks as its article (``article``, ``main``)
prose is spared: the lines of paragraphs, headings, list items, cells and the like, unless links make up the whole line.

Lines of menus, headers, footers, sidebars, notices, adverts, forms and comments go by the names of their elements too, as
not every page has a neighbour. A class or id counts only if the whole of a name says so (``related-posts``, not
``related-work``), and ids, which are often but link targets, only on containers. On an ``article`` or ``main`` only words for
comments count; within one, a weaker word (of ``CONTAINER_MARKS``) that stands alone makes a line suspect, and it goes if a neighbour shares it or if links make up
all of it. A page all of whose lines are marked by class alone keeps them.

The neighbours come from one range sort of small rows (line hashes, no markup), one for each different host and path: each
partition looks at the row before and after, and the partitions' edge rows are carried over, so a host with a third of all pages
is spread evenly and the result does not depend on how rows were dealt. They are joined back by host and path, so all pages of
a path have the same neighbours, however many they are.

Cases
-----
* null or empty html gives an empty text; a null or odd URL has no host and no neighbour; pages are read whole
* repeated rows are each reported; pages of equal URL apart from query, fragment, ``.html`` and final slash are not compared
* unclosed and stray tags are closed by their surroundings; an unclosed script runs to the end of the page; a tag without its ``>`` is text
* malformed pages take time in proportion to their length: what a search has passed in vain is not searched again
* an empty table gives an empty report; other columns are ignored
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, parallelism, stage

#: A tag whose attributes have no angle brackets, as nearly all; it fails at the next bracket.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)([^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+)>""")
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
STOP = re.compile(r"""[>"']""")
LONG_REFERENCE = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?")
ZEROS = re.compile(r"&#0+(?=[0-9])")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
FURNITURE = frozenset("aside button canvas datalist dialog footer form head menu nav noscript object search select svg template".split())
#: Blocks of prose, which neighbours do not take from an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd tr caption figcaption address".split())
#: A class or id is furniture if its words are one of these ...
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle breadcrumb breadcrumbs comment comments cookie cookies disqus footer gdpr masthead nav navbar "
    "navigation newsletter pagination sidebar sponsored subscribe subscription".split()
)
#: ... or on a container one of these ...
CONTAINER_MARKS = frozenset(
    "alert banner consent header login menu menus modal notice notices pager popup promo promotion recommended related replies reply respond share sharing signup social "
    "sponsor teaser toolbar topbar widget widgets".split()
)
#: ... and words of these lists: about the place, and, after a mark, about what it holds.
PLACES = frozenset("a b bottom float fixed global google inline left lower main mobile primary right secondary site sticky sub the top upper".split())
HOLDS = frozenset(
    "area articles author bar bars body block bottom box button buttons card column content container count cta feed form group head heading icon icons inner item items label left "
    "link links list main message meta module nav outer overlay panel post posts primary right row secondary section side slot space stories story strip text thread title top trail "
    "unit widget wrap wrapper zone".split()
)
CONTAINERS = frozenset("article aside center details dir div dl fieldset figure footer form header ins main menu nav ol section table tbody td tr ul".split())
#: Containers whose ids count; that of a section is a link target unless it is in MARKS.
NAMED = CONTAINERS - {"article", "main", "section", "tr", "tbody", "figure", "details"}
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
CONTENT = frozenset(
    "content post entry story article main primary article-body article-content article-text articlebody body-content body-text entry-content main-content main-text "
    "maincontent page-content post-body post-content post-text story-body".split()
)
#: What an element of this name ends, and how far outwards it looks.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"})}
ARTICLE, MAIN, GUESSED = 4, 2, 1
#: How sure it is that a line is furniture: a weak word within an article, a class or id, an element or attribute.
SUSPECT, NAMED_SO, CERTAIN = 1, 2, 3
#: The words that count on an article.
REMARKS = frozenset("comment comments disqus reply replies".split())
WORDS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _is_mark(token: str, marks: frozenset[str]) -> bool:
    """Whether the whole of a class or id names furniture."""
    marked = False
    for word in WORDS.findall(CAMEL.sub("-", token).lower()):
        if word in marks:
            marked = True
        elif not (word.isdigit() or word in PLACES or (marked and word in HOLDS)):
            return False
    return marked


def _is_topic(token: str) -> bool:
    """Whether a class or id is one word that an article may well be about; a compound, or ``notice``, says what the element is for."""
    return len(WORDS.findall(CAMEL.sub("-", token).lower())) == 1 and token.lower() not in ("notice", "notices")


def _traits(name: str, attrs: str, inside: int, quoted: bool) -> tuple[int, int]:
    """How surely an element is furniture, and what container it is. ``quoted``: it stands in preformatted text."""
    level = CERTAIN if name in FURNITURE or (name == "header" and inside < MAIN) else 0
    container = ARTICLE if name == "article" else MAIN if name == "main" else 0
    if not attrs or name in ("html", "body"):
        return level, container
    weak = CONTAINER_MARKS if name in CONTAINERS else frozenset()
    for kind, a, b, c in ATTRIBUTE.findall(attrs):
        kind, value = kind.lower(), a or b or c
        if kind == "hidden" or (kind == "style" and "display:none" in value.replace(" ", "").lower()):
            level = CERTAIN
        elif kind == "role":
            role = value.strip().lower()
            if role in ROLES and not (role in ("banner", "form") and inside >= MAIN):
                level = CERTAIN
            container = max(container, MAIN if role == "main" else ARTICLE if role == "article" else 0)
        elif kind in ("class", "id"):
            for token in value.split():
                if token.lower() in CONTENT and name in CONTAINERS:
                    container = max(container, GUESSED)
                elif quoted or (kind == "id" and name not in NAMED and name not in ("article", "section")):
                    continue
                elif name in ("article", "main"):
                    level = max(level, NAMED_SO * _is_mark(token, REMARKS))
                elif inside >= MAIN:
                    level = max(level, NAMED_SO * _is_mark(token, MARKS - {"masthead"}), (SUSPECT if _is_topic(token) else NAMED_SO) * _is_mark(token, MARKS | weak - {"header"}))
                else:
                    level = max(level, NAMED_SO * _is_mark(token, MARKS if kind == "id" and name == "section" else MARKS | weak))
    return level, container


class Tokens:
    """Tags of a page in order. The whole takes one pass: a tag that cannot end, and a quote that cannot, is found out once."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.quotes_hold = True  # until a tag's quotes turn out to swallow the rest of the page

    def _end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its ``>``: outside quoted values, as long as quotes hold."""
        html, place = self.html, at
        while self.quotes_hold:
            m = STOP.search(html, place)
            if m is None or (m.group() != ">" and m.start() >= self.last_quote[m.group()]):
                self.quotes_hold = False
            elif m.group() == ">":
                return m.start()
            else:
                place = html.index(m.group(), m.end()) + 1
        return html.index(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start and end of the next piece of markup, and its slash, name and attributes (no name: a comment or the like)."""
        html = self.html
        while True:
            at = html.find("<", at)
            if at < 0:
                return None
            m = TAG.match(html, at)
            if m:
                return at, m.end(), m[1], m[2], m[3]
            for opens, closes in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if html.startswith(opens, at):
                    end = html.find(closes, at + len(opens))
                    return at, len(html) if end < 0 else end + len(closes), "", "", ""
            if at > self.last:
                return None
            if html[at + 1] in "!?":
                return at, html.index(">", at) + 1, "", "", ""
            m = OPENING.match(html, at)
            if m:
                end = self._end(m.end())
                return at, end + 1, m[1], m[2], html[m.end() : end]
            at += 1


def plain(text: str) -> str:
    """Character references decoded, white space made one space; a reference beyond all code points is U+FFFD, however long."""
    if "&#" in text:
        text = LONG_REFERENCE.sub("\ufffd", ZEROS.sub("&#", text))
    return " ".join(unescape(text).split())


def lines_of(html: str) -> list[tuple[str, int, int, bool]]:
    """Text lines of a page in order: ``(text, containers it is in, how surely it is furniture, whether it is prose)``."""
    out: list[tuple[str, int, int, bool]] = []
    stack: list[tuple[str, int, int, bool, bool, int]] = []  # name, containers, level, level only by being a form, silent, depth of the innermost block
    depths: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name
    parts: list[str] = []
    inside, level, soft, silent = 0, 0, False, False
    in_link, own_text = False, False  # own_text: the line has text that is no link

    def add(text: str) -> None:
        nonlocal own_text
        if not silent:
            parts.append(text)
            own_text = own_text or not (in_link or text.isspace())

    def flush() -> None:
        nonlocal own_text
        if parts:
            text = plain("".join(parts))
            parts.clear()
            if text:
                block = stack[stack[-1][5]][0] if stack and stack[-1][5] >= 0 else ""
                out.append((text, inside, CERTAIN if level == SUSPECT and not own_text else level, own_text and block in PROSE))
        own_text = False

    def pop_to(depth: int) -> None:
        nonlocal inside, level, soft, silent
        for entry in stack[depth:]:
            depths[entry[0]].pop()
        del stack[depth:]
        _, inside, level, soft, silent, _ = stack[-1] if stack else ("", 0, 0, False, False, -1)

    def innermost(names: Iterable[str]) -> int:
        return max((depths[n][-1] for n in names if depths.get(n)), default=-1)

    at, end, tokens = 0, len(html), Tokens(html)
    while at < end:
        found = tokens.next(at)
        if found is None:
            add(html[at:])
            break
        start, stop, close, name, attrs = found
        if start > at:
            add(html[at:start])
        at = stop
        if not name:
            continue
        name = name.lower()
        block = name in BLOCKS
        if close:
            if block:
                flush()
            if block or name == "a":
                in_link = False
            depth = innermost((name,))
            if depth >= 0:
                if stack[depth][4] == (stack[depth - 1][4] if depth else False):
                    flush()  # what is silent does not end a line
                pop_to(depth)
            continue
        if name in RAW:
            raw_end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = raw_end.end() if raw_end else end
            continue
        if name == "br" or name in ("td", "th"):
            add(" ")
        if name == "a":
            in_link = True
        if block:
            flush()
            around = stack[-1][5] if stack else -1
            if around >= 0 and stack[around][0] == "p":
                pop_to(around)  # a paragraph ends, with what is open inside it
            if name in ENDS:
                ends, bounds = ENDS[name]
                depth = innermost(ends)
                if depth > innermost(bounds):
                    pop_to(depth)
        if name in VOID:
            continue
        quoted = bool(stack) and stack[-1][0] in ("pre", "code")
        marked, container = _traits(name, attrs, inside, quoted)
        if not (block or marked or container or name == "code"):
            continue
        if block or container:
            flush()
            if soft and container >= MAIN:
                level, soft = 0, False  # a form around the whole page
            if marked > level:
                soft = name == "form"
            inside, level = inside | container, max(level, marked)
        elif marked > SUSPECT:
            silent = True  # furniture within a line
        depths[name].append(len(stack))
        stack.append((name, inside, level, soft, silent, len(stack) if block else stack[-1][5] if stack else -1))
    flush()
    return out


def longest_common(a: list[int], b: list[int]) -> set[int]:
    """Positions in ``a`` of one longest common subsequence: as increasing positions in ``b``, by patience."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ha, hb = len(a), len(b)
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    where: dict[int, list[int]] = defaultdict(list)
    for j in range(hb - 1, lo - 1, -1):
        where[b[j]].append(j)
    tops: list[int] = []  # least end in b of a subsequence of each length
    links: list[tuple] = []
    for i in range(lo, ha):
        for j in where.get(a[i], ()):
            k = bisect_left(tops, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                links.append(link)
            else:
                tops[k], links[k] = j, link
    found = {*range(lo), *range(ha, len(a))}
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def shared_lines(lines: list[tuple[str, int, int, bool]], neighbours: Iterable[list[int] | None]) -> set[int]:
    """Numbers of the lines that are deleted because a neighbour shares them: all but the prose of an article that nothing else speaks against."""
    hashes = [_hash(line[0]) for line in lines]
    found = set().union(*(longest_common(hashes, n) for n in neighbours if n))
    return {k for k in found if not (lines[k][1] >= MAIN and lines[k][3] and not lines[k][2])}


def main_text(html: str, neighbours: Iterable[list[int] | None] = ()) -> str:
    """Main text of a page, given the line hashes of its nearest neighbours. A page of which nothing would be left keeps its lines."""
    lines = lines_of(html)
    shared = shared_lines(lines, neighbours)
    clear = [k for k, line in enumerate(lines) if line[2] <= SUSPECT]
    named = [k for k, line in enumerate(lines) if line[2] <= NAMED_SO]
    # articles that are not marked, then marked ones, then what stands for an article, then all
    choices = [(rows, kind) for rows in (clear, named) for kind in (ARTICLE, MAIN)] + [(clear, GUESSED), (clear, 0), (named, 0)]
    body = next((own for rows, kind in choices if (own := [k for k in rows if lines[k][1] & kind or not kind])), [])
    own = [lines[k][0] for k in body if k not in shared]
    # a neighbour that has all of a page's lines is a copy of it, not what frames it
    return "\n".join(own or [lines[k][0] for k in body])


def _url_parts(url: Column) -> dict[str, Column]:
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"(?:\.html?)?/*$", "")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))}


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [[_hash(line[0]) for line in lines_of(h)] for h in batch.column("html").to_pylist()]
        kept = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(lines, pa.list_(pa.int64()))], [*kept, "lines"])


def neighbours(pages: DataFrame) -> DataFrame:
    """``host, path, before, after``: for each different path of a host the line hashes of the nearest pages in URL order before and after it on the same
    host (null: none). Of the pages of one path the one with the least hash of its URL and markup stands for all. Paths without a neighbour are
    left out."""
    row = F.xxhash64(F.col("page_id").cast("string"), "url", "html").alias("row_hash")
    rows = pages.select(row, "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(_url_parts(F.col("url"))).drop("url").where("host <> ''")
    lines = stage(rows.mapInArrow(_hashed, "row_hash long, host string, path string, lines array<long>"), "page-lines")
    n = parallelism(pages.sparkSession)
    order = ["host", "path"]
    # partial minima before the shuffle: a path that very many pages share is one row of each task
    paths = lines.groupBy(*order).agg(F.min(F.struct("row_hash", "lines")).alias("least")).select(*order, F.col("least.lines").alias("lines"))
    placed = paths.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    rows = placed = stage(placed, "page-order")
    discard(lines)
    page = F.struct("host", "lines")
    here = Window.partitionBy("part").orderBy(*order)
    rows = rows.withColumns({"before": F.lag(page).over(here), "after": F.lead(page).over(here)})
    # one row for each partition carries its edges over to the next
    edge = F.struct(*order, "lines")
    edges = placed.groupBy("part").agg(F.min(edge).alias("low"), F.max(edge).alias("high"))
    parts = Window.orderBy("part")
    edges = edges.select("part", F.lag("high").over(parts).alias("left"), F.lead("low").over(parts).alias("right"))
    rows = rows.join(edges, "part")

    def usable(inner: Column, outer: Column) -> Column:
        host, lines = F.coalesce(inner["host"], outer["host"]), F.when(inner.isNotNull(), inner["lines"]).otherwise(outer["lines"])
        return F.when(host == F.col("host"), lines)

    rows = rows.select("host", "path", usable(F.col("before"), F.col("left")).alias("before"), usable(F.col("after"), F.col("right")).alias("after"))
    out = stage(rows.where("before IS NOT NULL OR after IS NOT NULL"), "page-neighbours")
    discard(placed)
    return out


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            near = zip(part.column("before").to_pylist(), part.column("after").to_pylist())
            texts += map(main_text, part.column("html").to_pylist(), near)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    joined = pages.withColumns(_url_parts(F.col("url"))).hint("merge").join(neighbours(pages), ["host", "path"], "left")
    joined = joined.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "before", "after")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string")
