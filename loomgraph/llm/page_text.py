"""Main text of web pages by nearest-URL page differencing.

A page is read into lines, one a block, in page order. Lines in menus, headers, footers, sidebars,
notices, adverts, forms and comments are chrome; lines in an article or main element are settled as
text. Pages of a host stand in the order of their URL paths. Every page is paired with the neighbour
whose path is nearer, their lines are aligned by a longest common subsequence, and shared lines that
are not settled are deleted.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import parts_for, text_bytes

#: Element names, class words and roles (fixed values).
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "button", "title", "head", "video", "audio", "canvas"}
CHROME = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CHROME_WORD = re.compile(
    r"^(ads?|adverts?|advertisements?|advertorial|banner|sponsor(ed)?|promo(tion)?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|nav|navbar|navigation|menu|"
    r"breadcrumbs?|sidebar|side-?bar|aside|footer|site-footer|page-footer|header|site-header|page-header|masthead|comments?|comment-.*|.*-comments?|disqus.*|replies|reply|"
    r"share|sharing|social|related|recommend(ed|ations)?|newsletter|subscribe|subscription|signup|login|search|widget|toolbar|pagination|pager|skip-link)$"
)
CHROME_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
MAIN_WORD = re.compile(r"^(article|article-body|article-content|post-content|post-body|entry-content|main-content|story-body)$")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
SETTLED, OPEN = 1, 0
#: The zones of tags of up to so many characters are kept.
KEPT_CHARS = 200


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if text.strip(" /\n\t") else {}


def zone_of(name: str, given: dict[str, str], in_main: bool) -> int | None:
    """-1 for chrome, 1 for main text, None for neither. A header within an article holds its title."""
    words = (given.get("class", "") + " " + given.get("id", "")).lower().split()
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    if hidden or name in CHROME and not (name == "header" and in_main) or given.get("role") in CHROME_ROLE or any(CHROME_WORD.match(w) for w in words):
        return -1
    if name in MAIN or given.get("role") in ("main", "article") or any(MAIN_WORD.match(w) for w in words):
        return 1
    return None


def zone_in(name: str, text: str, in_main: bool) -> int | None:
    """zone_of() of attributes as they are written."""
    return zone_of(name, attributes(text), in_main)


kept_zone = lru_cache(maxsize=4096)(zone_in)


def lines_of(html: str | None) -> list[tuple[int, str]]:
    """(SETTLED or OPEN, text) of each block of a page that is not chrome."""
    html = html or ""
    lines: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements with a zone, and those that can hold them
    standing: Counter[str] = Counter()  # their names
    chrome = main = 0
    held: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            lines.append((SETTLED if main else OPEN, text))

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        if not chrome and start > at:
            held.append(html[at:start])
        if start == size:
            break
        tag = TOKEN.match(html, start)
        if not tag:
            if not chrome:
                held.append("&lt;")
            at = start + 1
            continue
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCK and not chrome:
            close()
        elif name == "br" and not chrome:
            held.append(" ")
        if tag[1]:
            if standing[name]:
                while stack:
                    n, zone = stack.pop()
                    standing[n] -= 1
                    if zone:
                        if not chrome:
                            close()
                        chrome -= zone == -1
                        main -= zone == 1
                    if n == name:
                        break
            continue
        if name in RAW:
            if name != "head" and not tag[3].rstrip().endswith("/"):
                end = RAW_END[name].search(html, at)
                at = end.end() if end else size
            continue
        if name in VOID:
            continue
        zone = (kept_zone if len(tag[0]) <= KEPT_CHARS else zone_in)(name, tag[3], main > 0)
        if name == "p" and stack and stack[-1][0] == "p":  # a new paragraph ends the one before
            _, old = stack.pop()
            standing["p"] -= 1
            chrome -= old == -1
            main -= old == 1
        if zone or name in BLOCK or standing[name]:
            if zone and not chrome:
                close()
            stack.append((name, zone or 0))
            standing[name] += 1
            chrome += zone == -1
            main += zone == 1
    if not chrome:
        close()
    return lines


#: Bits of the table of one alignment; a larger one is split.
ALIGNED = 1 << 28


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of two rows of lines.

    A row of the table is one number with a bit for each line of ``b``, so that n and m lines take
    n * m / 64 steps whatever they repeat; a table too large to keep is split in two.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = aligned(a[head : len(a) - tail], b[head : len(b) - tail])
    return set(range(head)) | set(range(len(a) - tail, len(a))) | {head + k for k in inner}


def table_rows(a: list[str], b: list[str]) -> Iterator[int]:
    """After each line of ``a``: bit j is 0 where the j-th line of ``b`` makes the common row a line longer."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for line in a:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & every
        yield row


def aligned(a: list[str], b: list[str]) -> list[int]:
    both = set(a) & set(b)
    place = [i for i, line in enumerate(a) if line in both]
    a, b = [a[i] for i in place], [line for line in b if line in both]
    if not a:
        return []
    if len(a) * len(b) > ALIGNED and len(a) > 1:
        half = len(a) // 2
        longest = [0, 0]
        for k, (x, y) in enumerate(((a[:half], b), (a[half:][::-1], b[::-1]))):
            for row in table_rows(x, y):
                pass
            bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
            longest[k] = np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))
        cut = int((longest[0] + longest[1][::-1]).argmax())
        return [place[i] for i in aligned(a[:half], b[:cut])] + [place[half + i] for i in aligned(a[half:], b[cut:])]
    rows, out = list(table_rows(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append(place[i])
    return out[::-1]


def place_of(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), parts.path
    except ValueError:
        return "", url or ""


def nearness(a: str, b: str) -> int:
    """Path segments, then characters, that two paths begin with alike."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n].count("/") * 10_000 + n


def own_lines(lines: list[str], neighbours: list[tuple[str, list] | None], path: str) -> set[int] | None:
    """Places of the lines that the nearest neighbour does not share; None if no neighbour tells.

    The nearest neighbour that leaves the page a line of its own decides; one that has them all is a
    copy of the page.
    """
    for _, other in sorted((n for n in neighbours if n), key=lambda n: -nearness(path, n[0])):
        left = set(range(len(lines))) - common_lines(lines, [t for _, t in other])
        if left:
            return left
    return None


def text_of(own: list, neighbours: list[tuple[str, list] | None], path: str) -> str:
    """The text of a page's lines, given its neighbours' (path, lines) in the order of URL paths.

    Every page is differenced, and lines of its own are text. A check by elements follows: lines of
    an article are text all the same where siblings share them. If no neighbour tells, the article
    is the text, or the whole page where there is none.
    """
    left = own_lines([t for _, t in own], neighbours, path)
    if left is None:
        left = set() if any(kind == SETTLED for kind, _ in own) else set(range(len(own)))
    return "\n\n".join(t for k, (kind, t) in enumerate(own) if kind == SETTLED or k in left)


OUT = "page_id long, url string, text string, n_chars long"
LAID = "page_id long, url string, host string, path string, lines binary, part int, guest boolean"
SAMPLE = 20  # pages looked at for each bound between ranges


def pack(lines: list, squeeze: Callable) -> bytes:
    return squeeze(json.dumps(lines).encode())


def unpack(data: bytes, expand: Callable) -> list:
    return json.loads(expand(data))


def order_of(host: str, path: str, page_id: int | None) -> tuple:
    return host, path, page_id is None, page_id or 0


def bounds_of(pages: DataFrame, parts: int) -> list[tuple]:
    """Where ranges of pages end, from a sample of about SAMPLE * ``parts`` pages. Bounds decide which task walks a page, not what comes of it.

    Rows are drawn one by one: the first of an order would send that many rows of each task to the driver.
    """
    total = pages.count() if parts > 1 else 0
    if not total:
        return []
    some = pages.select("url", "page_id").sample(min(1.0, SAMPLE * parts / total), seed=1).collect()
    keys = sorted(order_of(*place_of(r["url"]), r["page_id"]) for r in some)
    return sorted(set(keys[len(keys) * k // parts] for k in range(1, parts))) if keys else []


def guests_of(pages: DataFrame, bounds: list[tuple]) -> dict[tuple, list[int]]:
    """Keys of the pages at the ends of ranges, each with the ranges beside its own: its neighbours there need it. Two keys a range go to the driver."""
    if not bounds:
        return {}

    def place(batches):
        for batch in batches:
            got = batch.to_pydict()
            keys = [order_of(*place_of(u), i) for u, i in zip(got["url"], got["page_id"])]
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array([k[n] for k in keys], t) for n, t in enumerate(kinds)), pa.array([bisect_right(bounds, k) for k in keys], pa.int32())], ["host", "path", "none", "id", "part"])

    key = F.struct("host", "path", "none", "id")
    placed = pages.select("url", "page_id").mapInArrow(place, "host string, path string, none boolean, id long, part int")
    ends = sorted(placed.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect(), key=lambda r: r["part"])
    out: dict[tuple, list[int]] = {}
    for one, then in zip(ends, ends[1:]):
        if one["last"]["host"] == then["first"]["host"]:  # pages of other hosts are no neighbours
            out.setdefault(tuple(one["last"]), []).append(then["part"])
            out.setdefault(tuple(then["first"]), []).append(one["part"])
    return out


def page_text(pages: DataFrame, part_bytes: int = 1 << 20) -> DataFrame:
    """page_id, url, text, n_chars of every page; see the module.

    Character references are decoded, white space in a block is one space, blocks are joined by an
    empty line. A neighbour that has all of a page's lines is a copy and deletes nothing.

    A null html is empty, a null or broken url has no host and stands with its likes. Pages with one
    path stand in the order of page_id, null last. A host with one page has no neighbour. Empty
    tables give empty results. Other columns are ignored. Pages are put in order and walked once,
    over at most 2000 ranges; the page at an end of a range goes to the range beside it as well, as a
    guest that is a neighbour there and no row.
    """
    ship(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    parts = min(2000, parts_for(text_bytes(pages, "html"), part_bytes))
    bounds = bounds_of(pages, parts)
    guests = guests_of(pages, bounds)

    def read(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            got = batch.to_pydict()
            keys = [order_of(*place_of(u), i) for u, i in zip(got["url"], got["page_id"])]
            part = [bisect_right(bounds, k) for k in keys]
            lines = [pack(lines_of(h), squeeze) for h in got["html"]]
            sent: dict[tuple[int, int], int] = {}  # of pages with one key only the outermost can be a neighbour
            for k, key in enumerate(keys):
                for to in guests.get(key, ()):
                    other = sent.get((to, part[k]))
                    if other is None or (lines[k] > lines[other]) == (to > part[k]):
                        sent[to, part[k]] = k
            rows = [*range(len(keys)), *sent.values()]
            ids = batch.select(["page_id", "url"]).take(pa.array(rows, pa.int64()))
            columns = [pa.array([keys[k][n] for k in rows], pa.string()) for n in (0, 1)]
            columns += [pa.array([lines[k] for k in rows], pa.binary()), pa.array([*part, *(to for to, _ in sent)], pa.int32()), pa.array([n >= len(keys) for n in range(len(rows))])]
            yield pa.RecordBatch.from_arrays([*ids.columns, *columns], ["page_id", "url", "host", "path", "lines", "part", "guest"])

    laid = pages.mapInArrow(read, LAID).repartition(parts, "part")
    laid = laid.sortWithinPartitions("part", "host", "path", F.col("page_id").asc_nulls_last(), "lines")

    def done(page: tuple, *near: tuple | None) -> tuple:
        page_id, url, host, path, lines, part, _ = page
        text = text_of(lines, [(n[3], n[4]) if n and n[5] == part and n[2] == host else None for n in near], path)
        return page_id, url, text, len(text)

    def walk(batches):
        """Each page with the one before and the one after it."""
        expand = zstandard.ZstdDecompressor().decompress
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        rows = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["page_id", "url", "text", "n_chars"])
        before = page = None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                after = (*row[:4], unpack(row[4], expand), *row[5:])
                if page and not page[6]:
                    out.append(done(page, before, after))
                before, page = page, after
            yield rows(out)
        if page and not page[6]:
            yield rows([done(page, before, None)])

    return laid.mapInArrow(walk, OUT)


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_page_text": op9_page_text}
SQL: dict[str, str] = {}
