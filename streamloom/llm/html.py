"""HTML extraction: nearest-URL page differencing.

Pages are laid out in order of host and URL path, so that a page stands beside
the pages of its host whose paths are nearest to its own. All its lines of text
are aligned with those of either neighbour by longest common subsequence, and
lines that it shares with one are template and deleted, inside an ``article`` or
``main`` element too. The guard for copied articles: if what a page shares with
a neighbour holds half or more of the characters of its article, the neighbour
has a copy of the article, and deletes none of its lines. Markup is a check on
what is left: lines of menus, headers, footers, sidebars, notices, adverts,
forms and comments go, and if lines of an article are left, only they stay.
Scripts, styles and the like are no text.

Pages are cut into chunks of their order by bounds, so a host with a third of
all pages spreads over many tasks. Every chunk also gets the nearest pages
before and after it that its first and last pages are to be compared with, so
the result depends neither on the bounds nor on partitions.

Nulls: a null html is empty and gives an empty text; a null url has host ''.
A page is compared with the nearest page before and after it whose html differs
from its own, never with its own copies.
Empty tables give no rows; extra columns are ignored. Very long pages are
parsed in one pass, and alignment works on the lines that both pages have.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Elements of the HTML standard by what they mean for extraction.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"))
CHROME = frozenset(("nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "object", "audio", "video", "canvas"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"))
#: Words of class and id that name a part that is not the article.
PARTS = frozenset(("ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promoted", "related", "replies", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"))

#: Where markup puts a line: ruled out, outside an article, or inside one.
RULED, OUTSIDE, ARTICLE = range(3)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


def _is_part(name: str, attributes: str) -> bool:
    if name in CHROME:
        return True
    if attributes and name not in ("html", "body", "article", "main"):
        for m in _NAMES.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                if not PARTS.isdisjoint(re.split(r"[^a-z]+", value)):
                    return True
            elif key == "role":
                if value in ROLES:
                    return True
            elif key == "hidden" or value == "true":
                return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, place) of each block, in order; ruled-out text within a line is a block of its own after it."""
    out: list[tuple[str, int]] = []
    parts: tuple[list[str], list[str]] = ([], [])  # open text, and open text that is ruled out
    stack: list[tuple[str, bool]] = []  # open elements, and whether each rules its content out
    ruled, inside, at = 0, 0, 0

    def close() -> None:
        for part, place in zip(parts, (ARTICLE if inside else OUTSIDE, RULED)):
            if part:
                text = _SPACE.sub(" ", entities.unescape("".join(part))).strip()
                part.clear()
                if text:
                    out.append((text, place))

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            parts[ruled > 0].append(page[at:])
            break
        if m.start() > at:
            parts[ruled > 0].append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, attributes = (m[1] or m[4] or "") == "/", m[3] or m[6] or ""
        if name in INLINE or name in VOID:
            if name == "br":
                parts[ruled > 0].append(" ")
            elif name == "hr":
                close()
            if name in VOID or name not in ("span", "a", "label"):
                continue
            if not ending and not _is_part(name, attributes) and not ruled:
                continue
        else:
            close()
        if ending:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                for tag, rules in stack[depth:]:
                    ruled -= rules
                    inside -= tag in ("article", "main")
                del stack[depth:]
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif not attributes.endswith("/"):
            if name == "p" and stack and stack[-1][0] == "p":
                ruled -= stack.pop()[1]
            rules = _is_part(name, attributes)
            stack.append((name, rules))
            ruled += rules
            inside += name in ("article", "main")
    close()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``, by Hunt and Szymanski's method."""
    where = defaultdict(list)
    for j, line in enumerate(b):
        where[line].append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def main_text(own: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]]) -> str:
    """The lines of a page that stay after differencing with its neighbours and the check of markup, joined by empty lines."""
    lines, shared = [t for t, _ in own], set()
    inside = {i: len(t) for i, (t, place) in enumerate(own) if place == ARTICLE}
    for other in neighbours:
        found = common(lines, [t for t, _ in other])
        if 2 * sum(inside.get(i, 0) for i in found) >= sum(inside.values()):
            found -= inside.keys()
        shared |= found
    left = [x for i, x in enumerate(own) if i not in shared and x[1] != RULED]
    article = [t for t, place in left if place == ARTICLE]
    return "\n\n".join(article or [t for t, _ in left])


class _Assign:
    """Adds the chunk of each page, and rows that stand beside a chunk: -1 before it, 1 behind it, 0 in it."""

    def __init__(self, layout):
        self.layout = layout

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, beside = self.layout.value
        for batch in batches:
            rows, chunks, sides = [], [], []
            for i, key in enumerate(_order(batch)):
                rows.append(i)
                chunks.append(bisect_right(bounds, key))
                sides.append(0)
                for chunk, side in beside.get(key, ()):
                    rows.append(i)
                    chunks.append(chunk)
                    sides.append(side)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(chunks, pa.int32()), pa.array(sides, pa.int32())], [*batch.schema.names, "chunk", "side"])


def _order(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The order of pages: host, path, page_id (nulls first), html."""
    for host, path, page, mark in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "page_id", "mark"))):
        yield host, path, page is not None, page or 0, mark


class _Edges:
    """Per chunk, its first and last page and the first and last whose html differs from that, as far as these rows tell."""

    SCHEMA = "chunk int, host string, path string, page_id long, mark long"

    def __init__(self, bounds):
        self.bounds = bounds

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: dict[int, list] = {}
        for batch in batches:
            for key in _order(batch):
                chunk = bisect_right(self.bounds.value, key)
                edges[chunk] = outer([*edges.get(chunk, ()), key])
        rows = [(chunk, host, path, page if known else None, mark) for chunk, keys in edges.items() for host, path, known, page, mark in keys]
        if rows:
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["chunk", "host", "path", "page_id", "mark"])


def outer(keys: list[tuple]) -> list[tuple]:
    """Of some keys of pages: on either side, the outermost and the outermost of another html than that."""
    keys = sorted(set(keys))
    out = set()
    for side in (keys, keys[::-1]):
        out.add(side[0])
        out.update([k for k in side if k[-1] != side[0][-1]][:1])
    return sorted(out)


def _beside(edges: dict[int, list[tuple]]) -> dict[tuple, list[tuple[int, int]]]:
    """For each page that another chunk needs, that chunk and the side on which the page stands."""
    out: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    chunks = sorted(edges)
    for side, order in ((-1, chunks), (1, chunks[::-1])):
        seen: list[tuple] = []  # the nearest page so far, and the nearest of another html
        for chunk in order:
            for key in seen:
                out[key].append((chunk, side))
            last = edges[chunk] if side == 1 else edges[chunk][::-1]
            near = last + seen
            seen = near[:1] + [k for k in near if k[-1] != near[0][-1]][:1]
    return dict(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of chunk and page; each is compared with the nearest other pages before and after it of its host."""
    before: tuple | None = None  # the last page of another html than the pages that wait
    waiting: list[tuple] = []  # pages of one html, until one of another follows

    def finish(after: tuple | None) -> list[tuple]:
        if not waiting:
            return []
        near = [x for x in (before, after) if x]
        done = []
        for side, page, url, host, _, own in waiting:
            if side == 0:
                text = main_text(own, [x[5] for x in near if x[3] == host])
                done.append((page, url, text, len(text)))
        return done

    chunk = None
    for batch in batches:
        done = []
        for at, side, page, url, host, html, mark in zip(*(batch.column(c).to_pylist() for c in ("chunk", "side", "page_id", "url", "host", "html", "mark"))):
            if at != chunk:
                done += finish(None)
                chunk, before, waiting = at, None, []
            if waiting and waiting[0][4] == mark:
                waiting.append((side, page, url, host, mark, waiting[0][5]))
                continue
            row = (side, page, url, host, mark, blocks(html or ""))
            done += finish(row)
            before = waiting[-1] if waiting else None
            waiting = [row]
        if done:
            yield _batch(done)
    if done := finish(None):
        yield _batch(done)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    page, url, text, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(url, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int64())], ["page_id", "url", "text", "n_chars"])


#: Chunks to a shuffle partition, about.
CHUNKS = 8


def extract(pages: DataFrame, chunks: int | None = None) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Bounds of chunks come from a sample of keys; they say which task does what, never what it answers. The
    driver holds a bound and up to four keys of pages a chunk, no html, and the chunks follow the cluster's
    shuffle partitions, not the pages.
    """
    spark = pages.sparkSession
    chunks = chunks or CHUNKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.col("html").cast("string").alias("html"),
    ).withColumn("mark", F.xxhash64("html"))
    keys = rows.select("host", "path", "page_id", "mark")
    total = keys.count()
    sampled = keys.sample(min(1.0, chunks / total), seed=1).collect() if total else []
    bounds = sorted({(r.host, r.path, r.page_id is not None, r.page_id or 0, r.mark) for r in sampled})
    known = _Edges(spark.sparkContext.broadcast(bounds))
    near: dict[int, list] = {}
    for r in keys.mapInArrow(known, _Edges.SCHEMA).repartition("chunk").mapInArrow(known, _Edges.SCHEMA).collect():
        near.setdefault(r.chunk, []).append((r.host, r.path, r.page_id is not None, r.page_id or 0, r.mark))
    layout = spark.sparkContext.broadcast((bounds, _beside({c: sorted(k) for c, k in near.items()})))
    schema = StructType([*rows.schema.fields]).add("chunk", "integer").add("side", "integer")
    dealt = rows.mapInArrow(_Assign(layout), schema)
    order = ["chunk", "host", "path", "page_id", "mark"]
    return dealt.repartition("chunk").sortWithinPartitions(*order).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
