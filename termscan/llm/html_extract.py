"""Main text of web pages, by nearest-URL page differencing.

A page is read into blocks of text. Pages of a host are put in the order of their URL paths; each is compared with the
neighbour whose path begins most like its own (with both if alike; the one that shares more counts). The blocks of the two
are aligned by a longest common subsequence: templates, notices and menus repeat from page to page, so what a page shares is
not its own. A neighbour that shares nearly all of the page (`COPY` of its characters) is a copy of it and says nothing.

Differencing decides which part of a page is its main text: of its article (and main) elements those that hold a block of
their own are kept, all of them whole, since two pages may quote the same line; if none does, all are kept. Blocks outside of
such elements are kept only on pages without any, and there only those that are the page's own.

Differencing alone leaves menus, adverts and footers that differ from page to page, so the page's own marks come first:
elements like nav, footer or form, and elements with a class, role or id that names such a part and nothing else, are left
out. Marks on headings don't count, nor do ids inside articles. A page of which nothing is left so is read once more, and
then classes, roles and ids don't count on articles, nor does what they say of elements around an article.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by an empty
line. Null html counts as empty and gives the empty text, as does a page without main text. Null URLs are one host with
an empty path. Every row gives a row; rows with the same page_id are rows of their own. Very long pages are read whole, in
time in proportion to their length (alignment: blocks times blocks / 64). Once a tag's quotes never close, quotes no longer
count on that page. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, out, sliced, texts

#: HTML elements by their part in a page.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset("nav footer aside form button select dialog template noscript svg object canvas menu datalist head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Words in class, id or role that name parts beside the main text.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside rail menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead topbar footer foot bottombar "
    "comment comments reply replies disqus respond share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "search widget widgets toolbar hidden contentinfo complementary".split()
)
#: Words that may stand beside those in a name, like comment-list or site-footer.
PLACES = frozenset("site page global main top bottom left right side primary secondary list box container wrapper wrap area section block bar links form buttons unit slot inner outer skip body item".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|/|$|=(?![\"']?until))|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_VALUES = re.compile(r"(=\s*)(?:\"[^\"]*\"|'[^']*')")
_WORD = re.compile(r"[a-z]+")
#: The share of a page's characters from which a neighbour that has them is a copy.
COPY = 0.9


def _beside(attributes: str, inside: bool) -> bool:
    """Whether a class, role or (outside articles) id names a part beside the main text, or the element is hidden."""
    for kind, a, b, c in _NAMES.findall(attributes):
        if kind.lower() == "id" and inside:
            continue
        for name in (a or b or c).lower().split():
            words = _WORD.findall(name)
            if not BESIDE.isdisjoint(words) and all(w in BESIDE or w in PLACES for w in words):
                return True
    if "hidden" in attributes.lower() or "display" in attributes.lower():
        return bool(_HIDDEN.search(attributes if "style" in attributes.lower() or "aria" in attributes.lower() else _VALUES.sub(r"\1x", attributes)))
    return False


def blocks_of(html: str) -> list[tuple[str, int]]:
    """The page's blocks outside the parts that its marks name as beside the main text, with the number of the innermost article
    or main element that each is in, 0 outside of any."""
    return _blocks(html, False) or _blocks(html, True)


def _blocks(html: str, anyway: bool) -> list[tuple[str, int]]:
    """The same; anyway: articles are read even where a class, role or id leaves them or what they stand in out."""
    found: list[tuple[str, int]] = []
    parts: list[str] = []
    frames: list[list] = []  # open parts: name, depth of elements of that name, number (None: left out), whether articles in it are read
    articles, at, last, loose = 0, 0, html.rfind(">"), False
    ends_at: dict[str, int] = {}
    lowered = None

    def close() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((text, frames[-1][2] if frames else 0))

    while at <= last:
        start = html.find("<", at)
        if start < 0 or start >= last:
            break
        reading = not frames or frames[-1][2] is not None
        if reading and start > at:
            parts.append(html[at:start])
        if html.startswith("<!--", start):
            stop = html.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else len(html)
            continue
        if html[start + 1] in "!?":
            at = html.find(">", start) + 1
            continue
        m = (_LOOSE if loose else _TAG).match(html, start)
        if not m and not loose and (m := _LOOSE.match(html, start)):
            loose = True
        if not m:
            if reading:
                parts.append("<")
            at = start + 1
            continue
        at = m.end()
        name, ends, attributes = m[2].lower(), bool(m[1]), m[3]
        if not reading:
            frame = frames[-1]
            if frame[0] == "p" and name in BLOCKS and (name != "p" or not ends):
                frames.pop()
                at = start
                continue
            if name == frame[0] and not attributes.endswith("/"):
                frame[1] += -1 if ends else 1
                if not frame[1]:
                    frames.pop()
                continue
            if ends or not frame[3] or name not in ("article", "main"):
                if not ends and name in RAW:
                    stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                    at = stop.end() if stop else len(html)
                continue
        if name in BLOCKS:
            close()
        elif name == "br":
            parts.append(" ")
        if frames and name == frames[-1][0] and frames[-1][2] is not None:
            if ends:
                frames.pop()
                continue
        elif ends:
            continue
        inside = any(f[2] for f in frames)
        if name in ("article", "main") and (anyway or not _beside(attributes, inside)):
            articles += 1
            frames.append([name, 1, articles, False])
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else len(html)
            continue
        if name in VOID or attributes.endswith("/") or name in ("html", "body") or len(name) == 2 and name[0] == "h" and name[1].isdigit():
            continue
        by_tag = name in DROPPED or name == "header" and not inside
        if by_tag or attributes and _beside(attributes, inside):
            if name not in ends_at:
                lowered = html.lower() if lowered is None else lowered
                ends_at[name] = lowered.rfind(f"</{name}")
            if name == "p" or ends_at[name] >= at:  # one that never ends would take the rest of the page
                close()
                frames.append([name, 1, None, anyway and not by_tag])
    if not frames or frames[-1][2] is not None:
        parts.append(html[at:])
    close()
    return found


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b: rows of bits, one for each line of b, kept at every k-th line of a."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found = {*range(low), *range(len(a) - high, len(a))}
    b = b[low : len(b) - high]
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    rows = [(i, where[a[i]]) for i in range(low, len(a) - high) if a[i] in where]
    full, step = (1 << len(b)) - 1, int(len(rows) ** 0.5) + 1

    def after(bits: int, mask: int) -> int:
        met = bits & mask
        return (bits + met | bits - met) & full

    kept, bits = [], full  # a bit is clear where the subsequence grows by that line of b
    for k, (_, mask) in enumerate(rows):
        if k % step == 0:
            kept.append(bits)
        bits = after(bits, mask)
    j = len(b) - 1
    for block in range(len(kept) - 1, -1, -1):
        stretch, states = rows[block * step : (block + 1) * step], [kept[block]]
        for _, mask in stretch:
            states.append(after(states[-1], mask))
        k = len(stretch)
        while k and j >= 0:
            if states[k] >> j & 1:
                j -= 1
            else:
                k -= 1
                if states[k] >> j & 1:
                    found.add(stretch[k][0])
                    j -= 1
    return found


def main_text(lines: list[str], inside: list[int], neighbours: list[list[str]]) -> str:
    """The page's main text, given its blocks, the article that each is in and the blocks of the nearest pages."""
    size, shared, most = sum(map(len, lines)), set(), -1
    for other in neighbours:
        found = common_lines(lines, other)
        held = sum(len(lines[i]) for i in found)
        if most < held < COPY * size:
            shared, most = found, held
    own = {inside[i] for i in range(len(lines)) if i not in shared}
    if any(inside):
        kept = own - {0} or set(inside) - {0}
        return "\n\n".join(x for x, k in zip(lines, inside, strict=True) if k in kept)
    return "\n\n".join(x for i, x in enumerate(lines) if i not in shared)


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


_READ = pa.schema([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("lines", pa.binary()), ("inside", pa.list_(pa.int32()))])
_READ_SQL = "host string, path string, page_id long, url string, lines binary, inside array<int>"
_DONE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("seat", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.string())), ("inside", pa.list_(pa.int32())), ("next_path", pa.string()), ("next_lines", pa.list_(pa.string()))])
_DONE_SQL = "page_id long, url string, text string, part int, seat int, host string, path string, lines array<string>, inside array<int>, next_path string, next_lines array<string>"


def _address(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        return "", url or ""


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "html"):
        addresses = [_address(u) for u in batch.column("url").to_pylist()]
        found = [blocks_of(h) for h in texts(batch, "html")]
        yield out({"h": [x[0] for x in addresses], "p": [x[1] for x in addresses], "i": batch.column("page_id"), "u": batch.column("url"), "l": [zlib.compress("\n".join(x for x, _ in f).encode(), 3) for f in found], "in": [[i for _, i in f] for f in found]}, _READ)


def _nearest(page: tuple, *others: tuple | None) -> list[list[str]]:
    """The lines of the neighbour on the same host whose path begins most like the page's; of both if they are alike."""
    alike = [(_alike(x[1], page[1]), x[4]) for x in others if x and x[0] == page[0]]
    best = max((n for n, _ in alike), default=0)
    return [lines for n, lines in alike if n == best]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order, each with both neighbours; the first and last of a part go on with the neighbour they have."""
    part, before, page = TaskContext.get().partitionId(), None, None
    edges = []

    def done(page: tuple, before: tuple, after: tuple) -> tuple:
        return (page[2], page[3], main_text(page[4], page[5], _nearest(page, before, after)), *[None] * 8)

    def edge(page: tuple, seat: int, other: tuple | None) -> tuple:
        beside = other if other and other[0] == page[0] else None
        return (page[2], page[3], None, part, seat, page[0], page[1], page[4], page[5], beside and beside[1], beside and beside[4])

    for batch in sliced(batches, "path", 1 << 15):
        rows = []
        for after in zip(*(batch.column(c).to_pylist() for c in _READ.names), strict=True):
            after = (*after[:4], zlib.decompress(after[4]).decode().split("\n") if after[5] else [], after[5])  # blocks hold no line feeds
            if page:
                rows.append(done(page, before, after) if before else edge(page, 0, after))
            before, page = page, after
        yield out(dict(enumerate(zip(*rows, strict=True) if rows else [[]] * 11)), _DONE)
    if page:
        edges.append(edge(page, 1, before))
        yield out(dict(enumerate(zip(*edges, strict=True))), _DONE)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last pages of parts, each with its neighbour in its part and those in the parts beside."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for batch in sliced(batches, "path", 1 << 15):
        done = []
        for r in batch.to_pylist():
            page = (r["host"], r["path"], r["page_id"], r["url"], r["lines"], r["inside"])
            others = [(r["host"], r["next_path"], 0, "", r["next_lines"])] if r["next_path"] is not None else []
            others += [(x["host"], x["path"], 0, "", x["lines"]) for x in r["outer"] or () if x["host"] is not None]
            done.append((r["page_id"], r["url"], main_text(page[4], page[5], _nearest(page, *others))))
        yield out(dict(enumerate(zip(*done, strict=True))), schema)


def _met(edges: DataFrame) -> DataFrame:
    """The edges with outer, the edges beside them in the next parts that have rows. Only the parts' numbers reach the driver."""
    seats = sorted((r["part"], r["first"]) for r in edges.groupBy("part").agg(F.min("seat").alias("first")).collect())
    beside = [(p, first, q, 1) for (q, _), (p, first) in zip(seats, seats[1:], strict=False)] + [(p, 1, q, first) for (p, _), (q, first) in zip(seats, seats[1:], strict=False)]
    near = F.broadcast(edges.sparkSession.createDataFrame(beside, "part int, seat int, part_b int, seat_b int"))
    other = edges.select(F.col("part").alias("part_b"), F.col("seat").alias("seat_b"), F.struct("host", "path", "lines").alias("o"))
    outer = near.join(other, ["part_b", "seat_b"]).groupBy("part", "seat").agg(F.collect_list("o").alias("outer"))  # two at most
    return edges.join(outer, ["part", "seat"], "left")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    store = Scratch(pages.sparkSession, "html-extract")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    order = ["host", "path", "page_id"]
    done = store.put(rows.mapInArrow(_read, _READ_SQL).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compared, _DONE_SQL), "pages")
    edges = _met(done.where("text is null")).mapInArrow(_edges, "page_id long, url string, text string")
    return done.where("text is not null").select("page_id", "url", "text").unionByName(edges).withColumn("n_chars", F.length("text").cast("long"))
