"""Main text of web pages: nearest-URL page differencing, with the page's own structure.

Pages are cut into text lines, one per block.  Each page is paired with the page of the
same host whose URL path is nearest (its neighbour in path order with which it shares most path
segments), all lines of both are aligned by a longest common subsequence, and shared lines
are deleted: templates repeat from page to page, articles don't.

Differencing alone can't give the main text: a menu or footer that differs from page to
page survives it, and an article that was copied to a nearby page would be deleted with it.
So what it leaves is checked against the page's structure (``main_lines``): lines in menus, headers,
footers, side bars, forms and the like never stay; an ``article`` or ``main`` element of which it leaves
a line is whole again, one that it deletes is a template and goes; undeclared lines that it leaves stay
if they are more text than those elements, or the page declares nothing.  Where it leaves nothing, the page
is a copy of its neighbour and keeps its elements, or its undeclared lines if it has none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import map_arrow, slices
from tallyforge.session import known_size, materialize, scratch_path

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas audio video noframes xmp".split())
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary
table tbody td tfoot th thead tr ul""".split())
MAIN = frozenset("article main".split())
OUTSIDE = frozenset("nav footer aside form head header button select dialog menu search fieldset label datalist".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
OUTSIDE_NAMES = frozenset("""ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation
menu breadcrumb breadcrumbs header masthead footer sidebar aside rail cookie cookies consent gdpr notice notices popup modal overlay newsletter
subscribe subscription signup login share sharing social comment comments respond disqus discussion replies related recommended widget pagination
pager toolbar skip""".split())
# Words that make a class say how a page is laid out, not what the element is; and names that an article's own head has as well.
MODIFIERS = frozenset("has with no without is not hide show".split())
OWN_HEAD = frozenset("header masthead".split())
# An open element of the first kind ends where one of the second begins.
ENDED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
            "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
            "option": frozenset(["option", "optgroup"])}
CLOSE_P = BLOCKS - frozenset(["br", "option", "optgroup", "body", "html", "head"])

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

_FREE, _MAIN, _OUT = 0, 1, 2


def _zone(name: str, attributes: str, parent: int) -> int:
    """Where an element's text belongs, from its name, its attributes and its parent."""
    if parent == _OUT:
        return _OUT
    inside = parent == _MAIN
    zone = _MAIN if name in MAIN else _OUT if name in OUTSIDE and not (inside and name == "header") else parent
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key in ("hidden", "aria-hidden"):
                if key == "hidden" or value == "true":
                    return _OUT
            elif key == "role":
                zone = _MAIN if value in ("main", "article") else _OUT if value in OUTSIDE_ROLES else zone
            elif key == "itemprop":
                zone = _MAIN if value == "articlebody" else zone
            elif name not in ("html", "body"):
                for token in value.split():
                    parts = _NAME_PARTS.split(token)
                    if parts[0] not in MODIFIERS and OUTSIDE_NAMES.intersection(parts) - (OWN_HEAD if inside else frozenset()):
                        return _OUT
    return zone


def page_lines(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each non-empty block, in page order; null and empty pages have none."""
    return [(zone, text) for zone, _, text in placed_lines(page)]


def placed_lines(page: str | None) -> list[tuple[int, int, str]]:
    """As ``page_lines``, with the number of the outermost ``article`` or ``main`` element (from 1) of a line in one."""
    page = page or ""
    lines: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, held, at, elements = _FREE, [], 0, 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                lines.append((zone, elements if zone == _MAIN else 0, text))
            held.clear()

    def pop(names: frozenset[str], within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of ``names`` and what is open in it, but nothing beyond ``within``."""
        nonlocal zone
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                zone = stack[-1][1] if stack else _FREE
                return
            if stack[i][0] in within:
                return

    while True:
        found = _TOKEN.search(page, at)
        text = page[at:found.start() if found else len(page)]
        if text:
            held.append(entities.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        name = found[2]
        if name is None:
            if found[0].startswith("<![CDATA["):
                held.append(found[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        block = name in BLOCKS
        if block:
            flush()
        if found[1]:
            if name not in VOID:
                before = zone
                if any(e[0] == name for e in stack):
                    if not block and held:  # the end of an inline element may end its zone
                        i = max(i for i, e in enumerate(stack) if e[0] == name)
                        if (stack[i - 1][1] if i else _FREE) != before:
                            flush()
                    pop(frozenset([name]))
            continue
        if name in RAW:
            if not found[3].endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if name in CLOSE_P and stack:
            pop(frozenset(["p"]), BLOCKS - frozenset(["p"]))
        for open_, by in ENDED_BY.items():
            if name in by:
                pop(frozenset([open_]), frozenset(["ul", "ol", "menu", "dl", "table", "select", "dir"]))
        own = _zone(name, found[3], zone)
        if own != zone and not block:
            flush()
        elements += own == _MAIN and zone != _MAIN  # while one is open no other begins
        stack.append((name, own))
        zone = own
    flush()
    return lines


# ---- longest common subsequence ----

def shared_lines(a: list, b: list) -> set[int]:
    """Positions in ``a`` of one longest common subsequence of ``a`` and ``b``.

    Bit-parallel: a row of the table is one long integer.  Common ends are cut off
    first; where the rows would take much memory, ``a`` is halved as long as needed.
    """
    found: set[int] = set()
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            found.add(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            found.add(j - 1)
            j, m = j - 1, m - 1
        if i == j or k == m:
            continue
        if (j - i) * (m - k) > 1 << 27 and j - i > 1:
            middle = (i + j) // 2
            head = _lengths(a[i:middle], b[k:m])
            tail = _lengths(a[middle:j][::-1], b[k:m][::-1])[::-1]
            cut = max(range(m - k + 1), key=lambda x: head[x] + tail[x])
            work += [(i, middle, k, k + cut), (middle, j, k + cut, m)]
            continue
        rows = list(_rows(a[i:j], b[k:m]))
        x, y = j - i, m - k
        while x and y:  # a clear bit is a step up of the length along b
            bit = 1 << y - 1
            if rows[x] & bit:
                y -= 1
            elif not rows[x - 1] & bit:
                x -= 1
            else:
                found.add(i + x - 1)
                x, y = x - 1, y - 1
    return found


def _rows(a: list, b: list) -> Iterator[int]:
    places: dict = {}
    for n, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << n
    full = (1 << len(b)) - 1
    row = full
    yield row
    for line in a:
        same = row & places.get(line, 0)
        row = (row + same | row - same) & full
        yield row


def _lengths(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    row = 0
    for row in _rows(a, b):
        pass
    out = [0]
    for n in range(len(b)):
        out.append(out[-1] + (not row >> n & 1))
    return out


# ---- pages ----

def _common(a: Column, b: Column) -> Column:
    """Number of leading path segments that two paths share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def nearest_pages(pages: DataFrame) -> DataFrame:
    """``key``, ``partner`` from distinct ``host, path, key``: the nearest other page of the host, if there is one.

    Nearest are the pages whose paths share most leading segments.  In the order of the paths' segments
    they stand side by side.  Pages lie in ranges of the global order (host, segments, key), each of which is one small
    window; only the first and last page of each range meet across ranges.  A host of any size is thus many ranges.
    """
    placed = materialize(pages.select("host", F.split("path", "/").alias("path"), "key").distinct().repartitionByRange("host", "path", "key")
                         .withColumn("part", F.spark_partition_id()), "page-order")
    page = F.struct("host", "path", "key")
    ends = placed.groupBy("part").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    order = Window.orderBy("part")  # one row per range
    ends = known_size(ends.select("part", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right")), "page-ends")
    inside = Window.partitionBy("part").orderBy("host", "path", "key")
    near = placed.select("*", F.lag(page).over(inside).alias("before"), F.lead(page).over(inside).alias("behind")).join(ends, "part", "left")
    both = near.select("host", "path", "key", F.coalesce("before", "left").alias("before"), F.coalesce("behind", "right").alias("behind"))
    share = [F.when(F.col(f"{side}.host") == F.col("host"), _common(F.col("path"), F.col(f"{side}.path"))).otherwise(-1) for side in ("before", "behind")]
    return (both.select("key", F.when((share[0] >= share[1]) & (share[0] >= 0), F.col("before.key"))
                        .when(share[1] >= 0, F.col("behind.key")).alias("partner")).filter(F.col("partner").isNotNull()))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        lines = [[{"place": -1 if z == _OUT else n, "line": t} for z, n, t in placed_lines(page)] for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("key"),
             pa.array(lines, pa.list_(pa.struct([("place", pa.int32()), ("line", pa.string())])))],
            ["page_id", "url", "key", "lines"])


def main_lines(places: list[int], sizes: list[int], shared: set[int] | None) -> list[int]:
    """Positions of the lines that stay, from where they stand (below 0: menus and the like, 0: undeclared, else the number of the
    declared element), their lengths and which of them the page shares with its partner (None: it has no partner)."""
    left = [i for i, place in enumerate(places) if place >= 0 and i not in (shared or ())]
    elements, free = {places[i] for i in left if places[i]}, [i for i in left if not places[i]]
    own = [i for i, place in enumerate(places) if place in elements]
    kept = own or [i for i, place in enumerate(places) if place > 0]
    if shared is not None and sum(sizes[i] for i in free) > sum(sizes[i] for i in kept):
        return sorted(own + free)
    return kept or free or [i for i, place in enumerate(places) if not place]


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions of each page's lines that stay, where these aren't just its declared elements; lines are compared by their 64-bit marks."""
    for batch in batches:
        keys, kept = [], []
        for key, places, sizes, own, other in zip(*(batch.column(c).to_pylist() for c in ("key", "places", "sizes", "marks", "other")), strict=True):
            found = main_lines(places, sizes, None if other is None else shared_lines(own, other))
            if found != [i for i, place in enumerate(places) if place > 0]:
                keys.append(key)
                kept.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kept, pa.list_(pa.int32()))], ["key", "kept"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html).

    A null html is an empty page, its text is empty.  Pages without a URL are one host.
    Equal rows count as one page when pages are paired, and each gets the text.  Character references are
    decoded, white space inside a block becomes one space, blocks are joined by one.
    """
    whole = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("page_id", "url", "html")])
    keyed = pages.select("page_id", "url", "html", whole.alias("key"))
    kind = pages.schema["page_id"].dataType.simpleString()
    path = scratch_path(pages.sparkSession, "page-lines")
    map_arrow(keyed, _parse, f"page_id {kind}, url string, key long, lines array<struct<place:int,line:string>>") \
        .write.option("compression", "zstd").parquet(path)
    parsed = pages.sparkSession.read.parquet(path)
    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "")
    places = parsed.select("key", F.lower(F.regexp_extract(address, r"^[^/]*", 0)).alias("host"), F.regexp_extract(address, r"^[^/]*(.*)$", 1).alias("path"))
    # Pages meet by marks of their lines, the texts stay where they are until it is known which of them are needed.
    marked = F.struct(F.transform("lines", lambda x: x["place"]).alias("places"), F.transform("lines", lambda x: F.char_length(x["line"])).alias("sizes"),
                      F.transform("lines", lambda x: F.xxhash64(x["line"])).alias("marks"))
    lines = parsed.select("key", marked.alias("m")).filter(F.size("m.marks") > 0).groupBy("key").agg(F.first("m").alias("m")).select("key", "m.*")
    paired = lines.join(nearest_pages(places), "key", "left")
    other = lines.select(F.col("key").alias("partner"), F.col("marks").alias("other"))
    met = paired.join(other, "partner", "left")  # an empty partner tells as much as none
    kept = known_size(map_arrow(met.select("key", "places", "sizes", "marks", "other"), _difference, "key long, kept array<int>"), "kept-lines")
    # Texts move only if many pages keep other lines than their declared elements.
    declared = F.transform(F.filter("lines", lambda x: x["place"] > 0), lambda x: x["line"])
    stay = F.when(F.col("kept").isNull(), declared).otherwise(F.transform("kept", lambda i: F.get("lines", i)["line"]))
    return (parsed.join(kept, "key", "left").select("page_id", "url", F.array_join(stay, " ").alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("long")))
