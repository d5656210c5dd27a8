"""Main text of pages by differencing the nearest pages of a host.

A page is cut into lines, one per block element. Elements that declare what they are
decide at once: menus, headers, footers, sidebars, forms, scripts and styles go, as
does what is named an advert, notice, comment and the like, article elements too. A name
counts if it is a whole class or id, or if all its other parts are usual beside it
(``cookie-notice``, not ``notice-of-meeting``). A form, an element named like a layout's
frame and a skipped element that is never closed may also stand around the whole page: an
article or main element inside is not dropped with them, and if most text of a page or all
that is left lies in such a frame, its lines are kept and compared. If
the article or main elements hold most of the text that is left, their lines stay.
What remains open (all other lines, and lines made of links only) is compared with
the page of the same host whose path is nearest: neighbours in path order, the one
that shares more leading parts of the path, the earlier one if equal. A longest
common subsequence aligns the two pages' open lines, and shared lines are deleted. If that would leave a page without
any line, the two pages are copies and nothing is deleted.

Why elements come first: where every page's menu has words of its own, and articles
share passages, differencing alone keeps the menus and cuts the articles.

Finding neighbours moves addresses only. They are range-partitioned by host and path,
so a host with most of the pages is spread over tasks; neighbours across ranges come
from a table of the ranges' ends. Only pages with open lines are moved for the
comparison, with the hashes of their partner's lines.

Defined cases: null or empty html gives an empty text; pages without a host share one
empty host; rows that repeat an address are neighbours; unclosed elements end with
the elements around them, and unclosed scripts, styles and titles with the page. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.session import stored

# Names of the markup language, and names that pages give to what is no article.
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "title"}
_TO_THE_END = {"script", "style", "title"}  # of these, what takes the rest of the page if it is not closed
_SKIPPED = {"head", "nav", "header", "footer", "aside", "button", "select", "textarea", "dialog", "menu"}
_FORMS = {"form", "fieldset", "label"}
_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl",
           "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
           "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table",
           "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_ARTICLE = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
          "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login",
          "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay",
          "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond",
          "search", "share", "sharing", "sidebar", "signup", "sitemap", "social", "sponsor", "sponsored",
          "subscribe", "toolbar", "widget"}
#: Of these, names that layouts also give to the frame around the whole article.
_FRAMES = {"banner", "footer", "masthead", "menu", "modal", "nav", "navbar", "overlay", "sidebar", "toolbar", "widget"}
#: What stands beside such names in a class or id without changing what they say.
_PARTNERS = {"a", "area", "article", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container",
             "content", "desktop", "entry", "fixed", "form", "global", "group", "header", "inner", "item", "items", "left",
             "link", "links", "list", "main", "message", "mobile", "outer", "page", "panel", "post", "posts", "primary",
             "right", "secondary", "section", "site", "slot", "sticky", "text", "title", "top", "unit", "wrap", "wrapper", "zone"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^>]*+)>|([^<]++|<)",
    re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: A value without quotes takes a slash at the end of its tag.
_OPEN_VALUE = re.compile(r"=\s*[^\s\"'][^\s]*/\Z")


def _said(name: str) -> set[str]:
    """The telling parts of a class or id, if its other parts are only their usual partners."""
    parts = {part.rstrip("0123456789") for part in re.split("[-_:]+", name)} - {"", "x"}
    telling = parts & _NAMES
    return telling if parts <= _NAMES | _PARTNERS else set()


def _named_away(attributes: str) -> int:
    """Whether class, id or role say that an element is no part of an article: 1, or 4 if it may be a frame around one."""
    frame = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        names = "".join(values).lower().split()
        if name.lower() == "role":
            if _ROLES.intersection(names):
                return 1
            continue
        words = set().union(*map(_said, names))
        if words - _FRAMES:
            return 1
        if words:
            frame = 4
    return frame


def _events(page: str) -> tuple[list[tuple[str | None, str | int]], set[int]]:
    """Texts (None, text), opening tags (tag, attributes) and closing tags (tag, number of elements that end), in
    order; and the places of the opening tags that have a closing one. One pass, whatever the page holds."""
    events: list[tuple[str | None, str | int]] = []
    closed: set[int] = set()
    stack: list[tuple[str, int]] = []  # open elements: tag, place among the events
    places: dict[str, list[int]] = {}  # of each tag in the stack
    endless: set[str] = set()  # raw elements that no tag closes any more

    def end(depth: int) -> None:
        events.append((stack[depth][0], len(stack) - depth))
        for tag, _ in stack[depth:]:
            places[tag].pop()
        del stack[depth:]

    at, last = 0, page.rfind(">")
    while at <= last and (match := _TOKEN.match(page, at)):
        at = match.end()
        closing, tag, attributes, text = match.groups()
        if text is not None:
            events.append((None, text))
        if tag is None:
            continue
        tag = tag.lower()
        if stack and stack[-1][0] == "head" and not closing and tag not in _HEAD:
            end(len(stack) - 1)
        if closing:
            if places.get(tag):
                closed.add(stack[places[tag][-1]][1])
                end(places[tag][-1])
            else:
                events.append((tag, 0))
        elif tag in _RAW:
            if not (attributes.endswith("/") and not _OPEN_VALUE.search(attributes)) and tag not in endless:
                after = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if not after:
                    endless.add(tag)
                at = after.end() if after else len(page) if tag in _TO_THE_END else at
        elif tag in _VOID or attributes.endswith("/"):
            events.append((tag, 0))
        else:
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, len(events)))
            events.append((tag, attributes))
    if at < len(page):
        events.append((None, page[at:]))
    return events, closed


def page_lines(page: str) -> list[tuple[str, bool]]:
    """The lines of a page that are not declared away: text, and whether differencing decides about it."""
    lines: list[tuple[str, int, bool]] = []  # text, 0 outside / 1 in an article / 2 in one that is framed, links only
    # lines dropped with a frame and how many kept ones stand before each, by its place and whether it is only named so
    framed: dict[tuple[int, bool], list[tuple[str, int]]] = {}
    # 0 kept / 1 named away / 2 away / 3 an article's header / 4 perhaps a frame, article as above, in a link, which frame
    stack: list[tuple[int, int, bool, tuple[int, bool]]] = []
    state = away, article, link, frame = 0, 0, False, (0, False)
    linked = plain = False
    line: list[str] = []

    def end_line() -> None:
        nonlocal linked, plain
        text = " ".join(entities.unescape("".join(line)).split())
        if text and away == 4:
            framed.setdefault(frame, []).append((text, len(lines)))
        elif text:
            lines.append((text, article, linked and not plain))
        line.clear()
        linked = plain = False

    events, closed = _events(page)
    for place, (tag, what) in enumerate(events):
        if tag is None:
            if away in (0, 4):
                line.append(what)
                if not what.isspace():
                    linked, plain = linked or link, plain or not link
            continue
        if tag == "br":
            line.append(" ")
            continue
        if tag in _BLOCKS:
            end_line()
        if isinstance(what, int):
            if what:
                del stack[len(stack) - what:]
                away, article, link, frame = stack[-1] if stack else state
            continue
        before = away
        if tag in _ARTICLE:
            named = _named_away(what)
            if away in (0, 4) and named == 1:
                away = 1
            elif away == 4 or not away and named:
                away, article = 0, 2
            elif not away:
                article = article or 1
        elif tag == "header" and article:  # an article's own header holds its headline
            away = away or 3
        elif tag in _HEADINGS and away == 3:
            away = 0
        elif tag in _SKIPPED:
            away = 2 if place in closed or away in (1, 2) else 4
        elif tag in _FORMS:
            away = away or 4
        elif not away and tag not in ("html", "body") and what:
            away = _named_away(what)
        if away == 4 and before != 4:
            frame = (place, tag not in _FORMS | _SKIPPED)
        link = link or tag == "a"
        stack.append((away, article, link, frame))
    end_line()
    held = [sum(len(text) for text, where, links in lines if where == k and not links) for k in range(3)]
    if held[2] > held[0] + held[1]:  # the name was that of a frame around the article
        lines, held[1] = [(text, min(where, 1), links) for text, where, links in lines], held[1] + held[2]
    decided = held[1] > held[0]
    kept = [(text, links or not (where and decided), n) for n, (text, where, links) in enumerate(lines) if where < 2]
    sizes = {key: sum(len(text) for text, _ in found) for key, found in framed.items()}
    around = max(sizes, key=sizes.get, default=None)
    if around and (not kept or not around[1] and sizes[around] > held[0] + held[1]):
        kept = sorted([(text, True, n - 0.5) for text, n in framed[around]] + kept, key=lambda x: x[2])
    return [(text, asked) for text, asked, _ in kept]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts, lines, marks, open_ = [], [], [], []
        for page in batch.column(0):
            found = page_lines(page.as_py() or "")
            undecided = [_hash(text) for text, asked in found if asked]
            open_.append(undecided)
            texts.append(None if undecided else "\n\n".join(text for text, _ in found))
            lines.append([text for text, _ in found] if undecided else None)
            marks.append([asked for _, asked in found] if undecided else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row + np.arange(len(batch))), *batch.columns[1:], pa.array(texts, pa.string()),
             pa.array(lines, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.bool_())),
             pa.array(open_, pa.list_(pa.int64()))],
            ["row", *batch.schema.names[1:], "text", "lines", "asked", "open"])
        row += len(batch)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and every beginning of ``b``."""
    now = np.zeros(len(b) + 1, np.int32)
    for x in a:
        now[1:] = np.maximum.accumulate(np.maximum(now[1:], now[:-1] + (b == x)))
    return now


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of ``a`` belong to a longest common subsequence with ``b``; memory is linear."""
    shared = np.zeros(len(a), bool)
    todo = [(0, len(a), b)]
    while todo:
        begin, end, b = todo.pop()
        part = a[begin:end]
        b = b[np.isin(b, part)]
        if not len(b) or begin == end:
            continue
        if end - begin == 1:
            shared[begin] = True
            continue
        middle = (begin + end) // 2
        left, right = _lengths(a[begin:middle], b), _lengths(a[middle:end][::-1], b[::-1])[::-1]
        cut = int((left + right).argmax())
        todo += [(begin, middle, b[:cut]), (middle, end, b[cut:])]
    return shared


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for lines, asked, open_, other in zip(*(c.to_pylist() for c in batch.columns[2:])):
            gone = iter(common(np.array(open_, np.int64), np.array(other or [], np.int64)).tolist())
            kept = [line for line, ask in zip(lines, asked) if not (ask and next(gone))]
            texts.append("\n\n".join(kept or lines))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                         ["page_id", "url", "text"])


def nearest(pages: DataFrame) -> DataFrame:
    """row and partner (the row of the nearest page of the same host, or null); ``pages`` has row and url."""
    host, path = (F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)(.*)$", k)
                  for k in (1, 2))
    order = ["host", "path", "row"]
    ranged = stored(pages.select(F.lower(host).alias("host"), path.alias("path"), "row")
                    .repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "addresses")
    here = F.struct("host", "path", "row")
    ends = ranged.groupBy("part").agg(F.min(here).alias("low"), F.max(here).alias("high"))
    parts = Window.orderBy("part")  # one row per range
    ends = ends.select("part", F.lag("high").over(parts).alias("below"), F.lead("low").over(parts).alias("above"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = ranged.join(F.broadcast(ends), "part").select(
        *order, F.coalesce(F.lag(here).over(inside), "below").alias("before"),
        F.coalesce(F.lead(here).over(inside), "above").alias("after"))

    def alike(other: str) -> Column:
        """Parts of the path that agree from the beginning; null on another host."""
        own, its = (F.split(c, "[/?&=#.]") for c in (F.col("path"), F.col(f"{other}.path")))
        differ = F.array_position(F.zip_with(own, its, lambda a, b: ~a.eqNullSafe(b)), True)
        return F.when(F.col(f"{other}.host") == F.col("host"), F.when(differ > 0, differ - 1).otherwise(F.size(own)))

    before, after = F.coalesce(alike("before"), F.lit(-1)), F.coalesce(alike("after"), F.lit(-1))
    return placed.select("row", F.when((before < 0) & (after < 0), None).when(before >= after, F.col("before.row"))
                         .otherwise(F.col("after.row")).alias("partner"))


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
               html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    kind = pages.schema[id_column].dataType.simpleString()
    read = stored(
        pages.select(F.col(html_column).alias("html"), F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))
        .mapInArrow(_read, f"row long, page_id {kind}, url string, text string, lines array<string>, "
                           "asked array<boolean>, open array<long>"), "page-lines")
    open_ = read.where("text IS NULL")
    other = read.select(F.col("row").alias("partner"), F.col("open").alias("other"))
    compared = (
        open_.join(nearest(read.select("row", "url")), "row").join(other, "partner", "left")
        .select("page_id", "url", "lines", "asked", "open", "other")
        .mapInArrow(_differenced, f"page_id {kind}, url string, text string")
    )
    return read.where("text IS NOT NULL").select("page_id", "url", "text").unionByName(compared).withColumn(
        "n_chars", F.char_length("text").cast("long"))
