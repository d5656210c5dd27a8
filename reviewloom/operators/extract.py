"""Reviews from saved HTML pages.

What to take from a page is data: a rule set names the repeated item and its
fields. One Spark job reads a page table and gives one row per item; only the
walk over a single page runs in Python.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewloom.functions.dates import normalise_labelled_date

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template"}


# --- rules ------------------------------------------------------------------
@dataclass(frozen=True)
class Match:
    """An element test: tag, some classes or the whole class text, one attribute."""

    tag: str = ""
    classes: tuple[str, ...] = ()
    class_text: str = ""
    attr: tuple[str, str] | None = None
    parent: "Match | None" = None


@dataclass(frozen=True)
class Field:
    """How to read one value of an item.

    ``paths`` lists alternatives; the first whose first step exists is followed
    step by step. ``kind`` is ``text`` (all text, trimmed), ``last`` (last piece
    of text), ``lines`` (pieces joined by line feeds) or ``count`` (number of
    ``each`` elements whose first ``holds`` element passes).
    """

    kind: str
    paths: tuple[tuple[Match, ...], ...] = ()
    each: Match | None = None
    holds: Match | None = None
    default: str | None = None


@dataclass(frozen=True)
class Rules:
    marker: str
    item: Match
    fields: dict[str, Field] = field(default_factory=dict)


# Element and class names as the three sites publish them.
SITE_RULES = {
    "kakaomap": Rules("list_review", Match("li", parent=Match("ul", ("list_review",))), {
        "rating": Field("count", each=Match("span", ("figure_star", "on"))),
        "date": Field("text", ((Match("span", ("txt_date",)),),)),
        "content": Field("text", ((Match("p", ("desc_review",)),),)),
    }),
    "myrealtrip": Rules("offer-review__list--content", Match("div", ("offer-review__list--content",)), {
        "rating": Field("count", ((Match("div", class_text="starRating starRating--m starRating--blue starRating--"),),),
                        each=Match("svg"), holds=Match("path", attr=("fill", "#51ABF3")), default="0"),
        "date": Field("last", ((Match("div", ("offer-review__list--purpose",)),),), default=""),
        "content": Field("lines", tuple(
            (Match("div", (wrapper,)), Match("div", ("offer-review__list--message",)), Match("div", ("with-more",)))
            for wrapper in ("offer-review__list--wrapper", "offer-review__list--photo-wrapper")), default=""),
    }),
    "tripdotcom": Rules("review-item", Match("div", ("TripReviewItemContainer-sc-1fopyhi-0", "review-item")), {
        "rating": Field("text", ((Match(classes=("review_score",)),),)),
        "content": Field("text", ((Match("p", ("hover-pointer",)),),)),
        "date": Field("text", ((Match("span", ("r", "c2", "create-time")),),)),
    }),
}

PAGE_RULES = Rules("<html", Match("html"), {
    "title": Field("text", ((Match("title"),),)),
    "headline": Field("text", ((Match("article"), Match("h1")),)),
    "paragraphs": Field("count", each=Match("p")),
    "links": Field("count", each=Match("a")),
})


# --- one page ---------------------------------------------------------------
class _Kind:
    """What a start tag says; all elements with the same one share it."""

    __slots__ = ("tag", "attrs", "names", "class_text")

    def __init__(self, tag, attrs):
        self.tag, self.attrs = tag, dict(attrs)
        names = (self.attrs.get("class") or "").split()
        self.names, self.class_text = frozenset(names), " ".join(names)

    def passes(self, m: Match) -> bool:
        return ((not m.tag or self.tag == m.tag) and self.names.issuperset(m.classes)
                and (not m.class_text or self.class_text == m.class_text)
                and (not m.attr or self.attrs.get(m.attr[0]) == m.attr[1]))


class _Element:
    """An element; its descendants and texts are spans of the page's two lists."""

    __slots__ = ("kind", "parent", "hidden", "inner", "after", "text", "text_after")

    def __init__(self, kind, parent, inner, text):
        self.kind, self.parent = kind, parent
        self.hidden = kind.tag in _HIDDEN or (parent is not None and parent.hidden)
        self.inner, self.text = inner, text
        self.after = self.text_after = None

    def passes(self, m: Match) -> bool:
        return self.kind.passes(m) and (m.parent is None or (self.parent is not None and self.parent.passes(m.parent)))


#: Start tags whose end no later text can move, as most are; of these so many are kept as read by a worker.
_PLAIN_TAG = re.compile(r'<[a-zA-Z][a-zA-Z0-9]*(?: +[a-zA-Z][a-zA-Z0-9-]*="[^"<>&]*")* *>')
_PLAIN_END = re.compile("</[a-zA-Z][a-zA-Z0-9]*>")
_KINDS: dict[str, _Kind] = {}
_MOST_KINDS = 4096
#: Elements whose content is read in another way.
_RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}


@functools.cache
def _of_tag(tag: str) -> Match:
    return Match(tag)


class _Page(HTMLParser):
    """All elements and visible texts of a page in document order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements, self.texts, self.in_text = [], [], False
        self.of_tag: dict[str, list[int]] = {}
        self.root = _Element(_Kind("", ()), None, 0, 0)
        self.open = [self.root]
        self.feed(html)
        self.close()
        self._leave(0)

    def updatepos(self, i, j):
        return j  # lines are not counted

    def parse_starttag(self, i):
        end = self.rawdata.find(">", i) + 1
        text = self.rawdata[i:end]
        kind = _KINDS.get(text)
        if kind is None:
            if not _PLAIN_TAG.fullmatch(text):
                return super().parse_starttag(i)
            name, *_ = re.split("[ >]", text[1:], maxsplit=1)
            if name.lower() in _RAW:
                return super().parse_starttag(i)
            kind = _Kind(name.lower(), [(a.lower(), v) for a, v in re.findall(r'([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"', text)])
            if len(_KINDS) < _MOST_KINDS:
                _KINDS[text] = kind
        self.lasttag = kind.tag
        self._start(kind)
        return end

    def parse_endtag(self, i):
        end = self.rawdata.find(">", i) + 1
        text = self.rawdata[i:end]
        if self.cdata_elem is not None or not _PLAIN_END.fullmatch(text):
            return super().parse_endtag(i)
        self.handle_endtag(text[2:-1].lower())
        return end

    def _enter(self, kind):
        self.in_text = False
        element = _Element(kind, self.open[-1], len(self.elements) + 1, len(self.texts))
        self.of_tag.setdefault(kind.tag, []).append(len(self.elements))
        self.elements.append(element)
        return element

    def _leave(self, depth):
        self.in_text = False
        while len(self.open) > depth:
            element = self.open.pop()
            element.after, element.text_after = len(self.elements), len(self.texts)

    def _start(self, kind):
        self.open.append(self._enter(kind))
        if kind.tag in _VOID:
            self._leave(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        self._start(_Kind(tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.open.append(self._enter(_Kind(tag, attrs)))
        self._leave(len(self.open) - 1)

    def handle_endtag(self, tag):
        if len(self.open) > 1 and self.open[-1].kind.tag == tag:
            self._leave(len(self.open) - 1)
            return
        depth = next((d for d in range(len(self.open) - 1, 0, -1) if self.open[d].kind.tag == tag), 0)
        if depth:
            self._leave(depth)

    def handle_data(self, data):
        if self.open[-1].hidden:
            return
        if self.in_text:
            self.texts[-1] += data
        else:
            self.texts.append(data)
            self.in_text = True

    def handle_comment(self, data):
        self.in_text = False

    def all(self, element: _Element, m: Match) -> Iterator[_Element]:
        if not m.tag:
            return (e for e in self.elements[element.inner:element.after] if e.passes(m))
        at = self.of_tag.get(m.tag, [])
        own = at[bisect_left(at, element.inner):bisect_left(at, element.after)]
        return (e for e in map(self.elements.__getitem__, own) if e.passes(m))

    def first(self, element: _Element | None, m: Match) -> _Element | None:
        return None if element is None else next(self.all(element, m), None)

    def follow(self, item: _Element, rule: Field) -> _Element | None:
        for path in rule.paths:
            element = self.first(item, path[0])
            if element is not None:
                for step in path[1:]:
                    element = self.first(element, step)
                return element
        return None if rule.paths else item

    def counts(self, element: _Element, holds: Match | None) -> bool:
        if holds is None:
            return True
        inside = self.first(element, _of_tag(holds.tag))
        return inside is not None and inside.passes(holds)

    def read(self, item: _Element, rule: Field) -> str | None:
        element = self.follow(item, rule)
        if element is None:
            return rule.default
        if rule.kind == "count":
            return str(sum(self.counts(e, rule.holds) for e in self.all(element, rule.each)))
        texts = self.texts[element.text:element.text_after]
        if rule.kind == "text":
            return "".join(texts).strip()
        pieces = [t.strip() for t in texts if t.strip()]
        if rule.kind == "last":
            return pieces[-1] if pieces else ""
        return "\n".join(pieces)


def read_page(html: str, rules: Rules) -> list[dict[str, str | None]]:
    """The items of one page as dictionaries of texts."""
    page = _Page(html)
    return [{name: page.read(item, f) for name, f in rules.fields.items()} for item in page.all(page.root, rules.item)]


#: Items that a task gathers before it hands them on.
_ITEMS = 4096


# --- page tables ------------------------------------------------------------
def extract_items(pages: DataFrame, rules: Rules, carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per item: the carried page columns, its place on the page and its field texts."""
    names = list(rules.fields)
    types = dict(pages.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in carry] + ["item_no long"] + [f"{n} string" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_of, numbers, texts = [], [], {n: [] for n in names}

            def rows() -> pa.RecordBatch:
                fields = [pa.array(texts[n], pa.string()) for n in names]
                kept = batch.select(list(carry)).take(pa.array(pages_of, pa.int32()))
                return pa.RecordBatch.from_arrays([*kept.columns, pa.array(numbers, pa.int64()), *fields],
                                                  [*carry, "item_no", *names])

            for at, html in enumerate(batch.column(len(carry))):
                for number, item in enumerate(read_page(html.as_py(), rules)):
                    pages_of.append(at)
                    numbers.append(number)
                    for n in names:
                        texts[n].append(item[n])
                if len(numbers) >= _ITEMS:
                    yield rows()
                    pages_of, numbers, texts = [], [], {n: [] for n in names}
            yield rows()

    # pages without the marker never reach Python
    return pages.filter(F.col("html").contains(rules.marker)).select(*carry, "html").mapInArrow(run, schema)


def extract_reviews(pages: DataFrame, site: str, carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Reviews of one site; items without rating, date or body are skipped."""
    items = extract_items(pages, SITE_RULES[site], carry).dropna(subset=["rating", "date", "content"])
    reviews = items.withColumn("site", F.lit(site)).withColumn("rating", F.col("rating").try_cast("double"))
    if site == "tripdotcom":
        reviews = reviews.withColumn("date", normalise_labelled_date(F.col("date")))
    return reviews
