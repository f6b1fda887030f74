"""HTML pages as columns: one small tokenizer in Python, selectors as Column expressions over its elements.

parse_html() gives struct<title, visible, elements, texts, jsonld>. elements are in document order; an element
knows its place (pos), its parent's, those of all its ancestors, innermost first (up), the place of its last descendant
(last) and the range t0..t1 of its texts. So ancestors are looked up by their places, and
descendants and text are slices, which Catalyst sees. Texts leave the parser cleaned, as clean_text() would have them, none empty. Unclosed p, li, tr, td, dt and
the like end where HTML says they do; other malformed markup may be nested differently than in other parsers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from parcela.functions.text import clean_text, once

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A tag ends open ones of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",), "option": ("option",)}
#: Open tags of these kinds stop the search for one to end.
WALLS = frozenset("html body table ul ol dl div section article nav select".split())
#: What is in them is text of another kind, which HTMLParser reads.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
#: Texts in these aren't texts of the page, or aren't shown.
HIDDEN = frozenset("script style template noscript".split())
#: A tag as most are written, with ASCII letters and spaces, no attributes but in double quotes or without value, and the text up to the next tag.
SIMPLE = re.compile(r'<(?:/([a-zA-Z][a-zA-Z0-9]*+)[\t\n\r ]*+|([a-zA-Z][a-zA-Z0-9]*+)((?:[\t\n\r ]++[a-zA-Z][-a-zA-Z0-9_:.]*+(?:="[^"]*+")?+)*+)[\t\n\r ]*+(/?))>([^<]*+)(?=<)')
ATTRIBUTE = re.compile(r'[\t\n\r ]+([a-zA-Z][-a-zA-Z0-9_:.]*)(?:="([^"]*)")?')
#: What Java's regular expressions count as white space; str.split() has four control characters more.
SPACES = re.compile(r"[^\S\x1c-\x1f]+")
PAGE = "title string, visible string, elements array<struct<tag: string, pos: int, parent: int, last: int, t0: int, t1: int, up: array<int>, attrs: map<string, string>>>, texts array<string>, jsonld array<string>"
PAGE_TYPE = pa.struct([
    ("title", pa.string()), ("visible", pa.string()),
    ("elements", pa.list_(pa.struct([("tag", pa.string()), *((k, pa.int32()) for k in ("pos", "parent", "last", "t0", "t1")), ("up", pa.list_(pa.int32())), ("attrs", pa.map_(pa.string(), pa.string()))]))),
    ("texts", pa.list_(pa.string())), ("jsonld", pa.list_(pa.string())),
])
SHOWN_TYPE = pa.struct([("title", pa.string()), ("visible", pa.string())])
#: Characters and places of ancestors that a worker turns into elements at once.
PART_SIZE = 500_000


class Elements(HTMLParser):
    """A page's elements, as a list for each of their columns, and its texts, cleaned."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.lasts, self.t0s, self.t1s, self.depths, self.ups, self.attrs = [], [], [], [], [], [], [], []
        self.texts, self.shown, self.scripts = [], [], []
        self.open, self.names = [], []  # open elements' places and tags, outer ones first
        self.feed(html)
        self.close()
        self.end(0)

    def updatepos(self, i, j):
        """Where to read on. HTMLParser counts lines here, after each of its steps. Instead, simple tags are read, each by one
        match, up to a piece of markup that isn't simple; that is HTMLParser's next step."""
        if self.cdata_elem is not None:
            return j
        html = self.rawdata
        while m := SIMPLE.match(html, j):
            ended, tag, attrs, empty, text = m.groups()
            if ended:
                self.handle_endtag(ended.lower())
            else:
                tag = tag.lower()
                if tag in RAW:
                    break
                self.begin(tag, {k.lower(): unescape(v) for k, v in reversed(ATTRIBUTE.findall(attrs))} if attrs else {})
                if empty and tag not in VOID:
                    self.end(len(self.open) - 1)
            if text:
                self.handle_data(unescape(text))
            j = m.end()
        return j

    def end(self, depth: int) -> None:
        for pos in self.open[depth:]:
            self.lasts[pos], self.t1s[pos] = len(self.tags) - 1, len(self.texts)
        del self.open[depth:], self.names[depth:]

    def begin(self, tag: str, attrs: dict[str, str]) -> None:
        if ends := ENDS.get(tag):
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.names[depth]
                if name in ends:
                    self.end(depth)
                    if name == tag:
                        break
                elif name in WALLS:
                    break
        pos = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.open[-1] if self.open else -1)
        self.lasts.append(pos)
        self.t0s.append(len(self.texts))
        self.t1s.append(len(self.texts))
        self.depths.append(len(self.open))
        self.ups += self.open[::-1]
        self.attrs.append(attrs)
        if tag == "script" and is_jsonld(attrs):
            self.scripts.append("")
        if tag not in VOID:
            self.open.append(pos)
            self.names.append(tag)

    def handle_starttag(self, tag, attrs):
        self.begin(tag, {k: v or "" for k, v in reversed(attrs)})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.end(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in self.names:
            self.end(len(self.names) - 1 - self.names[::-1].index(tag))

    def handle_data(self, data):
        hidden = HIDDEN.intersection(self.names)
        if "script" in hidden:
            if self.scripts and is_jsonld(self.attrs[self.open[-1]]):
                self.scripts[-1] += data
        elif not hidden & {"style", "template"}:
            text = " ".join(data.split())
            if text:
                if not data.isprintable():
                    text = SPACES.sub(" ", data).strip(" ")
                self.texts.append(text)
                if not hidden:
                    self.shown.append(text)

    def title(self) -> str | None:
        if "title" not in self.tags:
            return None
        i = self.tags.index("title")
        return squeeze(self.texts[self.t0s[i] : self.t1s[i]])

    def jsonld(self) -> list[str]:
        found = []
        for text in self.scripts:
            try:
                found += [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in nested_objects(json.loads(text))]
            except (ValueError, RecursionError):
                continue
        return found


def is_jsonld(attrs: dict[str, str]) -> bool:
    return attrs.get("type", "").strip().lower() == "application/ld+json"


def squeeze(texts: list[str]) -> str | None:
    return " ".join(" ".join(texts).split()) or None


def nested_objects(value) -> Iterator[dict]:
    """Every object in a JSON value, outer ones first."""
    if isinstance(value, dict):
        yield value
        value = list(value.values())
    for child in value if isinstance(value, list) else ():
        yield from nested_objects(child)


def page_of(html: str | None) -> dict | None:
    """A value of PAGE_TYPE, for those who read single pages."""
    if html is None:
        return None
    page = Elements(html)
    columns = zip(page.tags, page.parents, page.lasts, page.t0s, page.t1s, page.depths, accumulate(page.depths), page.attrs, strict=True)
    rows = [{"tag": tag, "pos": pos, "parent": parent, "last": last, "t0": t0, "t1": t1, "up": page.ups[end - depth : end], "attrs": list(attrs.items())} for pos, (tag, parent, last, t0, t1, depth, end, attrs) in enumerate(columns)]
    return {"title": page.title(), "visible": squeeze(page.shown), "elements": rows, "texts": page.texts, "jsonld": page.jsonld()}


def pairs_of(page: dict | None) -> list[tuple[str, str]]:
    """Pairs of a page_of(): two-cell table rows, then dt and the dd that follows it, as portals.table_pairs() finds them."""
    rows, texts = (page["elements"], page["texts"]) if page else ([], [])
    text = lambda r: " ".join(" ".join(texts[r["t0"] : r["t1"]]).split())
    below: dict[int, list[dict]] = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)
    cells = [[c for c in below.get(r["pos"], ()) if c["tag"] in ("th", "td")] for r in rows if r["tag"] == "tr"]
    found = [(k, v) for k, v in (map(text, c) for c in cells if len(c) == 2) if k and v and len(k) <= 80]
    for r in rows:
        if r["tag"] == "dt":
            after = next((d for d in below[r["parent"]] if d["pos"] > r["pos"] and d["tag"] == "dd"), None)
            if after and text(r) and text(after):
                found.append((text(r), text(after)))
    return found


def offsets(lengths: Iterable[int]) -> pa.Array:
    return pa.array([0, *accumulate(lengths)], pa.int32())


def packed(pages: list[Elements | None]) -> pa.StructArray:
    """Values of PAGE_TYPE. Their columns are put together from the pages' lists; no element becomes an object of its own."""
    here = [p for p in pages if p is not None]
    every = lambda name, kind: pa.array([x for p in here for x in getattr(p, name)], kind)
    attrs = [x for p in here for x in p.attrs]
    elements = pa.StructArray.from_arrays([
        every("tags", pa.string()), pa.array([pos for p in here for pos in range(len(p.tags))], pa.int32()), *(every(name, pa.int32()) for name in ("parents", "lasts", "t0s", "t1s")),
        pa.ListArray.from_arrays(offsets(n for p in here for n in p.depths), every("ups", pa.int32())),
        pa.MapArray.from_arrays(offsets(map(len, attrs)), pa.array([k for a in attrs for k in a], pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string())),
    ], fields=[*PAGE_TYPE.field("elements").type.value_type])
    each = lambda read, kind: pa.array([None if p is None else read(p) for p in pages], kind)
    return pa.StructArray.from_arrays([
        each(Elements.title, pa.string()), each(lambda p: squeeze(p.shown), pa.string()), pa.ListArray.from_arrays(offsets(0 if p is None else len(p.tags) for p in pages), elements),
        pa.ListArray.from_arrays(offsets(0 if p is None else len(p.texts) for p in pages), every("texts", pa.string())), each(Elements.jsonld, pa.list_(pa.string())),
    ], fields=[*PAGE_TYPE], mask=pa.array([p is None for p in pages]))


def packed_shown(pages: list[Elements | None]) -> pa.StructArray:
    return pa.array([p and {"title": p.title(), "visible": squeeze(p.shown)} for p in pages], SHOWN_TYPE)


def parts_of(batches: Iterator[pa.Array], pack=packed) -> Iterator[pa.Array]:
    """Every text's page, in parts of about PART_SIZE characters and places, whatever the size of a batch: a worker holds
    the elements of one part."""
    for batch in batches:
        pages, size = [], 0
        for x in batch:
            html = x.as_py()
            page = None if html is None else Elements(html)
            pages.append(page)
            if page is not None:
                size += len(html) + len(page.ups)
            if size >= PART_SIZE:
                yield pack(pages)
                pages, size = [], 0
        if pages:
            yield pack(pages)


def html_page():
    """The user-defined function behind parse_html(), to register for SQL."""

    @F.arrow_udf(PAGE)
    def html_page(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from parts_of(batches)

    return html_page


def parse_html(html: Column) -> Column:
    """struct PAGE, or null for a null page."""
    return html_page()(html)


def parse_shown(html: Column) -> Column:
    """struct<title, visible> of parse_html(): for those who need no elements, which then never leave the parser."""

    @F.arrow_udf("title string, visible string")
    def html_shown(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from parts_of(batches, packed_shown)

    return html_shown(html)


# Selectors. e is an element, els an array of them.


def attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def has_class(e: Column, token: str) -> Column:
    # few classes contain the token, so the pattern is tried on few
    return F.coalesce(once(lambda own: F.contains(own, F.lit(token)) & own.rlike(rf"(?:^|\s){re.escape(token)}(?:\s|\z)"), attr(e, "class")), F.lit(False))


def class_like(e: Column, part: str) -> Column:
    return F.coalesce(F.contains(attr(e, "class"), F.lit(part)), F.lit(False))


def attr_like(e: Column, name: str, part: str) -> Column:
    return F.coalesce(F.contains(attr(e, name), F.lit(part)), F.lit(False))


def attr_is(e: Column, name: str, value: str) -> Column:
    return F.coalesce(attr(e, name) == value, F.lit(False))


def under(els: Column, outer, inner) -> Column:
    """Elements that satisfy inner and lie below one that satisfies outer."""
    return F.filter(els, lambda e: inner(e) & F.exists(e["up"], lambda pos: outer(F.get(els, pos))))


def first(els: Column) -> Column:
    return F.get(els, F.lit(0))


def subtree(e: Column, els: Column, texts: Column) -> Column:
    """struct<top, els, texts>: an element, the elements below it and their texts, as a page of their own. Both lie next to
    each other in the page, so they are slices of it."""
    moved = lambda x: x.withField("t0", x["t0"] - e["t0"]).withField("t1", x["t1"] - e["t0"])
    below = F.coalesce(F.transform(F.slice(els, e["pos"] + 2, e["last"] - e["pos"]), moved), F.slice(els, 1, 0))
    own = F.coalesce(F.slice(texts, e["t0"] + 1, e["t1"] - e["t0"]), F.slice(texts, 1, 0))
    return F.struct(moved(e).alias("top"), below.alias("els"), own.alias("texts"))


def closest(els: Column, e: Column, test) -> Column:
    """The innermost ancestor of e, of the whole page els, that satisfies test; or null."""
    return first(F.filter(F.transform(e["up"], lambda pos: F.get(els, pos)), test))


def text_of(e: Column, texts: Column) -> Column:
    """The text below e; null if there is none. Texts leave the parser cleaned."""
    return F.when(e["t1"] > e["t0"], F.array_join(F.slice(texts, e["t0"] + 1, e["t1"] - e["t0"]), " "))


def first_text(els: Column, texts: Column, *tests) -> Column:
    """Of each test's first element only: the first text that isn't empty."""
    return F.coalesce(*[once(lambda e: text_of(e, texts), first(F.filter(els, t))) for t in tests])


def meta(els: Column, texts: Column, *tests) -> Column:
    """content, or else the text, of the first element that the first matching test finds, even if it is empty."""
    said = lambda e: F.coalesce(clean_text(F.nullif(attr(e, "content"), F.lit(""))), text_of(e, texts))
    return once(said, F.coalesce(*[first(F.filter(els, t)) for t in tests]))
