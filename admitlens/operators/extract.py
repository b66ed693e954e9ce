"""Listing pages -> applicant records, as one Spark job over ``pages``.

Only E1 (HTML -> elements) runs Python inside ``mapInArrow``: plain pages by array
steps over a batch (``extract_batch``), others one at a time, up to a stdlib
``html.parser`` tree; one output row per page with the ordered array of its
elements. Stitching the follower rows is array access (rows i+1 and i+2 of the
same page), record numbers are array positions, and pages are exploded last: from
the parse to the records nothing is shuffled. Field picking, badge
classification, number parsing and URL joining are native.

Tree rules (as a non-correcting parser builds them): no tag is closed
implicitly, an end tag closes up to the nearest open element of its name (or is
ignored when none is open), void elements never hold children, text inside
script/style/template and comments is not text. Positions count start tags in
document order, so an unclosed element contains what follows it.
"""

from __future__ import annotations

import gc
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from admitlens.fixed_values import BADGE_CLASS, RECORD_START_CLASSES
from admitlens.functions.records import (
    badge_issue_count,
    classify_badges,
    resolve_url,
    split_status_date,
)

# Elements that never hold children: those of the HTML standard, then obsolete ones.
VOID = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "keygen", "menuitem", "nextid", "spacer",
])
RAW_TEXT = frozenset(["script", "style", "template"])
OUT_TEXT = 1 << 22     # characters of output gathered before a batch is handed on

DESC_TYPE = ("array<struct<tag:string,nth:int,cell:int,classes:array<string>,"
             "nodes:array<string>,href:string>>")
ELEMENT_TYPE = ("struct<pos:int,tag:string,classes:array<string>,href:string,text:string,"
                f"nodes:array<string>,hrefs:array<string>,descendants:{DESC_TYPE}>")
ELEMENT_FIELDS = ["pos", "tag", "classes", "href", "text", "nodes", "hrefs", "descendants"]


class _Node:
    """An element. ``at`` is its place among the page's elements in document order and
    ``end`` that behind its last descendant, so descendants are an interval; so are
    its texts, from ``text`` to ``text_end`` of the page's."""
    __slots__ = ("tag", "attrs", "parent", "nth", "seen", "at", "end", "text", "text_end")

    def __init__(self, tag, attrs, parent, at, text):
        self.tag, self.attrs, self.parent, self.at, self.text = tag, attrs, parent, at, text
        self.nth = 1
        self.seen: dict[str, int] | None = None
        self.end = self.text_end = -1


class _Tree:
    """The elements of a page in document order, and its stripped, non-empty texts."""

    def __init__(self):
        self.root = self.cur = _Node("[document]", {}, None, -1, 0)
        self.order: list[_Node] = []
        self.texts: list[str] = []
        self.raw = 0             # open elements whose text is none

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        cur = self.cur
        node = _Node(tag, attrs, cur, len(self.order), len(self.texts))
        if cur.seen is None:
            cur.seen = {tag: 1}
        else:
            node.nth = cur.seen[tag] = cur.seen.get(tag, 0) + 1
        self.order.append(node)
        if tag in VOID:
            node.end, node.text_end = len(self.order), node.text
        else:
            self.cur = node
            self.raw += tag in RAW_TEXT

    def end(self, tag: str) -> None:
        n = self.cur
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.close_to(n.parent)

    def close_to(self, node: _Node) -> None:
        while self.cur is not node:
            cur = self.cur
            cur.end, cur.text_end = len(self.order), len(self.texts)
            self.raw -= cur.tag in RAW_TEXT
            self.cur = cur.parent

    def say(self, text: str) -> None:
        text = text.strip()
        if text and not self.raw:
            self.texts.append(text)


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = _Tree()
        self.buf: list[str] = []

    def _flush(self):
        if self.buf:
            self.tree.say("".join(self.buf))
            self.buf = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        self.tree.start(tag, {k: v if v is not None else "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        self.tree.end(tag)

    def handle_data(self, data):
        self.buf.append(data)

    def handle_comment(self, data):
        self._flush()

    def close(self):
        super().close()
        self._flush()


# Plain markup: tags whose attributes are quoted or bare names, text, comments and a
# doctype. A page of these alone means the same to every parser.
_PLAIN = re.compile(
    r"""([^<]+)|</([a-zA-Z][a-zA-Z0-9-]*)[ \t\n\r\f]*>"""
    r"""|<([a-zA-Z][a-zA-Z0-9-]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9:_-]*(?:="[^"&]*"|='[^'&]*')?)*)[ \t\n\r\f]*(/?)>"""
    r"""|<!--(?!-?>)(?:(?!--).)*-->|<!(?i:doctype)[^<>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9:_-]*)(?:="([^"]*)"|='([^']*)')?""")
# Elements whose content is not markup; pages that hold them are left to the parser.
_OWN_RULES = re.compile(r"<(?:script|style|xmp|iframe|noembed|noframes|noscript|plaintext|textarea|title)[\s/>]", re.I)


def _plain_tree(html: str) -> _Tree | None:
    """The tree of plain markup, in one scan of a regular expression; None if the page
    holds anything else."""
    if _OWN_RULES.search(html):
        return None
    tree, at, known = _Tree(), 0, {}
    said = ""
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        kind = m.lastindex
        if kind == 1:
            said = m[1]
            continue
        if kind is None and html[m.start() + 2] in "dD" and (said or tree.order):
            return None              # a doctype inside a page does not end a text
        if said:
            tree.say(unescape(said) if "&" in said else said)
            said = ""
        if kind == 2:
            tree.end(m[2].lower())
        elif kind == 5:
            tag, rest = m[3].lower(), m[4]
            attrs = known.get(rest)
            if attrs is None:
                attrs = known[rest] = {n.lower(): a or b for n, a, b in _ATTRIBUTE.findall(rest)}
            tree.start(tag, attrs)
            if m[5] and tag not in VOID:
                tree.end(tag)
    if at != len(html):
        return None
    if said:
        tree.say(unescape(said) if "&" in said else said)
    return tree


_END = re.compile(r"/([a-zA-Z][a-zA-Z0-9-]*)[ \t\n\r\f]*")
_START = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9:_-]*(?:="[^"&]*"|='[^'&]*')?)*)[ \t\n\r\f]*(/?)""")
_DOCTYPE = re.compile(r"!(?i:doctype)[^<>]*")
MOST_TAGS = 10_000       # different tags remembered, each read once
_tags: dict[str, tuple] = {}


def _tag(inside: str) -> tuple | None:
    """(tag, attributes, whether it ends at once, classes, link, kind) of what stands
    between < and >, with None for the attributes of an end tag; None if it is neither, or
    begins an element whose content is not markup."""
    if m := _END.fullmatch(inside):
        found = m[1].lower(), None, False, (), None, None
    elif m := _START.fullmatch(inside):
        tag, attrs = m[1].lower(), {n.lower(): a or b for n, a, b in _ATTRIBUTE.findall(m[2])}
        if _OWN_RULES.match(f"<{tag}>"):
            return None
        found = tag, attrs, bool(m[3]), *_traits(tag, attrs)
    else:
        return None
    if len(_tags) >= MOST_TAGS:
        _tags.clear()
    _tags[inside] = found
    return found


class _Page:
    """The elements of a page as columns, in document order; ``said`` are its stripped,
    non-empty texts. Descendants and texts of an element are intervals, as in the tree."""
    __slots__ = ("infos", "nths", "ends", "froms", "tos", "cells", "links", "listed", "said")

    def __init__(self):
        self.infos: list[tuple] = []     # as _tag gives them
        self.nths, self.ends, self.froms, self.tos = [], [], [], []
        self.cells: list[int] = []       # place of the nearest td, the element itself or above it; -1: none
        self.links: list[int] = []       # places of the links
        self.listed: list[int] = []      # places of the elements that may be read of a listing's row
        self.said: list[str] = []


def _simple_page(html: str) -> _Page | None:
    """Plain markup without comments and without < or > in attributes, cut at its tags;
    None if the page holds anything else."""
    said, *parts = html.split("<")
    insides, closed, texts = zip(*[x.partition(">") for x in parts]) if parts else ((), (), ())
    if "" in closed:
        return None
    found = [_tags.get(x) or _tag(x) for x in insides]
    first, texts = 0, [said, *texts]
    while first < len(found) and found[first] is None:      # a doctype inside a page does not end a text
        if texts[first] or not _DOCTYPE.fullmatch(insides[first]):
            return None
        first += 1
    found, texts = found[first:], texts[first:]
    if None in found:
        return None
    if "&" in html:
        texts = [unescape(t) if "&" in t else t for t in texts]
    texts = [t.strip() for t in texts]

    page = _Page()
    infos, nths, ends, froms, tos, cells, said = page.infos, page.nths, page.ends, page.froms, page.tos, page.cells, page.said
    links, listed, raw = page.links, page.listed, 0
    stack: list[tuple] = []              # (tag, place, counts, cell) of the elements around the current one
    current, place, counts, cell = "", -1, {}, -1
    if texts[0]:
        said.append(texts[0])
    for (tag, attrs, at_once, _, link, kind), info, text in zip(found, found, texts[1:]):
        if attrs is not None:
            at = len(infos)
            n = counts.get(tag, 0) + 1
            counts[tag] = n
            infos.append(info)
            nths.append(n)
            froms.append(len(said))
            if kind is not None:
                listed.append(at)
            if link is not None and tag == "a":
                links.append(at)
            if at_once or tag in VOID:
                cells.append(at if tag == "td" else cell)
                ends.append(at + 1)
                tos.append(len(said))
            else:
                ends.append(-1)
                tos.append(-1)
                stack.append((current, place, counts, cell))
                if tag == "td":
                    cell = at
                cells.append(cell)
                current, place, counts = tag, at, {}
                if tag in RAW_TEXT:
                    raw += 1
        else:
            if current != tag and any(s[0] == tag for s in stack[1:]):
                while current != tag:
                    ends[place], tos[place] = len(infos), len(said)
                    if current in RAW_TEXT:
                        raw -= 1
                    current, place, counts, cell = stack.pop()
            if current == tag and stack:
                ends[place], tos[place] = len(infos), len(said)
                if tag in RAW_TEXT:
                    raw -= 1
                current, place, counts, cell = stack.pop()
        if text and not raw:
            said.append(text)
    while stack:
        ends[place], tos[place] = len(infos), len(said)
        current, place, counts, cell = stack.pop()
    return page


def _page_of_tree(tree: _Tree) -> _Page:
    page = _Page()
    page.said = tree.texts
    known: dict[int, int] = {-1: -1}
    for n in tree.order:
        info = (n.tag, n.attrs, False, *_traits(n.tag, n.attrs))
        cell = known[n.at] = n.at if n.tag == "td" else known[n.parent.at]
        page.infos.append(info)
        page.nths.append(n.nth)
        page.ends.append(n.end)
        page.froms.append(n.text)
        page.tos.append(n.text_end)
        page.cells.append(cell)
        if info[5] is not None:
            page.listed.append(n.at)
        if info[4] is not None and n.tag == "a":
            page.links.append(n.at)
    return page


def _simple_tree(html: str) -> _Tree | None:
    """The page as a tree, or None, as ``_simple_page`` reads it."""
    page = _simple_page(html)
    if page is None:
        return None
    tree, parents = _Tree(), []
    tree.texts = page.said
    for at, info in enumerate(page.infos):
        while parents and parents[-1].end <= at:
            parents.pop()
        node = _Node(info[0], info[1], parents[-1] if parents else tree.root, at, page.froms[at])
        node.nth, node.end, node.text_end = page.nths[at], page.ends[at], page.tos[at]
        tree.order.append(node)
        parents.append(node)
    return tree


def _page_of(html: str) -> _Page:
    page = _simple_page(html)
    if page is not None:
        return page
    tree = _plain_tree(html)
    if tree is None:
        b = _TreeBuilder()
        b.feed(html)
        b.close()
        tree = b.tree
    tree.close_to(tree.root)
    return _page_of_tree(tree)


@lru_cache(maxsize=4096)
def _split_classes(text: str) -> tuple[str, ...]:
    return tuple(text.split())


def _traits(tag: str, attrs: dict[str, str]) -> tuple:
    """(classes, link, kind) of an element; the kind says as what E2, E3, E7 and E9 may
    read it of a listing's row, None if they do not."""
    text = attrs.get("class")
    classes = _split_classes(text) if text else ()
    kind = None
    if tag == "div":
        if BADGE_CLASS in classes:
            kind = "badge"
        elif all(c in classes for c in RECORD_START_CLASSES):
            kind = "marker"
    elif tag in ("span", "td", "p"):
        kind = tag
    return classes, attrs.get("href"), kind


def _listing_only(page: _Page, at: int) -> list[int]:
    """Of a row's descendants those that E2, E3, E7 and E9 read: the first marker,
    two spans of cell 2, cells 3 and 4, a paragraph, and every badge."""
    left = {"marker": 1, "span": 2, 3: 1, 4: 1, "p": 1}
    listed, out = page.listed, []
    for i in range(bisect_right(listed, at), bisect_left(listed, page.ends[at])):
        d = listed[i]
        kind = page.infos[d][5]
        if kind == "badge":
            out.append(d)
            continue
        if kind == "td":
            kind = page.nths[d]
        elif kind == "span" and left["span"] and not (page.cells[d] > at and page.nths[page.cells[d]] == 2):
            continue
        if left.get(kind):
            left[kind] -= 1
            out.append(d)
    return out


def _explode_page(html: str, tag: str, with_desc: bool | str) -> list[dict]:
    page = _page_of(html or "")
    infos, nths, cells, froms, tos, said = page.infos, page.nths, page.cells, page.froms, page.tos, page.said
    links, rows = page.links, []
    for at in [i for i, info in enumerate(infos) if info[0] == tag]:
        info, end, nodes = infos[at], page.ends[at], said[froms[at]:tos[at]]
        some = links[bisect_right(links, at):bisect_left(links, end)] if links else []
        if with_desc == "listing":      # the first link is all that is read
            desc, some = _listing_only(page, at), some[:1]
        else:
            desc = range(at + 1, end) if with_desc else ()
        given = [] if with_desc else None
        for d in desc:
            name, _, _, classes, href, _ = infos[d]
            cell = cells[d]
            given.append({"tag": name, "nth": nths[d], "cell": nths[cell] if cell > at else None, "classes": classes,
                          "nodes": said[froms[d]:tos[d]], "href": href})
        rows.append({
            "pos": len(rows), "tag": tag, "classes": info[3], "href": info[4],
            "text": "".join(nodes),
            "nodes": nodes,
            "hrefs": [infos[d][4] for d in some],
            "descendants": given,
        })
    return rows


class _Lists:
    """A column of lists: its values one behind the other, and where each list ends."""

    def __init__(self):
        self.values: list = []
        self.ends: list[int] = [0]

    def add(self, some) -> None:
        self.values += some
        self.ends.append(len(self.values))

    def array(self, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), values)


class _Elements:
    """Elements of pages as columns: Arrow takes flat lists of values far faster than
    nested rows. ``held`` counts the characters."""

    def __init__(self, with_desc: bool | str):
        self.with_desc = with_desc
        self.pos, self.tag, self.href, self.text = [], [], [], []
        self.classes, self.nodes, self.hrefs = _Lists(), _Lists(), _Lists()
        self.d_tag, self.d_nth, self.d_cell, self.d_href = [], [], [], []
        self.d_classes, self.d_nodes = _Lists(), _Lists()
        self.d_ends = [0]
        self.held = 0

    def add_page(self, rows: list[dict]) -> None:
        d_tag, d_nth, d_cell, d_href = self.d_tag, self.d_nth, self.d_cell, self.d_href
        classes, class_ends = self.d_classes.values, self.d_classes.ends
        texts, text_ends = self.d_nodes.values, self.d_nodes.ends
        first = len(texts)
        for r in rows:
            nodes, desc = r["nodes"], r["descendants"]
            self.pos.append(r["pos"])
            self.tag.append(r["tag"])
            self.href.append(r["href"])
            self.text.append(r["text"])
            self.classes.add(r["classes"])
            self.nodes.add(nodes)
            self.hrefs.add(r["hrefs"])
            self.held += 2 * len(r["text"]) + 64
            if desc is not None:
                for d in desc:
                    d_tag.append(d["tag"])
                    d_nth.append(d["nth"])
                    d_cell.append(d["cell"])
                    d_href.append(d["href"])
                    classes += d["classes"]
                    class_ends.append(len(classes))
                    texts += d["nodes"]
                    text_ends.append(len(texts))
                self.d_ends.append(len(d_tag))
        self.held += sum(map(len, texts[first:])) + 64 * (len(texts) - first)

    def array(self, desc_type: pa.DataType) -> pa.Array:
        def strings(x):
            return pa.array(x, pa.string())

        def lists(x):
            return x.array(strings(x.values))

        if self.with_desc:
            desc = pa.ListArray.from_arrays(pa.array(self.d_ends, pa.int32()), pa.StructArray.from_arrays(
                [strings(self.d_tag), pa.array(self.d_nth, pa.int32()), pa.array(self.d_cell, pa.int32()),
                 lists(self.d_classes), lists(self.d_nodes), strings(self.d_href)],
                ["tag", "nth", "cell", "classes", "nodes", "href"]))
        else:
            desc = pa.nulls(len(self.pos), desc_type)
        return pa.StructArray.from_arrays(
            [pa.array(self.pos, pa.int32()), strings(self.tag), lists(self.classes), strings(self.href),
             strings(self.text), lists(self.nodes), lists(self.hrefs), desc], ELEMENT_FIELDS)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch cut behind every ``OUT_TEXT`` bytes or so of a text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // OUT_TEXT)) + 1
    for first, last in zip([0, *cuts], [*cuts, len(batch)]):
        if last > first:
            yield batch.slice(first, last - first)


def page_elements(pages: DataFrame, tag: str, id_col: str = "page_id",
                  html_col: str = "html", with_descendants: bool | str = True,
                  carry: list[str] | None = None) -> DataFrame:
    """E1, a row per page: (page_id, items, error, carried columns). ``items`` is
    the array of the page's ``tag`` elements in document order; a page that cannot
    be parsed has none and its ``error`` set. A null id stays null. Descendants are
    given in full, not at all, or (``"listing"``) as far as listings are read."""
    carry = carry or []
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"),
                       *[F.col(c).cast("string").alias(c) for c in carry])
    out_type = T._parse_datatype_string(
        f"page_id long, items array<{ELEMENT_TYPE}>, error string" + "".join(f", {c} string" for c in carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from admitlens.operators.extract_batch import read_pages

        schema = to_arrow_schema(out_type)
        desc_type = schema.field("items").type.value_type.field("descendants").type

        def given(some: pa.RecordBatch, items: pa.Array, errors: pa.Array) -> pa.RecordBatch:
            columns = [some.column(0), items, errors, *some.columns[2:]]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

        for whole in batches:
            for batch in _slices(whole, 1):
                try:
                    read, items = read_pages(batch.column(1), tag, with_descendants, desc_type)
                except pa.ArrowException:    # text that Arrow does not take: a page at a time says which
                    read, items = np.zeros(len(batch), bool), None
                if items is not None:
                    some = batch if read.all() else batch.filter(pa.array(read))
                    yield given(some, items, pa.nulls(len(some), pa.string()))
                    if read.all():
                        continue
                    batch = batch.filter(pa.array(~read))
                at, n = 0, len(batch)
                while at < n:                # a page at a time, so that few are held as Python's strings
                    first, elements, ends, errors = at, _Elements(with_descendants), [0], []
                    held = 0
                    # A page's rows hold no cycles; the collector would walk them again and again.
                    collects = gc.isenabled()
                    gc.disable()
                    try:
                        while at < n and held + elements.held < OUT_TEXT:
                            html, error = batch.column(1)[at].as_py(), None
                            held += len(html or "") + 64
                            try:
                                rows = _explode_page(html, tag, with_descendants)
                            except Exception as e:  # noqa: BLE001 - one bad page never stops the run
                                error = f"{type(e).__name__}: {e}"
                            else:
                                elements.add_page(rows)
                            ends.append(len(elements.pos))
                            errors.append(error)
                            at += 1
                    finally:
                        if collects:
                            gc.enable()
                    items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), elements.array(desc_type))
                    yield given(batch.slice(first, at - first), items, pa.array(errors, pa.string()))

    return src.mapInArrow(run, out_type)


def explode_elements(pages: DataFrame, tag: str, id_col: str = "page_id",
                     html_col: str = "html", with_descendants: bool = True,
                     carry: list[str] | None = None) -> DataFrame:
    """Every ``tag`` element of every page, in document order, with its
    text, text nodes, class list, links and (optionally) descendants. A page
    that cannot be parsed yields one row with ``error`` set and pos = -1.
    ``carry`` names string columns of ``pages`` copied onto every row."""
    carry = carry or []
    parsed = page_elements(pages, tag, id_col, html_col, with_descendants, carry)
    # explode_outer keeps a failed page (its array is empty) as one row.
    rows = parsed.where((F.size("items") > 0) | F.col("error").isNotNull()).select(
        "page_id", F.explode_outer("items").alias("e"), "error", *carry)
    return rows.select("page_id", F.coalesce("e.pos", F.lit(-1)).alias("pos"), F.coalesce("e.tag", F.lit(tag)).alias("tag"),
                       *[F.col(f"e.{n}").alias(n) for n in ELEMENT_FIELDS[2:]], "error", *carry)


# ---------------------------------------------------------------- E2 .. E9
def _has_classes(d: Column, classes: list[str]) -> Column:
    cond = F.lit(True)
    for c in classes:
        cond = cond & F.array_contains(d["classes"], c)
    return cond


def _is_start(descendants: Column, classes: list[str] = RECORD_START_CLASSES) -> Column:
    marker = F.exists(descendants, lambda d: (d["tag"] == "div") & _has_classes(d, classes))
    return F.coalesce(marker, F.lit(False))


def mark_record_start(rows: DataFrame, classes: list[str] = RECORD_START_CLASSES) -> DataFrame:
    """A row starts a record iff it holds a div carrying all the classes."""
    return rows.withColumn("is_start", _is_start(F.col("descendants"), classes))


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def _text_of(d: Column, sep: str = "") -> Column:
    return F.array_join(d["nodes"], sep)


def _main_row_exprs(classes: list[str] = RECORD_START_CLASSES) -> dict[str, Column]:
    """E3 field expressions over a row's descendants (no URL)."""
    desc = F.col("descendants")
    uni = _first(F.filter(desc, lambda d: (d["tag"] == "div") & _has_classes(d, classes)))
    spans = F.filter(desc, lambda d: (d["tag"] == "span") & (d["cell"] == 2))
    cell = lambda k: _first(F.filter(desc, lambda d: (d["tag"] == "td") & (d["nth"] == k)))
    status = split_status_date(_text_of(cell(4)))
    return {
        "university": _text_of(uni),
        "program": _text_of(F.try_element_at(spans, F.lit(1))),
        "degree_type": _text_of(F.try_element_at(spans, F.lit(2))),
        "date_posted": _text_of(cell(3)),
        "status": status["status"],
        "status_date": status["status_date"],
    }


def main_row_fields(rows: DataFrame, base_url: Column | str,
                    classes: list[str] = RECORD_START_CLASSES) -> DataFrame:
    """University (marker div), program + degree (spans of cell 2), date
    (cell 3), status / status date (cell 4, E5), absolute link (first a, E6)."""
    base = F.lit(base_url) if isinstance(base_url, str) else base_url
    return rows.select(
        "*", *[e.alias(n) for n, e in _main_row_exprs(classes).items()],
        resolve_url(base, _first(F.col("hrefs"))).alias("url"),
    )


def badge_texts(descendants: Column, badge_class: str = BADGE_CLASS) -> Column:
    """Badge texts of a row (text nodes joined by one blank)."""
    return F.transform(
        F.filter(descendants, lambda d: (d["tag"] == "div")
                 & F.array_contains(d["classes"], badge_class)),
        lambda d: _text_of(d, " "))


def extract_comment(nodes: Column, descendants: Column, separator: str = " ") -> Column:
    """If the row holds a <p>, its stripped text nodes joined by
    ``separator`` (``"p"`` reproduces the original joiner), else NULL."""
    has_p = F.exists(descendants, lambda d: d["tag"] == "p")
    return F.when(F.coalesce(has_p, F.lit(False)), F.array_join(nodes, separator))


def stitch_followers(parsed: DataFrame) -> DataFrame:
    """Each element with those one and two places further on in its page, by
    position only (whatever those are; NULL behind the end): (page_id, error,
    carried columns, element columns, ``next``, ``next2``). Array access within
    the page's row, then one explode; a page without elements has no row, a page
    that failed one with pos = -1."""
    items = F.col("items")
    stitched = F.transform(items, lambda e, i: F.struct(
        e.alias("e"), F.get(items, i + 1).alias("next"), F.get(items, i + 2).alias("next2")))
    other = [c for c in parsed.columns if c != "items"]
    rows = parsed.where((F.size("items") > 0) | F.col("error").isNotNull()).select(
        *other, F.explode_outer(stitched).alias("x"))
    return rows.select(*other, F.coalesce("x.e.pos", F.lit(-1)).alias("pos"),
                       *[F.col(f"x.e.{n}").alias(n) for n in ELEMENT_FIELDS[1:]], "x.next", "x.next2")


RECORD_FIELDS = ["university", "program", "degree_type", "date_posted", "status",
                 "status_date", "semester", "citizenship", "gpa", "gre", "gre_v", "gre_aw",
                 "comment", "url"]


def listing_rows(pages: DataFrame, base_url: str | Column = "https://example.test/",
                 comment_separator: str = " ") -> DataFrame:
    """Every <tr> of every page; the record fields are computed on record
    starts only (E2–E9, the link still relative in ``_href``). One parse per
    page feeds both E10 and E11; ``record_no`` counts the starts of a page."""
    parsed = page_elements(pages, "tr", with_descendants="listing")
    # Record numbers come from the array itself: a start's place among the page's starts.
    marks = F.transform("items", lambda e, i: F.when(_is_start(e["descendants"]), i))
    parsed = parsed.withColumn("_starts", F.array_compact(marks))
    rows = stitch_followers(parsed)
    place = F.array_position("_starts", F.col("pos"))
    rows = rows.withColumn("is_start", F.coalesce(place > 0, F.lit(False)))
    start, number = F.col("is_start"), (place - 1).cast("int")
    first = rows.select(
        "page_id", "pos", "is_start", "error", F.when(start, number).alias("record_no"),
        *[F.when(start, e).alias(n) for n, e in _main_row_exprs().items()],
        F.when(start, _first(F.col("hrefs"))).alias("_href"),
        # Badge texts are used twice below: one column, computed once.
        F.when(start, badge_texts(F.col("next.descendants"))).alias("_badges"),
        F.when(start, extract_comment(F.col("next2.nodes"), F.col("next2.descendants"),
                                      comment_separator)).alias("comment"))
    badges = F.col("_badges")
    return first.select(
        "page_id", "pos", "is_start", "error", "record_no", "university", "program", "degree_type",
        "date_posted", "status", "status_date",
        F.when(start, classify_badges(badges)).alias("_b"), "comment", "_href",
        F.when(start, badge_issue_count(badges)).alias("bad_fields"),
    ).select("page_id", "pos", "is_start", "error", "record_no", "university", "program", "degree_type",
             "date_posted", "status", "status_date", "_b.*", "comment", "_href", "bad_fields")


def extract_listing(pages: DataFrame, base_url: str | Column = "https://example.test/",
                    comment_separator: str = " ", rows: DataFrame | None = None) -> DataFrame:
    """Pages -> applicant records in page order: (page_id, record_no,
    the 14 record fields, bad_fields). Links are resolved on records only."""
    rows = rows if rows is not None else listing_rows(pages, base_url, comment_separator)
    base = F.lit(base_url) if isinstance(base_url, str) else base_url
    recs = rows.filter("is_start").withColumn("url", resolve_url(base, F.col("_href")))
    return recs.select("page_id", "record_no", *RECORD_FIELDS, "bad_fields")


def extraction_issues(pages: DataFrame, base_url: str | Column = "https://example.test/",
                      rows: DataFrame | None = None) -> DataFrame:
    """Per page: rows seen, records extracted, unreadable numeric
    badges, and the failure reason of a page that could not be parsed."""
    rows = rows if rows is not None else listing_rows(pages, base_url)
    per = rows.groupBy("page_id").agg(
        F.count_if(F.col("pos") >= 0).alias("rows"),
        F.count_if(F.col("is_start")).alias("records"),
        F.coalesce(F.sum("bad_fields"), F.lit(0)).cast("long").alias("bad_fields"),
        F.max("error").alias("failure"))
    # Pages without any row still get a line (zero records).
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"))
    per = per.withColumnRenamed("page_id", "_id")
    return ids.join(per, F.col("page_id").eqNullSafe(F.col("_id")), "left").select(
        "page_id", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        F.coalesce("records", F.lit(0)).cast("long").alias("records"),
        F.coalesce("bad_fields", F.lit(0)).cast("long").alias("bad_fields"), "failure")
