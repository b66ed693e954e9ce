"""E1 over a batch of pages: plain, balanced pages are cut at their tags and given
their elements by array steps over all pages at once, so that the work of a tag is
a few array cells and no Python object. Tags are read once per distinct tag. What
is not so plain (``read_pages`` says which) is left to the page-at-a-time reader.
"""

from __future__ import annotations

import sys
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from admitlens.operators import extract as E

DEEPEST = 500                          # nesting beyond which a page is left to the other reader
_SPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())    # what str.strip takes off
_KINDS = {None: -1, "badge": 0, "marker": 1, "span": 2, "td": 3, "p": 4}


def _ranges(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[i], firsts[i] + 1, ... (counts[i] numbers), one i behind the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - ends + counts, counts)


def _lists(values: pa.Array, firsts: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Lists of ``counts`` values from ``firsts`` on."""
    ends = np.concatenate(([0], np.cumsum(counts)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(_ranges(firsts, counts))))


_ATTR = r"""[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9:_-]*="[^"&]*\""""
# A tag whose attributes are quoted by ", cut around its first link.
_LINKED = rf"""^(?P<pre><[a-zA-Z][a-zA-Z0-9-]*(?:{_ATTR})*?[ \t\n\r\f]+href=")(?P<link>[^"&]*)(?P<post>"(?:{_ATTR})*[ \t\n\r\f]*)$"""
_A_LINK = "\0"


class _Tags:
    """The distinct tags of some pages, by their number. Nearly every link is a tag of its
    own, so tags are read with their links taken out."""

    def __init__(self, tags: pa.Array):
        coded = tags.dictionary_encode()
        cut = pc.extract_regex(coded.dictionary, _LINKED)
        pre, link, post = (pc.struct_field(cut, x) for x in ("pre", "link", "post"))
        shapes = pc.coalesce(pc.binary_join_element_wise(pre, _A_LINK, post, ""), coded.dictionary).dictionary_encode()
        self.ids = shapes.indices.to_numpy()[coded.indices.to_numpy()]
        insides = [x[1:] for x in shapes.dictionary.to_pylist()]       # they begin with <
        infos = [E._tags.get(x) or E._tag(x) for x in insides]
        self.doctype = np.array([i is None and E._DOCTYPE.fullmatch(x) is not None for i, x in zip(infos, insides)], bool)
        self.odd = np.array([i is None or i[0] in E.RAW_TEXT for i in infos], bool) & ~self.doctype
        infos = [i or ("", None, False, (), None, None) for i in infos]
        names: dict[str, int] = {}
        self.name = np.array([names.setdefault(i[0], len(names)) for i in infos], np.int64)
        self.names = names
        self.begins = np.array([i[1] is not None for i in infos], bool)
        self.at_once = np.array([i[2] or i[0] in E.VOID for i in infos], bool)
        self.kind = np.array([_KINDS[i[5]] for i in infos], np.int8)
        self.linked = np.array([i[0] == "a" and i[4] is not None for i in infos], bool)
        self.tags = pa.array([i[0] for i in infos], pa.string())
        self.classes = pa.array([i[3] for i in infos], pa.list_(pa.string()))
        hrefs = pa.array([i[4] for i in infos], pa.string()).take(shapes.indices)
        self._hrefs = pc.if_else(pc.fill_null(pc.and_(pc.equal(hrefs, _A_LINK), link.is_valid()), False), link, hrefs)
        self._distinct = coded.indices

    def hrefs(self, tokens: np.ndarray) -> pa.Array:
        return self._hrefs.take(self._distinct.take(pa.array(tokens)))


def _said(texts: pa.Array) -> pa.Array:
    if len(some := np.flatnonzero(pc.match_substring(texts, "&").to_numpy(zero_copy_only=False))):
        mask = np.zeros(len(texts), bool)
        mask[some] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([unescape(t) for t in texts.take(pa.array(some)).to_pylist()], pa.string()))
    return pc.utf8_trim(texts, characters=_SPACE)


def _places(names: np.ndarray, kinds: int, levels: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """The place of each element among those of its name below the same element."""
    n = len(names)
    above = n + pages                        # elements of the first level: by page
    order = np.argsort(levels, kind="stable")
    cuts = np.searchsorted(levels[order], np.arange(1, levels.max(initial=0) + 2))
    for i in range(1, len(cuts) - 1):
        upper, lower = order[cuts[i - 1]:cuts[i]], order[cuts[i]:cuts[i + 1]]
        above[lower] = upper[np.searchsorted(upper, lower) - 1]
    key = above * kinds + names
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    nth = np.empty(n, np.int64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0)) + 1
    return nth


def _first_of(some: np.ndarray, rows: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Of the marked pairs the first ``count`` of each row."""
    seen = np.cumsum(some)
    before = np.concatenate(([0], seen))[starts]
    return some & (seen - before[rows] <= count)


def _elements(html: pa.Array, tag: str, with_desc: bool | str) -> tuple[np.ndarray, pa.Array | None, np.ndarray | None]:
    """(pages that are not plain, elements, elements per page); the latter two only if
    there are no such pages."""
    n = len(html)
    odd = np.zeros(n, bool)
    ends = np.frombuffer(html.buffers()[1], np.int32)[html.offset:html.offset + n + 1].astype(np.int64)
    data = np.frombuffer(html.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].copy()
    ends = ends - ends[0]
    starts = ends[:-1]
    opened, closed = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
    page = np.searchsorted(starts, opened, "right") - 1
    odd |= np.bincount(page, minlength=n) != np.bincount(np.searchsorted(starts, closed, "right") - 1, minlength=n)
    filled = np.flatnonzero(ends[1:] > starts)
    odd[filled[data[starts[filled]] != ord("<")]] = True
    if odd.any():
        return odd, None, None
    odd[page[opened > closed]] = True
    odd[page[:-1][closed[:-1] > opened[1:]]] = True
    if odd.any():
        return odd, None, None

    # Tags and the texts behind them, as slices of the pages.
    m = len(opened)
    data[closed] = ord(" ")
    cuts = np.empty(2 * m + 1, np.int32)
    cuts[0:2 * m:2], cuts[1:2 * m:2], cuts[2 * m] = opened, closed, len(data)
    pieces = pa.StringArray.from_buffers(2 * m, pa.py_buffer(cuts), pa.py_buffer(data))
    tags = _Tags(pieces.take(pa.array(np.arange(0, 2 * m, 2))))
    ids = tags.ids
    doctype, begins = tags.doctype[ids], tags.begins[ids]
    odd[page[tags.odd[ids]]] = True
    odd[page[doctype & (opened != starts[page])]] = True
    if odd.any():
        return odd, None, None

    # Nesting: every end closes the element that is open.
    at_once = begins & tags.at_once[ids]
    opens, shuts = begins & ~at_once, ~begins & ~doctype
    step = opens.astype(np.int64) - shuts
    odd |= np.bincount(page, weights=step, minlength=n) != 0
    if odd.any():
        return odd, None, None
    depth = np.cumsum(step)
    odd[page[(depth < 0) | (depth > DEEPEST)]] = True
    if odd.any():
        return odd, None, None
    both = np.flatnonzero(opens | shuts)
    both = both[np.argsort((depth[both] + shuts[both]).astype(np.int16), kind="stable")]
    first, last = both[0::2], both[1::2]
    odd[page[first[tags.name[ids[first]] != tags.name[ids[last]]]]] = True
    until = np.arange(m)
    until[first] = last

    # Elements in document order: interval of their descendants, and of their texts.
    tokens = np.flatnonzero(begins)
    ids, page, until = ids[tokens], page[tokens], until[tokens]
    name, end = tags.name[ids], np.cumsum(begins)[until]
    items = np.flatnonzero(name == tags.names.get(tag, -1))
    cells = np.flatnonzero(name == tags.names.get("td", -1)) if with_desc else items[:0]
    for some in (items, cells):              # within one another: their content comes more than once
        odd[page[some[:-1][end[some[:-1]] > some[1:]]]] = True
    if odd.any():
        return odd, None, None
    said = _said(pieces.take(pa.array(np.arange(1, 2 * m, 2))))
    kept = pc.binary_length(said).to_numpy() > 0
    said = said.filter(pa.array(kept))
    before = np.cumsum(kept) - kept
    texts, text_counts = before[tokens], before[until] - before[tokens]

    nodes = _lists(said, texts[items], text_counts[items])
    links = np.flatnonzero(tags.linked[ids])
    first_link = np.searchsorted(links, items, "right")
    link_counts = np.searchsorted(links, end[items], "left") - first_link
    if with_desc == "listing":               # the first link is all that is read
        link_counts = np.minimum(link_counts, 1)
    per_page = np.bincount(page[items], minlength=n)
    first_item = np.cumsum(per_page) - per_page

    if with_desc:
        # Elements that begin within a row of a listing, or every element.
        some = np.flatnonzero(tags.kind[ids] >= 0) if with_desc == "listing" else np.arange(len(ids))
        lo = np.searchsorted(some, items, "right")
        counts = np.searchsorted(some, end[items], "left") - lo
        d, row = some[_ranges(lo, counts)], np.repeat(np.arange(len(items)), counts)
        nth = _places(name, len(tags.names), (depth[tokens] + at_once[tokens]).astype(np.int16), page)
        cell = np.full(len(d), -1)
        if len(cells):
            near = cells[np.maximum(np.searchsorted(cells, d, "right") - 1, 0)]
            cell = np.where((near <= d) & (d < end[near]), near, -1)
        inside = cell > items[row]
        cell_nth = np.where(inside, nth[cell] if len(nth) else 0, 0)
        if with_desc == "listing":
            kind, begin = tags.kind[ids[d]], np.cumsum(counts) - counts
            keep = kind == _KINDS["badge"]
            for marked, count in ((kind == _KINDS["marker"], 1), ((kind == _KINDS["span"]) & (cell_nth == 2), 2), (kind == _KINDS["p"], 1),
                                  ((kind == _KINDS["td"]) & (nth[d] == 3), 1), ((kind == _KINDS["td"]) & (nth[d] == 4), 1)):
                keep |= _first_of(marked, row, begin, count)
            d, row, inside, cell_nth = d[keep], row[keep], inside[keep], cell_nth[keep]
            counts = np.bincount(row, minlength=len(items))
        d_ids = pa.array(ids[d])
        inner = pa.StructArray.from_arrays(
            [tags.tags.take(d_ids), pa.array(nth[d], pa.int32()), pa.array(cell_nth, pa.int32(), mask=~inside), tags.classes.take(d_ids),
             _lists(said, texts[d], text_counts[d]), tags.hrefs(tokens[d])], ["tag", "nth", "cell", "classes", "nodes", "href"])
        desc = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), inner)
    else:
        desc = None
    item_ids = pa.array(ids[items])
    columns = [pa.array(np.arange(len(items)) - first_item[page[items]], pa.int32()), tags.tags.take(item_ids), tags.classes.take(item_ids),
               tags.hrefs(tokens[items]), pc.binary_join(nodes, ""), nodes,
               _lists(tags.hrefs(tokens[links]), first_link, link_counts), desc]
    return odd, columns, per_page


def read_pages(html: pa.Array, tag: str, with_desc: bool | str, desc_type: pa.DataType) -> tuple[np.ndarray, pa.Array]:
    """(which pages are read here, the ``tag`` elements of each of them), as
    ``extract._explode_page`` gives them. Read are pages that begin with a tag, hold no < or >
    but those of tags, no comments, no elements of own rules and a doctype at most first;
    whose elements are all closed in order; and whose ``tag`` elements and cells hold none
    of their own."""
    html = pc.ascii_ltrim_whitespace(pc.fill_null(html.cast(pa.string()), ""))
    left = np.arange(len(html))
    while len(left):
        some = html if len(left) == len(html) else html.take(pa.array(left))
        odd, columns, per_page = _elements(some, tag, with_desc)
        if not odd.any():
            break
        left = left[~odd]
    read = np.zeros(len(html), bool)
    read[left] = True
    if not len(left):
        return read, None
    if columns[-1] is None:
        columns[-1] = pa.nulls(len(columns[0]), desc_type)
    items = pa.StructArray.from_arrays(columns, E.ELEMENT_FIELDS)
    return read, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_page))), pa.int32()), items)
