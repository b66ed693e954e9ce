"""Main text of web pages by site template removal (operator 5).

Every page is read into elements and each element's subtree is hashed. Spark
counts, per host, the different main texts with which a subtree occurs; subtrees
that recur with many of them are template and are deleted, as are elements that
say what they are (menus, headers, footers, forms, adverts, comments ...). What
holds running text of the article, in an element of whatever kind, is never taken
for template: a passage may well stand on many pages. Without article and main
the element that holds most of the running text is the article.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitlens.llm.common import row_hash, stored

MANY = 50                # main texts of a host that make a subtree template in any case
FEW, SHARE = 4, 0.1      # ... or at least this many, and this share of its main texts
SEED = 5

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas",
       "audio", "video", "select"}
DROPPED = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "option", "optgroup", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "tr", "dt", "dd",
               "figcaption", "caption"} | INLINE
FRAME = {"html", "body", "article", "main", "head"}
# What an element of one kind closes when it opens, up to the elements named.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = {"article", "main", "section", "div", "td", "th", "table", "body", "html", "nav", "aside", "footer", "header", "form"}
SAYS = {"nav", "navbar", "navigation", "menu", "sidebar", "footer", "header", "masthead", "ad", "ads", "advert",
        "adverts", "advertisement", "advertising", "banner", "promo", "promoted", "sponsor", "sponsored", "cookie",
        "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay",
        "newsletter", "subscribe", "signup", "share", "sharing", "social", "comment", "comments", "disqus", "replies",
        "related", "breadcrumb", "breadcrumbs", "widget", "toolbar", "skip", "pagination", "pager"}
# Words that say nothing more beside one of SAYS: in an article a name of several
# parts counts only if its other parts are of these ("related-posts", not "related-work").
SLOTS = {"area", "articles", "bar", "block", "body", "box", "button", "buttons", "container", "content", "form", "group",
         "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "posts",
         "reader", "right", "row", "section", "site", "slot", "stories", "thread", "top", "unit", "user", "wrap", "wrapper"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TAG = re.compile(r"<[/!]?[a-zA-Z]")
_QUOTE = re.compile(r"""=\s*(["'])""")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_PARTS = re.compile(r"[^a-z0-9]+")


def _events(page: str):
    """(kind, tag, attributes or text): "text", "open", "close", in one pass.
    Comments, declarations and the content of raw elements are left out; a raw
    element without an end tag ends at the next tag."""
    at, n, open_quotes, endless = 0, len(page), {'"': True, "'": True}, set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1:lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt + 1)
        if m is None:
            yield "text", "", "<"
            at = lt + 1
            continue
        # The tag ends at the first > outside quotes.
        end = m.end()
        while True:
            gt = page.find(">", end)
            if gt < 0:
                end = n
                break
            quoted = _QUOTE.search(page, end, gt)
            if quoted is None or not open_quotes[quoted.group(1)]:
                end = gt
                break
            close = page.find(quoted.group(1), quoted.end())
            if close < 0:                        # no such quote ever again
                open_quotes[quoted.group(1)] = False
                end = gt
                break
            end = close + 1
        tag = m.group(1).lower()
        if page[lt + 1] == "/":
            yield "close", tag, ""
            at = end + 1
            continue
        inside = page[m.end():end]
        yield "open", tag, inside
        at = end + 1
        if tag in RAW:
            if inside.endswith("/"):
                yield "close", tag, ""
                continue
            stop = None if tag in endless else _END[tag].search(page, at)
            if stop is None:                     # no such end tag ever again
                endless.add(tag)
                stop = _TAG.search(page, at)
                yield "close", tag, ""
            at = n if stop is None else stop.start()


@dataclass
class Element:
    tag: str
    parent: "Element | None"
    dropped: bool = False       # by what it says, itself or an ancestor
    main: bool = False          # in an article, or is one
    body: bool = False          # in a main element, or is one
    prose: bool = False         # in a block of running text, or is one
    parts: list = field(default_factory=list)
    hash: int = 0
    size: int = 0               # characters of running text in it
    inside: bool = False        # in the article of the page, whatever stands for it
    holds: bool = False         # running text of that article


@dataclass
class Page:
    elements: list
    blocks: list                # (text, element, whether it is links alone), in page order
    explicit: bool = False      # the page has an article or main element


def _named(value: str, article: bool) -> bool:
    """Whether a class or id says that the element is no part of the article. In an
    article whole names count, not any part of one."""
    if not article:
        return not SAYS.isdisjoint(_PARTS.split(value))
    for name in value.split():
        parts = {x for x in _PARTS.split(name) if x and not x.isdigit()}
        if not SAYS.isdisjoint(parts) and parts <= SAYS | SLOTS:
            return True
    return False


def _says(tag: str, inside: str, article: bool = False) -> bool:
    """Whether an element is dropped by its tag or attributes. Ids of headings are
    marks to jump to, and headings of an article are text whatever their class."""
    if tag in DROPPED:
        return True
    if not inside or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(inside):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in INLINE - {"span", "a"} and not (tag in HEADINGS and (article or name == "id")):
            if _named(value, article):
                return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def read_page(page: str) -> Page:
    """Elements with subtree hashes, and blocks of text."""
    root = Element("", None)
    stack, elements, blocks, text = [root], [], [], []
    open_tags: Counter = Counter()
    plain = False               # whether the text has words outside links

    def flush():
        nonlocal plain
        said = " ".join("".join(text).split())
        text.clear()
        if said:
            blocks.append((said, stack[-1], not plain))
        plain = False

    def close():
        e = stack.pop()
        open_tags[e.tag] -= 1
        if e.tag not in INLINE:
            if text:
                stack.append(e)
                flush()
                stack.pop()
        e.hash = xxhash.xxh64_intdigest("\x1f".join([e.tag, *e.parts]), SEED)
        stack[-1].parts.append(f"{e.hash:x}")

    def close_to(tags, scope):
        if not any(open_tags[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in scope:
                return

    for kind, tag, inside in _events(page):
        if kind == "text":
            said = references.unescape(inside)
            text.append(said)
            said = " ".join(said.split())
            if said:
                stack[-1].parts.append(said)
                plain = plain or not open_tags["a"]
        elif kind == "close":
            if tag == "br" or tag == "p" and not open_tags["p"]:
                text.append(" ")
                continue
            close_to({tag}, () if tag not in INLINE and tag != "p" else SCOPE - {tag})
        else:
            if tag == "br":
                text.append(" ")
            if tag not in INLINE:
                flush()
                close_to({"p"}, SCOPE)
                close_to({"option"}, SCOPE)      # holds text alone
            if tag in CLOSES:
                close_to(*CLOSES[tag])
            if tag in VOID:
                stack[-1].parts.append(tag)
                continue
            up = stack[-1]
            said = _says(tag, inside, up.main or up.body)
            e = Element(tag, up, up.dropped or said, up.main or tag == "article", up.body or tag == "main" or 'role="main"' in inside,
                        up.prose or tag in TEXT_BLOCKS - INLINE)
            elements.append(e)
            stack.append(e)
            open_tags[tag] += 1
    flush()
    while len(stack) > 1:
        close()
    page = Page(elements, blocks)
    _find_article(page, root)
    return page


def _find_article(p: Page, root: Element) -> None:
    """Marks what is inside the article and what holds running text of it: articles,
    else main, else the element that holds most of the text in blocks of running
    text (menus, which are links alone, set aside), or of all text if none is."""
    kept = [e for e in p.elements if not e.dropped]
    inner = "main" if any(e.tag == "article" for e in kept) else "body" if any(e.body for e in kept) else ""
    p.explicit = bool(inner)
    said = [(t, e) for t, e, links in p.blocks if not e.dropped and (inner or not links)]
    prose = [(t, e) for t, e in said if e.prose]
    if inner:
        for e in p.elements:
            e.inside = getattr(e, inner)
    else:
        for t, e in prose or said:
            e.size += len(t)
        for e in reversed(p.elements):
            e.parent.size += e.size
        # Elements with more than half lie in one another; the last is the innermost.
        most = [e for e in p.elements if 2 * e.size > root.size and (e.tag not in TEXT_BLOCKS or e.tag == "td")]
        top = most[-1] if most else root
        top.inside = True
        for e in p.elements:
            e.inside = e.inside or e.parent.inside
        if not prose and top is not root and top.tag not in FRAME:
            prose = said
    for _, e in prose:
        if e.inside:
            while e is not None and not e.holds:
                e.holds, e = True, e.parent


def _protected(e: Element) -> bool:
    """What holds running text of the article, and the frame of the page."""
    return e.tag in FRAME or not e.dropped and (e.holds or e.inside and e.tag in TEXT_BLOCKS)


def subtree_hashes(page: str | None) -> tuple[int, list[int]]:
    """Hash of the main text, template included, and distinct hashes of the
    elements that may be template."""
    p = read_page(page or "")
    said = [t for t, e, _ in p.blocks if e.inside and not e.dropped]
    text = xxhash.xxh64_intdigest("\n".join(said).encode("utf-8", "surrogatepass"), SEED)
    return text, list({e.hash for e in p.elements if not _protected(e)})


def main_text(page: str | None, template: set[int] = frozenset()) -> str:
    """Blocks outside template and dropped elements, two line ends between."""
    p = read_page(page or "")
    gone: dict[int, bool] = {}

    def is_gone(e):
        chain = []
        while e is not None and id(e) not in gone:
            chain.append(e)
            e = e.parent
        state = gone[id(e)] if e is not None else False
        for x in reversed(chain):
            state = state or x.dropped or x.hash in template and not _protected(x)
            gone[id(x)] = state
        return state

    return "\n\n".join(t for t, e, _ in p.blocks if (e.inside or not p.explicit) and not is_gone(e))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host_of(url):
    """Host of a URL in lower case, without user and port; none: empty."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(k, h): page key and the template subtrees on that page. Pages of a host
    with equal main texts count as one."""
    def run(batches):
        for batch in batches:
            read = [subtree_hashes(t.as_py()) for t in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("host"), pa.array([_signed(m) for m, _ in read], pa.int64()),
                 pa.array([[_signed(x) for x in h] for _, h in read], pa.list_(pa.int64()))], ["k", "host", "m", "h"])

    # Stored: pages are read for their hashes once, not for each use of them.
    hashed = stored(pages.select("k", "host", "html").mapInArrow(run, "k long, host long, m long, h array<long>")
                    .groupBy("k", "host").agg(F.first("m").alias("m"), F.first("h").alias("h")), "subtrees")
    on = hashed.select("k", "host", F.explode("h").alias("h"))
    sizes = hashed.select("host", "m").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    once = hashed.select("host", "m", F.explode("h").alias("h")).distinct()
    counts = once.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEW)
    found = (counts.join(sizes, "host").where((F.col("n") >= MANY) | (F.col("n") >= SHARE * F.col("pages")))
             .select("host", "h"))
    return on.join(found, ["host", "h"]).groupBy("k").agg(F.collect_list("h").alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; a null URL belongs to the empty host.
    Text inside one block is joined by single blanks, blocks by two line ends;
    nothing of the article is dropped or cut. Repeated rows give repeated rows.
    """
    keyed = pages.select("page_id", "url", "html", row_hash(SEED, "url", "html").alias("k"),
                         F.xxhash64(host_of(F.col("url"))).alias("host"))

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), {x % (1 << 64) for x in t.as_py() or ()})
                     for h, t in zip(batch.column("html"), batch.column("template"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = keyed.drop("host").join(templates(keyed), "k", "left")
    kinds = dict(pages.dtypes)
    return (joined.select("page_id", "url", "html", "template")
            .mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long"))
