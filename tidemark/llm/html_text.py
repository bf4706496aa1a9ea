"""Main text of web pages by composite text density.

For every node of the page's tree the characters per tag are adjusted by the
share of its characters and tags that are links (marks inside a text, as bold or
line breaks, do not count as tags).  A node's density sum adds the
densities of its children, and the node of the greatest sum leads the article.
The least density on the path from it to the body is the threshold: in every
other node at or above it, the part of the greatest sum is article as well.  So is
the whole of the ``article`` or ``main`` around the lead, or without one what is not
mostly links beside it in its container: short sections, lists and tables.

Menus, forms, adverts, notices, sidebars, footers and reader comments that say
what they are (by tag, role, class or id) are taken out first, so that a dense
advert cannot win.  Names are evidence only, weighed against the text: a node whose
class or id has such a word as one part of a longer name ("with-sidebar",
"related-work") stays if it holds a fifth of the page's characters and few of them
are links; a form, or a node that is named so by a whole name ("ad", "ad-box",
"cookie-banner"), stays if it holds most of the
page's characters and all of its ``article`` and ``main`` elements: it is around the
page then.  On a page without links the plain characters per tag count, for the
adjustment divides by the links.

Defined results: null and empty pages give an empty text, as do pages without a
dense part; unclosed tags end where HTML ends them (a new paragraph, item, row or
cell ends the former, the end of the page ends all); ties in the sum go to the
first node in page order; null ids and repeated rows each get their row.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")

# Fixed values of HTML: elements without content, with raw content, and blocks.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul".split())
#: A start tag ends open elements of these kinds, up to the given bounds.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = _BLOCK - {"caption", "legend", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}

# Parts of a page that are not its article.
_NOT_TAGS = frozenset("nav footer aside form button select menu dialog noscript template svg iframe object head script style "
                      "textarea title canvas audio video map datalist".split())
_NOT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_NOT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promoted "
    "sidebar sidebars aside rail nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead "
    "cookie cookies consent gdpr notice notices banner banners popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget widgets toolbar disclaimer outbrain taboola paywall".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
#: These name parts of articles as well.
_EITHER = frozenset("discussion related recommendations".split())
#: These say nothing beside another word of a name: "ad-box" is an advert, "article-promo" need not be one.
_PLAIN = frozenset("area bar block bottom box center col column container inner item list outer page panel row section site slot "
                   "strip top unit wrap wrapper x".split())
_KEEP = frozenset("html body main".split())
#: Why a node is taken out: for good, as a form or by its name, by a name for comments, by a part of its name.
_HARD, _SOFT, _COMMENT, _WEAK = 1, 2, 3, 4
#: A node with a part of a name stays from this share of the page's characters on, with this share of links at most.
_SHARE, _LINKS = 0.2, 0.3


class _Node:
    __slots__ = ("tag", "parent", "items", "pruned", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "marked")

    def __init__(self, tag, parent, pruned=0):
        self.tag, self.parent, self.items, self.pruned = tag, parent, [], pruned
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best, self.marked = self, False


def _boilerplate(tag: str, attributes: str, inside: set[str]) -> int:
    if tag in _NOT_TAGS and tag != "form" or (tag == "header" and not inside & {"article", "main"}):
        return _HARD
    soft = _SOFT if tag == "form" else 0
    if not attributes.strip() or tag in _KEEP:
        return soft
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in _NOT_ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return _HARD
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return _HARD
    words = {w.lower() for w in _WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    if words & _COMMENT_WORDS:
        return _COMMENT
    if tag == "article" or soft or not words & (_NOT_WORDS | _EITHER):
        return soft
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    parts = [{w.lower() for w in _WORDS.findall(name) if not w.isdigit()} - _PLAIN for name in names]
    return _SOFT if any(x <= _NOT_WORDS | _EITHER and x - _EITHER for x in parts) else _WEAK


def parse(page: str) -> _Node:
    """The tree of a page: nodes, and texts between them."""
    root = _Node("html", None)
    stack, at, size = [root], 0, len(page)
    while at < size:
        mark = page.find("<", at)
        mark = size if mark < 0 else mark
        found = _TOKEN.match(page, mark) if mark < size else None
        if found is None:  # a lone "<" is text
            mark = min(mark + 1, size)
            stack[-1].items.append(page[at:mark])
            at = mark
            continue
        if mark > at:
            stack[-1].items.append(page[at:mark])
        at = found.end()
        closing, tag = found.group(1), (found.group(2) or "").lower()
        if not tag or tag == "html":
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table", "article", "section", "div") and tag not in _BLOCK:
                    break  # an inline end tag does not end a block
            continue
        ends, bounds = _ENDS.get(tag, ((), ()))
        if tag in _ENDS_P:
            ends, bounds = {*ends, "p"}, {*bounds, "table", "button", "article", "section", "div", "td", "th", "blockquote", "li"} - {tag}
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ends:
                cut = k
            elif stack[k].tag in bounds:
                break
        if cut:
            del stack[cut:]
        node = _Node(tag, stack[-1], _boilerplate(tag, found.group(3), {x.tag for x in stack}))
        stack[-1].items.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not node.pruned:
                node.items.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in _VOID and not found.group(3).endswith("/"):
            stack.append(node)
    return root


def _spare(root: _Node) -> None:
    """Keep nodes that are taken out by a word or as a form, but are around the page."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, _Node) and x.pruned != _HARD]
    if not any(x.pruned for x in order):
        return
    chars, core, heads, links = {}, {}, {}, {}
    for node in reversed(order):
        own = [x for x in node.items if isinstance(x, _Node) and x.pruned != _HARD]
        n = chars[node] = sum(len(_SPACE.sub("", x)) for x in node.items if isinstance(x, str)) + sum(chars[x] for x in own)
        links[node] = n if node.tag == "a" else sum(links[x] for x in own)
        # Reader comments are often articles too: they are none of the page's.
        whole = bool(n) and node.tag in ("article", "main") and not node.pruned
        heads[node] = whole or node.tag == "h1" or any(heads[x] for x in own)
        core[node] = whole + sum(core[x] for x in own if x.pruned != _COMMENT or heads[x])
    for node in order:
        if node.pruned == _WEAK and chars[node] >= _SHARE * chars[root] and links[node] <= _LINKS * chars[node]:
            node.pruned = 0
        if node.pruned and 2 * chars[node] > chars[root] and core[node] == core[root] and (node.pruned != _COMMENT or heads[node]):
            node.pruned = 0


def _counts(node: _Node) -> bool:
    """Blocks and links count as tags; marks within a text do not."""
    return node.tag in _BLOCK or node.tag == "a"


def _measure(root: _Node) -> list[_Node]:
    """Counts, densities and sums from the leaves up; the nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, _Node) and not x.pruned]
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(_SPACE.sub("", html.unescape(x)))
            elif not x.pruned:
                node.chars += x.chars
                node.tags += x.tags + _counts(x)
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, max(node.tags, 0)
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if not body.link_chars:
            node.density = c / t
        elif c:
            inner = c / max(c - lc, 1) * lc + share * c + math.e
            node.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / max(math.log(math.log(inner)), math.log(2))
        inside = [x for x in node.items if isinstance(x, _Node) and not x.pruned]
        node.total = sum(x.density if _counts(x) else x.total for x in inside)
        if _counts(node):
            node.total = node.total or node.density
        for x in inside:
            if x.best.total > node.best.total or not _counts(node.best):
                node.best = x.best
    return [body, *(x for x in order if x is not body)]


def _mark(body: _Node) -> None:
    lead = body.best
    threshold, node = lead.density, lead
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    stack = [body]
    while stack:
        node = stack.pop()
        above = node
        while above is not None and not above.marked:
            above = above.parent
        if above is None and node.density >= threshold and node.chars:
            node.best.marked = True
            if node.best is not node:
                stack += [x for x in node.items if isinstance(x, _Node) and not x.pruned]
    # Beside the lead, its container is article even where it is not dense.
    node = lead
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    if node is not None:
        node.marked = True
    elif lead is not body and lead.parent is not None and lead.parent is not body and lead.parent.tag != "html":
        for x in lead.parent.items:
            if isinstance(x, _Node) and not x.pruned and 2 * x.link_chars <= x.chars:
                x.marked = True


def extract(page: str | None) -> str:
    """The article of a page: its blocks, joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    _spare(root)
    body = _measure(root)[0]
    _mark(body)
    blocks, part = [], []

    def close():
        text = " ".join(html.unescape("".join(part)).split())
        part.clear()
        if text:
            blocks.append(text)

    stack = [(body, body.marked, False)]
    while stack:
        item, on, done = stack.pop()
        if isinstance(item, str):
            if on:
                part.append(item)
        elif done:
            close()
        elif not item.pruned:
            on = on or item.marked
            if item.tag in _BLOCK:
                close()
                stack.append((item, on, True))
            elif item.tag == "br":
                part.append(" ")
            stack += [(x, on, False) for x in reversed(item.items)]
    close()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame, *, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, the article ``text`` and its length ``n_chars``."""
    own = pages.select(*keep, page)
    fields = [f for f in own.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"

    def run(batches):
        for batch in batches:
            texts = pa.array([extract(x.as_py()) for x in batch.column(page)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, "text"])

    return own.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
