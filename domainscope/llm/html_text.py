"""Main text of web pages by composite text density.

A page is parsed into a DOM. Elements that never hold article text (scripts, styles, forms, navigation, footers, asides,
page headers, hidden elements and those of such a role) are set aside. For each node left, with C characters, T tags, LC characters
in links and LT link tags below it, and with LCb and Cb those of body,

    density = C / T * log(C * T / (LC * LT)) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))

with empty counts read as 1, so that no logarithm has a pole. The density sum of a block is the sum over the blocks below it (inline elements are
looked through) and its own text; the node of the largest sum is taken, ties going to the outer, earlier node. Its path up to body gives a
threshold: while the node above reaches SHARE of the least density met so far, the selection grows to it; an article or main element
around it is taken whole, as an article's short blocks and lists belong to it whatever their density.

Classes and ids only lower scores. A block named as an advert, navigation or comment section counts LOWERED of its density, with all it holds, and so does
one of a doubtful name, which articles have too (related, notice ...), if half of its text is in links or an element has under SPARSE characters.
Within the selection such blocks are left out, except those around its main part, which is found by going down to where most of the text is, counted by
these scores: whatever a wrapper is called, the selected text stays.

Text: character references decoded, white space within a block turned into one space, blocks trimmed and joined in
page order by one line feed. Edge cases: null or empty html, or one with no text, gives an empty string; broken,
unclosed or cut markup is read as browsers do as far as text goes; depth is not limited (nothing recurses); repeated
pages each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_DROP = frozenset("head script style noscript template nav footer aside form iframe object embed svg canvas button select option textarea input dialog menu title noembed noframes audio video map".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption html body legend option optgroup".split())
#: An element of the key ends an open one of these kinds, unless one of the second set stands between.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])), "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
}
_SCOPE = frozenset("article aside body button div blockquote section main table td th li ul ol header footer nav form".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor(?:ed)?|sidebar|side-bar|navbar|navigation|nav|breadcrumbs?|footer|masthead|cookies?|gdpr|newsletter|popup|comments?|disqus|toolbar|pagination|pager|skip-link)(?:$|[\s_-])", re.I
)
_DOUBTFUL = re.compile(r"(?:^|[\s_-])(?:banner|promo\w*|menu|consent|notice|subscribe|modal|share|sharing|social|related|recommended|respond|replies|widget)(?:$|[\s_-])", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Characters to an element below which a block of a doubtful name is no text; what is left of the density of blocks by their name; the
#: share of the least density on the path so far that the node above needs.
SPARSE, LOWERED, SHARE = 20, 0.02, 0.7
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<decl>[!?/](?![a-zA-Z])[^>]*)(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?P<cut>\Z)))", re.S)
_ATTR = re.compile(r"""([^\s/=][^\s/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "kids", "drop", "doubt", "low", "own", "counts", "density", "sum", "weight")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, low: bool = False, doubt: bool = False):
        self.tag, self.parent, self.drop, self.low, self.doubt, self.kids = tag, parent, drop, low, doubt, []
        #: characters, tags, characters in links, link tags: of all below, and without what is in blocks below
        self.counts, self.own = [0, 0, 0, 0], [0, 0, 0, 0]
        self.density = self.sum = self.weight = 0.0


def _attributes(attrs: str) -> dict[str, str]:
    """The values by lower-cased name, of a repeated name the first."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        value = m[2] or ""
        found.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') and value[:1] == value[-1:] else value)
    return found


def _judged(tag: str, attrs: str, inside: Node) -> tuple[bool, bool, bool]:
    """Whether an element never holds article text; whether its name lowers its score; and whether it does if its text is sparse or in links."""
    if tag in _DROP:
        return True, False, False
    if tag == "header":
        while inside is not None:
            if inside.tag in ("article", "main"):
                return False, False, False
            inside = inside.parent
        return True, False, False
    if tag in ("html", "body", "article", "main") or not attrs:
        return False, False, False
    has = _attributes(attrs)
    names = has.get("class", ""), has.get("id", "")
    hidden = "hidden" in has and has["hidden"].lower() != "until-found"
    drop = hidden or has.get("role", "").strip().lower() in _ROLES
    low = any(map(_NAMES.search, names))
    return drop, low, not low and tag not in _HEADINGS and any(map(_DOUBTFUL.search, names))


def parse(html: str) -> Node:
    """The DOM as a tree of nodes whose kids are nodes and strings, in page order."""
    root = Node("#root", None)
    here, at, n = root, 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            here.kids.append(html[at:])
            break
        m = _TAG.match(html, lt)
        if m is None:  # a lone <, or a tag that the end of the page cuts off within quotes
            if re.match(r"<[a-zA-Z/!?]", html[lt : lt + 2]) and html.find(">", lt) < 0:
                if lt > at:
                    here.kids.append(html[at:lt])
                break
            here.kids.append(html[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            here.kids.append(html[at:lt])
        at = m.end()
        if (tag := m["start"]) is not None:
            if m["cut"] is not None:
                break
            tag = tag.lower()
            if tag in _ENDS:
                kinds, stop = _ENDS[tag]
                x = here
                while x is not root and x.tag not in kinds and x.tag not in stop:
                    x = x.parent
                if x.tag in kinds:
                    here = x.parent
            if tag in _CLOSES_P:
                x = here
                while x is not root and x.tag != "p" and x.tag not in _SCOPE:
                    x = x.parent
                if x.tag == "p":
                    here = x.parent
            node = Node(tag, here, *_judged(tag, m["attrs"], here))
            here.kids.append(node)
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                stop = end.start() if end else n
                node.kids.append(html[at:stop])
                at = end.end() if end else n
            elif tag not in _VOID and not (m["attrs"] or "").rstrip().endswith("/") or tag in ("p", "div", "a", "b", "i", "span"):
                here = node
        elif (tag := m["end"]) is not None:
            tag = tag.lower()
            x = here
            while x is not root and x.tag != tag:
                if tag not in _BLOCK and x.tag in _SCOPE:
                    x = root
                    break
                x = x.parent
            if x is not root:
                here = x.parent
    return root


def _kept(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.drop)
    return order


def _is_block(node: Node) -> bool:
    return node.tag in _BLOCK or node.tag in ("#root", "html")


def composite(counts: list[int], share: float) -> float:
    """The density of characters, tags, characters in links and link tags; share: of body's characters, those in links."""
    c, t, lc, lt = (max(x, 1) for x in counts)
    return c / t * math.log(c * t / (lc * lt)) / math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e)) if counts[0] else 0.0


def _measure(root: Node) -> tuple[list[Node], Node]:
    """The nodes that are kept, in page order, with their counts, densities and sums; and the body."""
    order = _kept(root)
    for node in reversed(order):
        chars = sum(len(_SPACE.sub(" ", unescape(k)).strip()) for k in node.kids if isinstance(k, str))
        for counts in (node.counts, node.own):
            counts[0] += chars
            if node.tag == "a":
                counts[2] = counts[0]
        if (up := node.parent) is not None:
            for k in range(4):
                up.counts[k] += node.counts[k] + (k == 1 or k == 3 and node.tag == "a")
                if not _is_block(node):
                    up.own[k] += node.own[k] + (k == 1 or k == 3 and node.tag == "a")
        if node.doubt:
            node.low = 2 * node.counts[2] >= node.counts[0] or node.counts[0] < SPARSE * (1 + node.counts[1])
    body = next((x for x in order if x.tag == "body"), root)
    share = max(body.counts[2], 1) / max(body.counts[0], 1)
    lowered: dict[int, float] = {}
    for node in order:
        score = LOWERED if node.low else lowered.get(id(node.parent), 1.0)
        lowered[id(node)] = score
        node.density = score * composite(node.counts, share)
        node.weight += score * node.own[0] if _is_block(node) else 0.0
        node.sum += score * composite(node.own, share) if _is_block(node) else 0.0
    for node in reversed(order):
        if (up := node.parent) is not None:
            up.weight += node.weight
            up.sum += node.density if _is_block(node) else node.sum
    return order, body


def _select(root: Node) -> tuple[Node, set[int]]:
    """The selected node, and the blocks around its main part."""
    order, body = _measure(root)
    within = [x for x in order if _is_block(x) and (body is root or x.tag not in ("#root", "html"))]
    top = max(within, key=lambda x: x.sum, default=body)
    if not top.sum:
        top = body
    least, x = top.density, top.parent
    while top is not body and x is not None and x is not body and x.density >= SHARE * least:
        least = min(least, x.density) if _is_block(x) else least
        top, x = x, x.parent
    outer, x = top, top
    while x is not None:
        if x.tag in ("article", "main"):
            outer = x
        x = x.parent
    around, x = {id(outer)}, outer
    while (kids := [k for k in x.kids if isinstance(k, Node) and not k.drop and k.weight > 0]):
        x = max(kids, key=lambda k: k.weight)
        around.add(id(x))
    return outer, around


def extract(html: str | None) -> str:
    if not html:
        return ""
    top, around = _select(parse(html))
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            if text := _SPACE.sub(" ", "".join(run)).strip():
                blocks.append(text)
            run.clear()

    stack: list = [top]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            run.append(unescape(k))
        elif k is None:
            end()
        elif not k.drop and not k.low or id(k) in around:
            if k.tag in _BLOCK:
                end()
                stack.append(None)
            elif k.tag == "br":
                run.append(" ")
            stack.extend(reversed(k.kids))
    end()
    return "\n".join(blocks)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def make():
        return lambda rows: ((p, u, t := extract(h), len(t)) for p, u, h in rows)

    return map_rows(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), make,
        "page_id long, url string, text string, n_chars long",
        pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]), rows=500,
    )
