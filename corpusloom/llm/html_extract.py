"""HTML extraction by composite text density.

A page is parsed into a tree of all its elements in one pass. Every node gets its characters C and
tags T, and the characters LC and tags LT of them that are links. Text in an element that is
boilerplate by its tag, role or class counts as link text too: it is not the page's own. Then, with
b for the body and counts of zero taken as one,

    density = C/T * log(C/LC * T/LT), to the base ln(C/(C-LC) * LC + LCb/Cb * C + e),

and a node's density sum adds up its children's densities. The node of the greatest sum is the core
of the page, with the article or main element around it, if there is one. The threshold is the least
density on the path from the core up to the body: the whole path, or only the part below the body
where an article or main element already says where the text is. Every node is then held against it:

* boilerplate has density 0 and falls;
* a menu (three links or more, two thirds of the text or more) below the threshold falls, in the
  core as well as beside it; short paragraphs of the core stay;
* a container beside the path stays if it reaches the threshold; without an article or main element
  its children are looked at in turn. Paragraphs and headings right on the path stay, beside an
  article only the first heading of a page whose article has none, and text that reaches the threshold.

Defined results: a null, empty or text-free page gives an empty text of 0 characters; unclosed,
crossed or stray tags are closed where the next block begins or dropped; a quotation mark that no
value opens is a part of the attribute's name; repeated rows are extracted row by row; a null id or
url stays null; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bound_batches

_ATTRIBUTES = r"""(?:[\t\n\f\r /]++|(?:=?[^\t\n\f\r />=]++|=)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"[^"]*+"|'[^']*+'|[^\t\n\f\r >]*+))?+)*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\t\n\f\r />]*+)({_ATTRIBUTES})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(=?[^\t\n\f\r />=]++|=)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"([^"]*+)"|'([^']*+)'|([^\t\n\f\r >]*+)))?+""")

#: Elements whose content is no markup, and never article text.
_RAW = {t: re.compile(rf"</{t}(?=[\t\n\f\r />]|\Z)", re.I) for t in "script style textarea title noscript iframe xmp noembed noframes".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split()
)
_INLINE = frozenset("a abbr b cite code em font i label q s small span strong sub sup time u".split())
#: Elements that hold blocks.
_CONTAINERS = frozenset("article main section div center table tbody tr td ul ol dl details fieldset header hgroup body".split())
_OWN = frozenset(("article", "main"))
#: Elements that never hold article text.
_NEVER = frozenset("head nav footer aside form template button select option svg canvas object audio video dialog menu map math".split())
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog toolbar".split())
#: Class and id names of menus, headers, footers, sidebars, notices, adverts and reader comments.
_MARKS = frozenset(
    "nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs pagination pager header masthead footer sidebar notice notices cookie cookies consent gdpr popup modal disclaimer newsletter subscribe ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion related recommended share sharing social comment comments respond reply replies disqus".split()
)
#: Those of them that mark an article of its own as boilerplate, such as a reader's comment.
_ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsor sponsored promo related recommended comment comments respond reply replies teaser".split())
#: What such a name may be joined to: a name with any other part is something else, such as `share-prices`.
_PLACES = frozenset("site page main top bottom left right box list area block wrapper wrap container section bar slot unit inner outer content item items link links button buttons panel text title body post entry global primary secondary id js".split())
_SHUTS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_SPLIT = re.compile(r"[^a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Links that make a menu, and their share of its text, as a fraction.
MENU_LINKS, MENU_SHARE = 3, (2, 3)


class Node:
    __slots__ = ("chars", "density", "items", "kids", "link_chars", "link_tags", "marked", "tag", "tags", "total", "up")

    def __init__(self, tag: str, up: Node | None, marked: bool = False) -> None:
        self.tag, self.up = tag, up
        self.marked = marked  # boilerplate by name
        self.items: list = []  # children and texts in page order
        self.kids: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _named(value: str, marks: frozenset) -> bool:
    """Whether one of the names in a class or id is a mark, alone or with a place such as `site-` or `-list`."""
    for name in value.split():
        parts = [p for p in _SPLIT.split(name) if p]
        if not marks.isdisjoint(parts) and all(p in marks or p in _MARKS or p in _PLACES for p in parts):
            return True
    return False


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate by its tag, role, class or id. inside: it stands in an article."""
    if tag in _NEVER or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("body", "html", "main"):
        return False
    marks = _ARTICLE_MARKS if tag == "article" else _MARKS - {"header"} if inside else _MARKS
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden":
            return True
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if _named(value, marks):
                return True
        elif (name == "role" and value in _ROLES) or (name == "aria-hidden" and value == "true") or (name == "style" and _UNSEEN.search(value)):
            return True
    return False


class _Open:
    """The open elements: a stack, and where on it each tag and each block stands."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at = [root], {}
        self.blocks = [0]

    def deepest(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def push(self, node: Node) -> None:
        if node.tag in _BLOCK or node.tag in ("td", "th"):
            self.blocks.append(len(self.stack))
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Close the element at a depth and all in it."""
        while len(self.stack) > depth:
            self.at[self.stack.pop().tag].pop()
        while self.blocks[-1] >= depth:
            self.blocks.pop()


def parse(source: str, names: bool = True) -> Node:
    """The tree of a page. names: mark the elements that are boilerplate by name."""
    root = Node("body", None)
    open_ = _Open(root)
    stack = open_.stack
    place, n, find = 0, len(source), _TOKEN.search
    while place < n:
        m = find(source, place)
        text_end = m.start() if m else n
        if text_end > place:
            text = source[place:text_end]
            stack[-1].items.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        place = m.end()
        if not m[2]:
            if source.startswith("<![CDATA[", m.start()):
                stack[-1].items.append(source[m.start() + 9 : place].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            depth = open_.deepest((tag,))
            if depth and (tag in _BLOCK or depth > open_.blocks[-1]):  # an inline end tag closes nothing beyond its block
                open_.cut(depth)
            continue
        if tag in _RAW:
            end = _RAW[tag].search(source, place)
            place = n if not end else (source.find(">", end.end()) + 1 or n)
            continue
        if tag in ("html", "body"):
            continue
        if tag in _BLOCK and stack[-1].marked and stack[-1].tag in _INLINE:
            open_.cut(len(stack) - 1)  # a marked inline element ends where a block begins
        if tag in _SHUTS_P and stack[open_.blocks[-1]].tag == "p":
            open_.cut(open_.blocks[-1])
        elif tag in _SAME:
            floor = open_.deepest(_HOLDS[tag])
            same = [open_.at[t][-1] for t in _SAME[tag] if open_.at.get(t) and open_.at[t][-1] > floor]
            if same:
                open_.cut(min(same))
        inside = bool(open_.at.get("article") or open_.at.get("main"))
        node = Node(tag, stack[-1], names and _marked(tag, m[3], inside))
        node.up.items.append(node)
        node.up.kids.append(node)
        if tag not in _VOID and not (m[3].endswith("/") and (tag not in _BLOCK or node.marked)):
            open_.push(node)
    return root


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """The composite text density; share: that of links in the characters of the body."""
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(c / max(1, chars - link_chars) * lc + share * c + math.e)
    return c / t * math.log(c / lc * t / lt) / math.log(base)


def weigh(root: Node) -> list[Node]:
    """Set density and density sum of every node; the nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += reversed(node.kids)
    for node in reversed(order):
        for x in node.items:
            if type(x) is str:
                node.chars += len(" ".join(x.split()))
            else:
                node.chars += x.chars
                node.tags += 1 + x.tags
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a" or x.marked)
        if node.marked or node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    share = root.link_chars / max(1, root.chars)
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in order:
        node.total = sum(k.density for k in node.kids)
    return order


def _is_menu(x: Node) -> bool:
    return x.link_tags + (x.tag == "a") >= MENU_LINKS and MENU_SHARE[1] * x.link_chars >= MENU_SHARE[0] * x.chars


def select(root: Node) -> tuple[set[int], set[int]]:
    """(fallen, hollow): the nodes that fall with all they hold, and those whose own text falls, by id.

    Densities are set already (`weigh`).
    """
    order = []
    stack = [root]
    fallen: set[int] = set()
    while stack:  # boilerplate is no candidate, nor is what it holds
        node = stack.pop()
        if node.marked:
            fallen.add(id(node))
            continue
        order.append(node)
        stack += reversed(node.kids)
    core = max(order, key=lambda x: x.total)  # the first of equals stands highest in the page
    if core.total == 0:
        core = root
    path = [core]
    while path[-1].up is not None:
        path.append(path[-1].up)
    whole = next((i for i, x in enumerate(path) if x.tag in _OWN), None)
    if whole is None:
        while path[0].up is not None and path[0].tag not in _CONTAINERS:
            path.pop(0)
    else:  # an article is kept whole
        path = path[whole:]
    core = path[0]
    threshold = min(x.density for x in (path if whole is None else path[:-1]))
    outermost = max((i for i, x in enumerate(path) if x.tag in _OWN), default=-1)
    headed = whole is None or _has(core, "h1")
    on_path, hollow = {id(x) for x in path}, set()
    for i, node in enumerate(path[1:], 1):
        open_land = whole is not None and i > outermost  # around the article or main element
        if open_land:
            hollow.add(id(node))
        beside = [k for k in node.kids if id(k) not in on_path and not k.marked]
        while beside:
            k = beside.pop()
            if not _is_menu(k) and (k.density >= threshold or (k.tag not in _CONTAINERS and not open_land) or (k.tag == "h1" and not headed)):
                continue
            if whole is None and k.tag in _CONTAINERS and any(x.tag in _CONTAINERS for x in k.kids):
                hollow.add(id(k))
                beside += [x for x in k.kids if not x.marked]
            else:
                fallen.add(id(k))
    fallen.update(id(x) for x in order if id(x) not in on_path and id(x) not in hollow and x.density < threshold and _is_menu(x))
    return fallen, hollow


def _has(node: Node, tag: str) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag == tag and not x.marked:
            return True
        stack += x.kids
    return False


def blocks(node: Node, fallen: set[int] | frozenset = frozenset(), hollow: set[int] | frozenset = frozenset()) -> list[str]:
    """The texts of a subtree's blocks in page order, white space folded."""
    out: list[str] = []
    run: list[str] = []

    def shut() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(text)
            run.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if type(x) is str:
            run.append(x)
        elif x is None:
            shut()
        elif id(x) not in fallen:
            if x.tag in _BLOCK:
                shut()
                stack.append(None)
            elif x.tag in ("br", "td", "th"):
                run.append(" ")
            stack += reversed(x.kids if id(x) in hollow else x.items)
    shut()
    return out


def extract(source: str | None, names: bool = True) -> str:
    """The main text of a page; '' if it has none. names: see `parse`."""
    if not source:
        return ""
    root = parse(source, names)
    weigh(root)
    if not root.chars:
        return ""
    return "\n\n".join(blocks(root, *select(root)))


def extract_of(source: Column) -> Column:
    @F.pandas_udf("string")
    def run(sources: pd.Series) -> pd.Series:
        return pd.Series([extract(x) if isinstance(x, str) else "" for x in sources], dtype=object)

    return run(source.cast("string"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of each row of `pages` (page_id, url, html): a map over rows, without a shuffle."""
    bound_batches(pages.sparkSession)
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), extract_of(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
