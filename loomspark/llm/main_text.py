"""Main text of HTML pages by tree scoring.

Paragraphs give points for their length and commas to their parent and, in part, to the
ancestors above; each container's points are discounted by the share of its text that stands in
links. The best container is kept, with those siblings that score well or read like prose of
their own, and their blocks become the text.

Before scoring, what can't be article text goes: scripts, styles, forms, navigation, headers,
footers and sidebars of the page, dialogs, and boxes whose class, id or role names them as
menus, adverts, notices, sharing bars or reader comments. A form that encloses the article, as on
pages that stand in one form, is opened: only its controls and labels go. Headings, paragraphs,
list items, cells and inline elements aren't boxes: their names, often made from their own words,
drop nothing unless they say advert. A box goes if a whole name says what it is, as in
``comment-list``, ``main-nav`` or ``cookie-text``; outside an article one word of it is enough, as
in ``widget-search-area``, unless another word, as in ``post-related``, speaks for it. A box that
holds the page's article, main element or headline is kept whatever one of its words says, as it
may be a layout's (``content-sidebar-wrap``). An article element named as a comment is one.

Blocks in page order, joined by a line end. White space inside a block is one space.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head script style noscript template svg math iframe object embed canvas audio video form nav footer aside dialog button select textarea input label menu title".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html tbody td tfoot th thead tr".split())
#: Elements across which no paragraph is ended.
_P_BOUNDS = ("td", "th", "table", "button", "caption", "object")
#: A start tag of the key ends an open element of the values, up to the nearest of the bounds.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Words of class, id or role that name what isn't article text; whole words only.
UNWANTED = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs ccpa comment comments commentlist consent cookie cookies discussion disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted related replies reply respond responses share sharing shoutbox sidebar social sponsor sponsored subscribe toolbar complementary contentinfo search".split()
)
#: Words one of which a whole name must hold ...
BOXES = frozenset(
    "ad ads advert advertisement adverts advertising breadcrumb breadcrumbs ccpa comment comments commentlist complementary contentinfo disqus gdpr menu menubar modal nav navbar navigation newsletter pager pagination popup promoted related replies reply respond responses share sharing shoutbox sidebar social sponsor sponsored toolbar".split()
)
#: ... and words that may stand beside these in it.
BESIDE = frozenset(
    "area articles banner bar block body bottom box button buttons container content entry even footer form header icons inner item items left links list main media meta odd outer panel post posts primary right secondary section site slot text thread top tree unit widget widgets wrap wrapper".split()
)
#: Reader comments: an article element of such a name is one.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond responses shoutbox".split())
#: Notices about cookies: a name of both.
COOKIES = frozenset("cookie cookies".split())
NOTICES = frozenset("banner bar consent info message modal notice policy popup text".split())
ADVERTS = frozenset("ad ads advert advertisement adverts advertising sponsored".split())
#: Elements of the text itself, as are all that aren't blocks.
HEADS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXT = HEADS | frozenset("blockquote dd dt figcaption li p pre summary td th tr".split())
#: Roles of boxes that stand over the page or tell of its state.
OVERLAYS = frozenset("alert alertdialog dialog status".split())
#: Links that answer a comment, whole.
REPLY = re.compile(r"(?:reply|reply to .{1,40}|antworten|répondre|responder|responder a .{1,40})", re.I)
#: Elements that may be one comment of a list.
ITEMS = frozenset("article dd div li section".split())
#: Elements that go with the text beside them, whatever their points.
PROSE = HEADS | frozenset("blockquote dl figure ol p pre table ul".split())
#: Names of articles.
ARTICLES = frozenset("article entry post story".split())
#: Words that speak for a box even so.
WANTED = frozenset("article body content entry main post story text".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
#: Attributes in order, each a whole name with its value; quoted values are passed over whole.
_ATTR = re.compile(r"""([^\s"'/=>][^\s/=>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[A-Za-z][a-z]*")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)", re.I)


class Node:
    """An element; its children are elements and strings."""

    __slots__ = ("tag", "names", "whole", "hidden", "children", "parent", "points", "size", "linked", "depth", "holds")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.names, self.whole, self.hidden = frozenset(), frozenset(), False
        self.points, self.size, self.linked = 0.0, 0, 0
        self.depth, self.holds = parent.depth + 1 if parent else 0, None
        if attributes:
            found, whole = set(), set()
            for name, a, b, c in _ATTR.findall(attributes):
                name = name.lower()
                if name in ("class", "id", "role"):
                    found.update(x.lower() for x in _NAME.findall(a or b or c))
                    whole.update((a or b or c).split())
                    if name == "role" and (a or b or c).strip().lower() in OVERLAYS:
                        self.hidden = True
                elif name == "hidden" or (name == "aria-hidden" and (a or b or c).strip().lower() == "true"):
                    self.hidden = True
                elif name == "style" and _UNSEEN.search(a or b or c):
                    self.hidden = True
            self.names, self.whole = frozenset(found), frozenset(whole)

    def unwanted(self, inside: bool, headed: bool, holds: Callable[[Node], bool]) -> bool:
        """Whether it can't be article text. inside: in an article or main element, or in one that
        is named as an article; headed: the same, or in any element with such a word; holds:
        whether an article is in it."""
        if self.tag in DROPPED or self.hidden:
            return True
        if self.tag == "article":
            return self._comment()
        if self.tag in ("html", "body", "main"):
            return False
        if self.tag == "header":  # an article's own header holds its headline
            return not headed
        if self.tag in TEXT or self.tag not in BLOCK:
            return self.tag not in HEADS and any(x.lower() in ADVERTS for x in self.whole)
        if not self.names & UNWANTED:
            return False
        # A paper has a section of that name too, but inside.
        sure = any(map(_box, self.whole)) or (not inside and any(_words(x) & {"discussion"} and _words(x) <= {"discussion"} | BESIDE for x in self.whole))
        if not sure and (inside or self.names & WANTED):
            return False
        # What no word speaks for goes whole; a name that could be a layout's, if no article is in it.
        return (sure and not self.names & WANTED) or not holds(self)

    def _comment(self) -> bool:
        return any(_box(x) and _words(x) & COMMENTS for x in self.whole)


@lru_cache(65_536)
def _words(name: str) -> frozenset[str]:
    return frozenset(x.lower() for x in _NAME.findall(name))


@lru_cache(65_536)
def _box(name: str) -> bool:
    """Whether a whole class, id or role names a menu, advert, sharing bar, notice or comment box."""
    words = _words(name)
    return bool(words & BOXES) and words <= BOXES | BESIDE or bool(words & COOKIES) and words <= COOKIES | NOTICES | BESIDE and bool(words & NOTICES)


def parse(text: str) -> Node:
    """A tree of the page. Unknown, unclosed and stray tags are taken as browsers do in the main:
    a stray end tag is passed over, an open paragraph ends where a block begins."""
    root = Node("html", None)
    top, at, n = root, 0, len(text)
    #: Open elements by tag, outermost first; and all open blocks. So no search walks up the tree.
    opened: dict[str, list[Node]] = {"html": [root]}
    blocks = [root]

    def nearest(tags: tuple[str, ...]) -> Node | None:
        return max((opened[t][-1] for t in tags if opened.get(t)), key=lambda x: x.depth, default=None)

    def closed(node: Node) -> Node:
        """Closes ``node`` and all that is open in it; its parent is on top then."""
        x = top
        while True:
            opened[x.tag].pop()
            if blocks[-1] is x:
                blocks.pop()
            if x is node:
                return node.parent
            x = x.parent

    while at < n:
        m = _TAG.search(text, at)
        if m is None:
            top.children.append(text[at:])
            break
        if m.start() > at:
            top.children.append(text[at : m.start()])
        at = m.end() if m.end() > m.start() else m.end() + 1
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                top.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            node = nearest((tag,))
            # A block's end tag closes what is open in it; an inline one stops at a block.
            if node is not None and node.parent is not None and (tag in BLOCK or node.depth > blocks[-1].depth):
                top = closed(node)
            elif tag == "br":
                top.children.append(Node("br", top))
            continue
        if tag == "html":
            continue
        if tag in ENDS_P:
            node, bound = nearest(("p",)), nearest(_P_BOUNDS)
            if node is not None and (bound is None or node.depth > bound.depth):
                top = closed(node)
        if tag in IMPLIED:
            ended, bounds = IMPLIED[tag]
            bound = nearest(bounds)
            depth = bound.depth if bound is not None else -1
            if tag == "tr":  # the row itself, with its cells
                places = [(opened[t], bisect.bisect_right(opened[t], depth, key=lambda x: x.depth)) for t in ended if opened.get(t)]
                node = min((nodes[k] for nodes, k in places if k < len(nodes)), key=lambda x: x.depth, default=None)
            else:
                node = nearest(ended)
            if node is not None and node.depth > depth:
                top = closed(node)
        node = Node(tag, top, m[3] or "")
        top.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = _raw_end(tag).search(text, at)
            node.children.append(text[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        if not (m[3] or "").endswith("/") or tag in BLOCK:
            top = node
            opened.setdefault(tag, []).append(node)
            if tag in BLOCK:
                blocks.append(node)
    return root


@cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


def _plain(text: str) -> str:
    return " ".join(html.unescape(text).split()) if "&" in text else " ".join(text.split())


def _uncommented(root: Node) -> None:
    """Takes out reader comments that no name gives away: lists whose items mostly hold a link or
    button to reply. What holds half of the page's text, or its headline, stays."""
    order = _measure(root)
    items: dict[int, Node] = {}
    for node in order:
        if node.tag in ("a", "button") and node.size <= 60 and REPLY.fullmatch(_plain(_text(node))):
            up = node.parent
            while up is not None and up.tag not in ITEMS:
                up = up.parent
            # The item is what stands in a list with others like it.
            while up is not None and up.parent is not None and sum(1 for c in up.parent.children if not isinstance(c, str) and c.tag in ITEMS) == 1 and up.parent.tag in ITEMS and up.parent.size == up.size:
                up = up.parent
            if up is not None:
                items[id(up)] = up
    if not items:
        return
    headed = {}
    for node in reversed(order):
        headed[id(node)] = node.tag in ("h1", "main") or any(headed.get(id(c)) for c in node.children if not isinstance(c, str))
    lists = {id(x.parent): x.parent for x in items.values() if x.parent is not None}
    for box in lists.values():
        own = [c for c in box.children if not isinstance(c, str) and c.tag not in HEADS and c.tag != "form"]
        marked = [c for c in own if id(c) in items and 2 * c.size < root.size and not headed[id(c)]]
        if 2 * len(marked) >= len(own) and 2 * box.size < root.size and not headed[id(box)] and box.parent is not None:
            box.parent.children = [c for c in box.parent.children if c is not box]
        elif marked:
            gone = {id(c) for c in marked}
            box.children = [c for c in box.children if isinstance(c, str) or id(c) not in gone]


def _text(node: Node) -> str:
    return "".join([c if isinstance(c, str) else "".join(x for x in c.children if isinstance(x, str)) for c in node.children])


def _clean(root: Node) -> None:
    """Takes unwanted parts out, with an explicit stack: pages may be deep."""
    _uncommented(root)

    def holds(node: Node) -> bool:
        """An article that isn't a comment, a main element or a headline within; found for all
        elements of the page at the first question."""
        if root.holds is None:
            order = _preorder(root)
            for x in reversed(order):
                x.holds = any(c.holds or c.tag in ("main", "h1") or (c.tag == "article" and not c._comment()) for c in x.children if not isinstance(c, str))
        return node.holds

    forms, todo = [], [(root, False, False)]
    while todo:
        node, inside, headed = todo.pop()
        if node.tag == "form":
            forms.append(node)
        if node.tag in ("article", "main"):
            inside = headed = True
        inside = inside or (node.tag != "body" and bool(node.whole & ARTICLES))
        headed = headed or bool(node.names & ARTICLES)
        node.children = [c for c in node.children if isinstance(c, str) or (c.tag == "form" and not c.hidden) or not c.unwanted(inside, headed, holds)]
        todo += [(c, inside, headed) for c in node.children if not isinstance(c, str)]
    if forms:
        _open_forms(root, forms)


def _open_forms(root: Node, forms: list[Node]) -> None:
    """Takes forms out, but opens those that hold the page's text: an article or main element, two
    or more long paragraphs, or half of the page's text outside links. Controls and labels are out
    already."""
    order = _measure(root)
    held: dict[int, int] = {}  # long paragraphs within
    for node in reversed(order):
        own = node.size - node.linked if node.tag in ("p", "pre", "blockquote", "li", "dd") else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        inner = sum(held.get(id(c), 0) for c in node.children if not isinstance(c, str))
        # An article or main element counts like two paragraphs, if it has text.
        held[id(node)] = 2 if node.tag in ("article", "main") and node.size else inner or int(own >= 80)
    whole = root.size - root.linked
    parents = {}
    for form in forms:
        prose = form.size - form.linked
        if held[id(form)] >= 2 or (prose >= 25 and 2 * prose >= whole):
            form.tag, form.names = "div", frozenset()
            form.children = [c for c in form.children if isinstance(c, str) or c.tag not in ("legend", "datalist")]
        else:
            parents[id(form.parent)] = form.parent
    for node in parents.values():
        node.children = [c for c in node.children if isinstance(c, str) or c.tag != "form"]


def _preorder(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return order


def _measure(root: Node) -> list[Node]:
    """Elements in page order; fills in size and linked (characters of text, and in links)."""
    order = _preorder(root)
    for node in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        inner = [c for c in node.children if not isinstance(c, str)]
        node.size = own + sum(c.size for c in inner)
        node.linked = node.size if node.tag == "a" else sum(c.linked for c in inner)
    return order


def _blocks(node: Node) -> list[str]:
    """The text of each block, in page order; blank ones are left out."""
    out, run, todo = [], [], [node]

    def end() -> None:
        text = _plain("".join(run))
        if text:
            out.append(text)
        run.clear()

    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append("\n")
        elif x.tag in BLOCK:
            end()
            todo.append(None)
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)
    end()
    return out


def _score(order: list[Node]) -> Node | None:
    """Gives points and returns the best container."""
    given = set()
    for node in order:
        if node.tag not in ("p", "pre", "td", "blockquote", "li", "dd") and not (node.tag in ("div", "section", "article", "body", "main") and any(isinstance(c, str) and len(c.strip()) >= 25 for c in node.children)):
            continue
        if node.tag in ("p", "pre", "td", "blockquote", "li", "dd") and any(not isinstance(c, str) and c.tag in BLOCK for c in node.children):
            own = [c if isinstance(c, str) else " ".join(_blocks(c)) for c in node.children if isinstance(c, str) or c.tag not in BLOCK]
        elif node.tag in ("div", "section", "article", "body", "main"):
            own = [c for c in node.children if isinstance(c, str)]
        else:
            own = _blocks(node)
        text = " ".join(own).strip()
        if not text:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= 25 else 0.2
        links = node.linked / node.size if node.size else 0
        points *= 1 - links
        up, level = (node.parent if node.tag not in ("div", "section", "article", "body", "main") else node), 0
        while up is not None and level < 4:
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            given.add(id(up))
            up, level = up.parent, level + 1
    best = None
    for node in order:
        if id(node) in given and node.tag not in ("html", "p", "b", "i", "a", "span", "em", "strong"):
            node.points *= 1 - (node.linked / node.size if node.size else 0)
            if node.tag in ("article", "main"):
                node.points *= 1.5
            if best is None or node.points > best.points:
                best = node
    return best


def extract(page: str | None) -> str:
    """The main text of one page; empty if it has none."""
    root = parse(page or "")
    _clean(root)
    order = _measure(root)
    best = _score(order)
    if best is None:
        return "\n".join(_blocks(root))
    # A list, table part or quotation belongs to the container around it.
    while best.parent is not None and best.tag in ("ul", "ol", "dl", "table", "tbody", "tr", "td", "li", "blockquote", "pre"):
        best = best.parent
    # Inside an article or main element, that element is the container.
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    best = _lifted(best)
    if best.parent is None or best.tag in ("body", "html"):
        return "\n".join(_blocks(best))
    share = best.points * 0.2
    own = best.tag in ("article", "main")
    keep = []
    for other in best.parent.children:
        if other is best:
            keep.append(other)
        elif isinstance(other, str):
            continue
        else:
            links = other.linked / other.size if other.size else 0
            alike = other.tag == "article" == best.tag or (bool(other.names) and other.names == best.names)
            prose = other.tag == "p" and ((other.size > 80 and links < 0.25) or (0 < other.size <= 80 and links == 0 and re.search(r"[.!?](\s|$)", " ".join(_blocks(other)))))
            headline = other.tag in ("h1", "h2", "h3") and links < 0.25
            # An article element has its text in it; beside another container, text is judged by links alone.
            text = not own and other.size > other.linked and links < 0.25 and (other.tag in PROSE or (other.tag in ("div", "section") and other.size - other.linked >= 80))
            if other.points >= (share if alike else max(10.0, share)) or prose or headline or text:
                keep.append(other)
    return "\n".join(x for k in keep for x in _blocks(k))


def _lifted(best: Node) -> Node:
    """The outermost container around ``best`` all of whose parts are text: nothing that is mostly
    links stands beside it on the way. An article or main element stays, as does what is in the
    body itself."""
    while best.tag not in ("article", "main", "body", "html") and best.parent is not None and best.parent.tag not in ("body", "html"):
        beside = [c for c in best.parent.children if not isinstance(c, str) and c is not best and c.size]
        if any(2 * c.linked >= c.size for c in beside):
            break
        best = best.parent
    return best


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``pages``: id, the columns of ``carry``, text and n_chars.

    Null html counts as empty; a page without text gives ''. Broken markup, unknown entities and
    any length are taken as they come; null and repeated ids stay; an empty table gives an empty
    result; other columns of ``pages`` aren't read.
    """
    carry = carry or {}
    rows = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("text"), *[c.alias(f"_c{i}") for i, c in enumerate(carry.values())])
    names = [n for n in rows.columns if n != "text"]
    kinds = [rows.schema[n].dataType.simpleString() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = [extract(p) for p in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*names, "text", "n_chars"])

    out = rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", text string, n_chars bigint")
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(n) for i, n in enumerate(carry)], "text", "n_chars")
