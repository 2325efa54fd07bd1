"""Markdown of a parsed page; no Spark here.

Rendering is a fold over the tree with one output buffer per block: inline parts are appended to
the buffer of the block that holds them, and blocks are set off from what stands before them by
exactly one blank line. The methods of ``Renderer`` that need the Markdown of an element ask for it
by ``yield`` and are resumed with it, so a page may nest as deep as it likes.
"""

from __future__ import annotations

import re
from collections.abc import Generator

from .dom import Element, collapse, join, text_of
from .selectors import select

#: Bytes of text below which a preferred root may give way to the body.
LEAST_ROOT = 500
_DROPPED = frozenset(("script", "style", "noscript", "template", "svg"))
_BLOCKS = frozenset(("p", "div", "section", "article", "main", "header", "footer", "aside"))
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
CLEANED = ("nav", "header", "footer", "aside", "form", "dialog")


def content_root(page: Element) -> Element:
    """HTM1: the first main, else the first article, else the body. A preferred element with
    little text gives way to a body with much more, and the article isn't tried after a main."""
    body = page.find("body")
    size = lambda e: len(text_of(e).encode()) if e is not None else 0
    for tag in ("main", "article"):
        node = page.find(tag)
        if node is not None:
            own = size(node)
            if own < LEAST_ROOT and size(body) >= max(LEAST_ROOT, 3 * own):
                break
            return node
    return body if body is not None else page


def resolved(base: str, link: str) -> str | None:
    """HTM17."""
    link = link.strip()
    return None if not link or link.startswith(("#", "javascript:")) else join(base, link)


class _Buffer:
    def __init__(self) -> None:
        self.text = ""

    def inline(self, text: str) -> None:
        """HTM10."""
        words = collapse(text)
        if not words:
            return
        if text[0].isspace() and self.text and not self.text[-1].isspace():
            self.text += " "
        self.text += words + (" " if text[-1].isspace() else "")

    def block(self, text: str) -> None:
        """HTM11."""
        text = text.strip()
        if text:
            before = self.text.rstrip()
            self.text = (f"{before}\n\n" if before else self.text) + f"{text}\n\n"


#: Asks for generators to be run, is resumed with what they return, and returns a text or nothing.
Steps = Generator["Steps", str | None, str | None]


def run(steps: Steps) -> str | None:
    """What the generator returns, those it asks for run first; on a stack of our own."""
    stack, value = [steps], None
    while stack:
        try:
            asked = stack[-1].send(value)
            value = None
            stack.append(asked)
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


class Renderer:
    """HTM6 to HTM9 for pages of one base URL."""

    def __init__(self, base: str) -> None:
        self.base = base

    def rendered(self, e: Element) -> str:
        return run(self.inside(e))

    def inside(self, e: Element, raw: bool = False) -> Steps:
        out = _Buffer()
        yield self.children(e, out, raw)
        return out.text

    def children(self, e: Element, out: _Buffer, raw: bool) -> Steps:
        for c in e.children:
            if not isinstance(c, str):
                yield self.node(c, out, raw)
            elif raw:
                out.text += c
            else:
                out.inline(c)

    def node(self, x: Element, out: _Buffer, raw: bool) -> Steps:
        tag = x.tag
        if tag in _DROPPED:
            return
        if tag in _BLOCKS:
            out.block((yield self.inside(x)))
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            out.block(f"{'#' * int(tag[1])} {(yield self.inside(x)).strip()}")
        elif tag in _MARKS:
            text = (yield self.inside(x)).strip()
            if text:
                out.text += _MARKS[tag] + text + _MARKS[tag]
        elif tag == "a":
            yield self.link(x, out)
        elif tag == "br":
            out.text += "\n"
        elif tag == "hr":
            out.block("---")
        elif tag == "code":
            if x.parent is not None and x.parent.tag == "pre":
                yield self.children(x, out, True)
            elif text := (yield self.inside(x, True)):
                out.text += f"`{text.strip()}`"
        elif tag == "pre":
            text = "".join(x.texts())
            if text.strip():
                fence = "```"
                out.block(f"{fence}\n{text.strip(chr(10))}\n{fence}")
        elif tag == "img":
            src = resolved(self.base, x.attrs.get("src", ""))
            if src is not None:
                out.text += f"![{x.attrs.get('alt', '').strip()}]({src})"
        elif tag in ("ul", "ol"):
            yield self.list(x, out)
        elif tag == "li":
            out.block(f"- {(yield self.inside(x)).strip()}")
        elif tag == "blockquote":
            text = yield self.inside(x)
            out.block("\n".join(f"> {line}" for line in text.strip().split("\n")))
        elif tag == "table":
            self.table(x, out)
        else:
            yield self.children(x, out, raw)

    def link(self, x: Element, out: _Buffer) -> Steps:
        label, href = (yield self.inside(x)).strip(), x.attrs.get("href")
        href = resolved(self.base, href) if href is not None else None
        out.text += label if href is None else f"[{label}]({href})" if label else href

    def list(self, x: Element, out: _Buffer) -> Steps:
        lines, number = [], 0
        for item in x.elements():
            if item.tag != "li":
                continue
            number += 1
            first, *more = (yield self.inside(item)).strip().split("\n")
            if first or more:
                lines.append((f"{number}. " if x.tag == "ol" else "- ") + first)
            lines += [f"  {m}" for m in more if m.strip()]
        out.block("\n".join(lines))

    def table(self, x: Element, out: _Buffer) -> None:
        rows = [[text_of(c) for c in r.elements() if c.tag in ("td", "th")] for r in x.walk() if r.tag == "tr"]
        rows = [r for r in rows if r]
        if rows:
            width = len(rows[0])
            lines = ["| " + " | ".join((r + [""] * width)[:width]) + " |" for r in rows]
            lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
            out.block("\n".join(lines))


def blank_collapsed(text: str) -> str:
    """HTM12."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in text.split("\n"))).strip()


def title_of(page: Element) -> str | None:
    node = page.find("title")
    return text_of(node) if node is not None else None


def render(page: Element, root: Element, base: str) -> str:
    """HTM4: the root's Markdown under the page's title, unless it begins with that anyway."""
    text = blank_collapsed(Renderer(base).rendered(root))
    if not text:
        text = text_of(root)
    title = title_of(page)
    if title and not text.lstrip().startswith(f"# {title}"):
        text = f"# {title}\n\n{text.strip()}".strip()
    return blank_collapsed(text)


def configured(page: Element, only_main: bool, only_clean: bool, include: list[str], exclude: list[str]) -> str:
    """HTM2: html of the chosen part without what is excluded. A removed element's markup goes
    wherever it stands, also where another element has the same."""
    from .dom import parse

    if include:
        html = "\n".join(e.outer() for css in include for e in select(page, css))
    elif only_main:
        html = content_root(page).outer()
    else:
        body = page.find("body")
        html = (body if body is not None else page).outer()
    for css in [*exclude, *(CLEANED if only_clean else ())]:
        for gone in [e.outer() for e in select(parse(html), css) if e.tag not in ("html", "head", "body")]:
            html = html.replace(gone, "")
    return html
