"""CSS selectors over a parsed page, in time linear in elements times steps.

A list of selectors is judged for all elements of a page at once. Left to right, each element keeps
the set of steps that a match has come to at it, and hands it on to children, later siblings and
all below; nested lists (``:not``, ``:is``) are judged once for the whole page. ``:has`` goes the
other way: from the last step of its argument back to the element that has it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from .dom import Element

_IDENT = r"-?(?:[A-Za-z_\u0080-\U0010FFFF]|\\.)(?:[\w\u0080-\U0010FFFF-]|\\.)*"
_NAME = rf"(?:{_IDENT}|--[\w-]*)"
_ATTR = re.compile(rf"""\[\s*({_IDENT})\s*(?:([~^$*|]?=)\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|({_NAME}|[\w-]+))\s*([iIsS])?\s*)?\]""")
_NTH = re.compile(r"\s*(?:(even)|(odd)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*\Z", re.I)
_NESTED = ("not", "is", "where", "has", "matches")
_COUNTED = ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type")
_PLAIN = ("first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type", "empty", "root")


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


class _Reader:
    """Reads a selector list into lists of (combinator, tests); ValueError for what is none."""

    def __init__(self, css: str) -> None:
        self.css, self.at = css, 0

    def take(self, pattern: str | re.Pattern) -> re.Match | None:
        m = re.compile(pattern).match(self.css, self.at)
        if m:
            self.at = m.end()
        return m

    def fail(self) -> ValueError:
        return ValueError(f"invalid selector: {self.css}")

    def group(self, end: str, relative: bool = False) -> tuple:
        """Selectors up to the end (a closing bracket, or nothing)."""
        out = [self.one(relative)]
        while self.take(r"\s*,"):
            out.append(self.one(relative))
        self.take(r"\s*")
        if end and not self.take(re.escape(end)) or not end and self.at < len(self.css):
            raise self.fail()
        return tuple(out)

    def one(self, relative: bool) -> tuple:
        self.take(r"\s*")
        how = (self.take(r"([>+~])\s*") or [None, " "])[1] if relative else " "
        steps = [(how, self.compound())]
        while m := self.take(r"\s*([>+~])\s*|\s+(?![\s,)]|\Z)"):
            steps.append((m[1] or " ", self.compound()))
        return tuple(steps)

    def compound(self) -> tuple:
        tests: list[tuple] = []
        if m := self.take(rf"\*|{_IDENT}"):
            tests.append(("any",) if m[0] == "*" else ("tag", _plain(m[0]).lower()))
        while True:
            if m := self.take(rf"#({_NAME}|[\w-]+)"):
                tests.append(("id", _plain(m[1])))
            elif m := self.take(rf"\.({_NAME})"):
                tests.append(("class", _plain(m[1])))
            elif m := self.take(_ATTR):
                value = next((_plain(x) for x in m.group(3, 4, 5) if x is not None), None)
                tests.append(("attr", _plain(m[1]).lower(), m[2], value.lower() if value is not None and m[6] in ("i", "I") else value, m[6] in ("i", "I")))
            elif m := self.take(r":([A-Za-z-]+)(\()?"):
                tests.append(self.pseudo(m[1].lower(), bool(m[2])))
            else:
                break
        if not tests:
            raise self.fail()
        return tuple(tests)

    def pseudo(self, name: str, open_: bool) -> tuple:
        if open_ and name in _NESTED:
            return ("has" if name == "has" else "not" if name == "not" else "is", self.group(")", name == "has"))
        if open_ and name in _COUNTED:
            m = self.take(r"([^()]*)\)")
            n = m and _NTH.match(m[1])
            if not n:
                raise self.fail()
            if n[1] or n[2]:
                a, b = 2, 0 if n[1] else 1
            elif n[6]:
                a, b = 0, int(n[6])
            else:
                a, b = int(n[3] + "1") if n[3] in ("", "+", "-") else int(n[3]), int((n[4] or "+") + (n[5] or "0"))
            return (name, a, b)
        if not open_ and name in _PLAIN:
            return (name,)
        raise self.fail()


@lru_cache(maxsize=512)
def compiled(css: str) -> tuple:
    """Raises ValueError for what isn't a selector."""
    return _Reader(css).group("")


class Page:
    """The elements below and with a root, and what selectors ask about them."""

    def __init__(self, root: Element) -> None:
        self.elements = [root, *root.walk()]
        place = {id(e): i for i, e in enumerate(self.elements)}
        n = len(self.elements)
        self.parent, self.before, self.nth, self.of_type, self.from_end, self.type_from_end = ([-1] * n for _ in range(6))
        for i, e in enumerate(self.elements):
            own, kinds = [place[id(c)] for c in e.elements()], {}
            for k, c in enumerate(own):
                tag = self.elements[c].tag
                kinds.setdefault(tag, []).append(c)
                self.parent[c], self.before[c], self.nth[c], self.from_end[c] = i, own[k - 1] if k else -1, k + 1, len(own) - k
            for alike in kinds.values():
                for k, c in enumerate(alike):
                    self.of_type[c], self.type_from_end[c] = k + 1, len(alike) - k
        for counts in (self.nth, self.of_type, self.from_end, self.type_from_end):
            counts[0] = 1
        self.lists: dict[tuple, list[bool]] = {}

    def fits(self, i: int, tests: tuple) -> bool:
        return all(self.test(i, self.elements[i], t) for t in tests)

    def test(self, i: int, e: Element, t: tuple) -> bool:
        kind = t[0]
        if kind == "tag":
            return e.tag == t[1]
        if kind == "any":
            return True
        if kind == "id":
            return e.attrs.get("id") == t[1]
        if kind == "class":
            return t[1] in e.attrs.get("class", "").split()
        if kind == "attr":
            v = e.attrs.get(t[1])
            return v is not None and (t[2] is None or _OPERATORS[t[2]](v.lower() if t[4] else v, t[3]))
        if kind in ("is", "not"):
            return self.matches(t[1])[i] is (kind == "is")
        if kind == "has":
            return self.having(t[1])[i]
        if kind == "empty":
            return not e.children
        if kind == "root":
            return self.parent[i] < 0 and e.parent is None
        if kind in _COUNTED:
            counts = {"nth-child": self.nth, "nth-last-child": self.from_end, "nth-of-type": self.of_type, "nth-last-of-type": self.type_from_end}[kind]
            a, b, at = t[1], t[2], counts[i]
            return at == b if a == 0 else (at - b) % a == 0 and (at - b) // a >= 0
        first, last = (self.of_type, self.type_from_end) if kind.endswith("type") else (self.nth, self.from_end)
        return (kind.startswith("last") or first[i] == 1) and (kind.startswith("first") or last[i] == 1)

    def matches(self, selectors: tuple) -> list[bool]:
        """Of each element, whether one of the selectors matches it."""
        if selectors not in self.lists:
            found = [False] * len(self.elements)
            for steps in selectors:
                for i, ok in enumerate(self.match(steps)):
                    found[i] |= ok
            self.lists[selectors] = found
        return self.lists[selectors]

    def match(self, steps: tuple) -> list[bool]:
        """Bit k of ``here``: the steps up to k match, ending at the element; of ``above``: at it or
        an ancestor; of ``left``: at it or an earlier sibling."""
        n, last = len(self.elements), len(steps) - 1
        here, above, left = [0] * n, [0] * n, [0] * n
        for i in range(n):
            up, prev, bits = self.parent[i], self.before[i], 0
            for k, (how, tests) in enumerate(steps):
                if k:
                    from_ = above[up] if how == " " and up >= 0 else here[up] if how == ">" and up >= 0 else here[prev] if how == "+" and prev >= 0 else left[prev] if how == "~" and prev >= 0 else 0
                    if not from_ >> (k - 1) & 1:
                        continue
                if self.fits(i, tests):
                    bits |= 1 << k
            here[i], above[i], left[i] = bits, bits | (above[up] if up >= 0 else 0), bits | (left[prev] if prev >= 0 else 0)
        return [b >> last & 1 == 1 for b in here]

    def having(self, selectors: tuple) -> list[bool]:
        """Of each element, whether one of the relative selectors finds something from it."""
        key = ("has", selectors)
        if key not in self.lists:
            found = [False] * len(self.elements)
            for steps in selectors:
                ok = [True] * len(self.elements)
                for how, tests in reversed(steps):
                    ok = self.reached([o and self.fits(i, tests) for i, o in enumerate(ok)], how)
                found = [a or b for a, b in zip(found, ok, strict=True)]
            self.lists[key] = found
        return self.lists[key]

    def reached(self, ok: list[bool], how: str) -> list[bool]:
        """Of each element, whether one that is ok stands in this relation to it."""
        out, after = [False] * len(ok), [False] * len(ok)
        for i in range(len(ok) - 1, -1, -1):
            up, prev = self.parent[i], self.before[i]
            if how in "> " and up >= 0 and (ok[i] or how == " " and out[i]):
                out[up] = True
            if how in "+~" and prev >= 0 and (ok[i] or how == "~" and after[i]):
                out[prev] = after[prev] = True
        return out


_OPERATORS: dict[str, Callable[[str, str], bool]] = {
    "=": lambda v, x: v == x,
    "~=": lambda v, x: x in v.split(),
    "^=": lambda v, x: bool(x) and v.startswith(x),
    "$=": lambda v, x: bool(x) and v.endswith(x),
    "*=": lambda v, x: bool(x) and x in v,
    "|=": lambda v, x: v == x or v.startswith(x + "-"),
}


def select(root: Element, css: str) -> list[Element]:
    """Elements that fit, in page order; the root itself may be one."""
    page = Page(root)
    return [e for e, ok in zip(page.elements, page.matches(compiled(css)), strict=True) if ok]
