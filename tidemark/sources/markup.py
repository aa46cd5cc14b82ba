"""A small element tree of HTML: enough of the standard's repairs to ask for ancestors, cells and texts.

Void elements hold nothing; ``option``, ``li``, ``p``, cells, rows and row groups end where the next of their kind
begins; an ``a`` ends an open ``a``; an end tag closes its element and what is open in it, but reaches no further than
the table, cell or list around it. Stray end tags are ignored, what is open at the end is closed. Content that the
standard would move out of a table stays where it is written. Character references are the standard's, unless a page
is said to write only some.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CELLS, _GROUPS = {"td", "th"}, {"tbody", "thead", "tfoot"}
#: What a start tag ends, and the elements it looks no further than.
_ENDS = {
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "td": (_CELLS, {"tr", "table"}),
    "th": (_CELLS, {"tr", "table"}),
    "tr": (_CELLS | {"tr"}, {"table"}),
    **{g: (_CELLS | _GROUPS | {"tr"}, {"table"}) for g in _GROUPS},
    "a": ({"a"}, _CELLS | {"table"}),
    **{b: ({"p"}, _CELLS | {"table", "li", "button"}) for b in "p div ul ol table form h1 h2 h3 h4 section article nav header footer main pre hr".split()},
}
_BOUNDS = _CELLS | {"table", "html"}
_INNER = {"td": {"table"}, "th": {"table"}, "tr": {"table"}, **{g: {"table"} for g in _GROUPS}, "table": {"html"}}


class Element:
    __slots__ = ("attrs", "children", "classes", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = attrs.get("class", "").split()
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def find(self, tag: str, *classes: str, without: str = "", **attrs: str) -> Element | None:
        return next(self.find_all(tag, *classes, without=without, **attrs), None)

    def find_all(self, tag: str, *classes: str, without: str = "", **attrs: str) -> Iterator[Element]:
        for e in self.walk():
            if (not tag or e.tag == tag) and all(c in e.classes for c in classes) and without not in e.classes and all(e.attrs.get(k) == v for k, v in attrs.items()):
                yield e

    def ancestors(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    @property
    def text(self) -> str:
        parts, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                parts.append(c)
            else:
                stack.extend(reversed(c.children))
        return "".join(parts)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("html", {}, None)

    def _close(self, tags: set[str], bounds: set[str], last: bool) -> None:
        """Closes up to the nearest element of a kind, or to the farthest, not looking beyond the bounds."""
        e, found = self.at, None
        while e is not self.root and e.tag not in bounds - tags:
            if e.tag in tags:
                found = e
                if not last:
                    break
            e = e.parent
        if found is not None:
            self.at = found.parent

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS:
            self._close(*_ENDS[tag], last=True)
        if tag in ("html", "head", "body"):
            return
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        e = Element(tag, first, self.at)
        self.at.children.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close({tag}, _INNER.get(tag, _BOUNDS), last=False)

    def handle_data(self, data):
        self.at.children.append(data)


_AMPERSAND = re.compile(r"<(/?)(script|style)(?=[\s/>])|&([A-Za-z][A-Za-z0-9]*;)?", re.IGNORECASE)


def only_references(html: str, names: tuple[str, ...] | None) -> str:
    """The page with every ``&`` escaped that doesn't begin one of the named references, semicolon and all, so that all
    others stay as they are written; scripts and styles have none. Without names the page as it is."""
    if names is None:
        return html
    raw: str | None = None

    def put(m: re.Match) -> str:
        nonlocal raw
        if m[2]:
            if not m[1]:
                raw = raw or m[2].lower()
            elif raw == m[2].lower():
                raw = None
        elif raw is None and (m[3] or "")[:-1] not in names:
            return "&amp;" + m[0][1:]
        return m[0]

    return _AMPERSAND.sub(put, html)


def parse(html: str, references: tuple[str, ...] | None = None) -> Element:
    b = _Builder()
    b.feed(only_references(html, references))
    b.close()
    return b.root
