"""A tolerant tree of one stored page, from the standard library's parser.

Void elements have no children; a new paragraph, list item, table row or cell, term or
description ends the open one; block elements end an open paragraph; an end tag closes the
nearest open element of its name and is ignored when there is none.  All character references
are decoded.

The nodes of a page are numbered in document order, and a node's descendants are a range of numbers; lists of
the numbers by tag and by class answer a selector without a walk over the tree.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav "
                  "ol p pre section table ul".split())
#: what a start tag ends, up to the element that bounds the search
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: tags as nearly all are written; the parser reads them as well, only slower, and all others
PLAIN_START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)((?:\x20[a-zA-Z][a-zA-Z0-9]*="[^"&<>]*")*)>""")
PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
ATTRIBUTE = re.compile(r"""\x20([a-zA-Z][a-zA-Z0-9]*)="([^"]*)\"""")
#: elements whose content the parser may read as text
TEXT = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


@lru_cache(maxsize=4096)
def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): value for name, value in ATTRIBUTE.findall(text)}


@lru_cache(maxsize=4096)
def _classes(names: str) -> frozenset[str]:
    return frozenset(names.split())


@lru_cache(maxsize=4096)
def _selector(selector: str) -> tuple[str, str, frozenset[str]]:
    """(key of the list to look into, tag, classes) of ``tag``, ``.class`` or ``tag.class.class``."""
    tag, *classes = selector.split(".")
    return ("." + classes[-1] if classes else tag), tag, frozenset(classes)


class Tree:
    """The nodes of a page in document order, and their numbers by ``tag`` and by ``.class``."""

    __slots__ = ("nodes", "places")

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}


class Node:
    __slots__ = ("tag", "attrs", "classes", "children", "tree", "at", "end")

    def __init__(self, tag: str, attrs: dict[str, str | None], tree: Tree) -> None:
        self.tag, self.attrs = tag, attrs
        self.classes = _classes(attrs.get("class") or "")
        self.children: list[Node | str] = []
        self.tree, self.at = tree, len(tree.nodes)
        self.end = self.at + 1  # of its descendants; set when the element ends
        tree.nodes.append(self)
        tree.places.setdefault(tag, []).append(self.at)
        for c in self.classes:
            tree.places.setdefault("." + c, []).append(self.at)

    def all(self, selector: str, most: int | None = None) -> list[Node]:
        """Descendants that match ``tag``, ``.class`` or ``tag.class.class``, in document order; at most ``most``."""
        key, tag, need = _selector(selector)
        places, nodes, out = self.tree.places.get(key, ()), self.tree.nodes, []
        for i in range(bisect_left(places, self.at + 1), len(places)):
            if places[i] >= self.end:
                break
            n = nodes[places[i]]
            if (not tag or n.tag == tag) and need <= n.classes:
                out.append(n)
                if most is not None and len(out) >= most:
                    break
        return out

    def first(self, selector: str) -> Node | None:
        return next(iter(self.all(selector, 1)), None)

    def strings(self) -> list[str]:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in ("script", "style"):
                stack.extend(reversed(c.children))
        return out

    def text(self) -> str:
        """Text pieces between tags, each stripped, empty ones dropped, joined."""
        return "".join(s.strip() for s in self.strings())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree = Tree()
        self.root = Node("", {}, self.tree)
        self.open = [self.root]

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def _close(self, i: int) -> None:
        """End the open elements from the i-th on."""
        for n in self.open[i:]:
            n.end = len(self.tree.nodes)
        del self.open[i:]

    def _end(self, tags: set[str], bounds: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in bounds:
                return
            if self.open[i].tag in tags:
                self._close(i)
                if not any(n.tag in tags for n in self.open[1:]):
                    return

    def parse_starttag(self, i: int) -> int:
        m = PLAIN_START.match(self.rawdata, i)
        tag = m[1].lower() if m else ""
        if not m or tag in TEXT:
            return super().parse_starttag(i)
        self._start(tag, _attributes(m[2]))
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if not m:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, dict(attrs))

    def _start(self, tag: str, attrs: dict[str, str | None]) -> None:
        if tag in BLOCK:
            self._end({"p"}, {"td", "th", "li", "div", "article", "section", "body"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = Node(tag, attrs, self.tree)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, dict(attrs), self.tree))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder._close(0)
    return builder.root
