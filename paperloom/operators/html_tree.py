"""A small element tree over the standard library's HTML tokenizer.

Comments, scripts and styles are not text. An unclosed paragraph, list item, row or cell
ends where the next one of its kind begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
_FENCE = {"table", "ul", "ol", "div", "figure", "article", "section", "body", "span", "thead", "tbody", "tfoot"}


class Node:
    """An element; ``children`` holds nodes and strings.

    All elements of a page lie in one list in document order, in which those below an element follow it.
    """

    __slots__ = ("tag", "attrs", "classes", "children", "parent", "order", "first", "end")

    def __init__(self, tag: str, attrs: dict[str, str], classes: list[str], parent: Node | None, order: list[Node]):
        self.tag, self.attrs, self.classes, self.children, self.parent, self.order = tag, attrs, classes, [], parent, order
        if parent is not None:
            parent.children.append(self)
            order.append(self)
        self.first = self.end = len(order)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> list[Node]:
        """Descendants in document order."""
        return self.order[self.first : self.end]

    def find_all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def find(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def inside(self, tag: str) -> bool:
        up = self.parent
        while up is not None:
            if up.tag == tag:
                return True
            up = up.parent
        return False

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                stack.extend(x.children[::-1])
        return "".join(out)


def _place(at: Node, tag: str) -> Node:
    """The element that a new one goes into, after those are closed that it ends."""
    if ends := _ENDS.get(tag):
        up = at
        while up.parent is not None and up.tag not in _FENCE:
            if up.tag in ends:
                at = up.parent
                break
            up = up.parent
        if tag == "tr" and at.tag in ("td", "th", "tr"):
            at = at.parent
    return at


def _after(at: Node, tag: str) -> Node:
    """The element that is open after an end tag."""
    up = at
    while up is not None and up.tag != tag:
        up = up.parent
    return up.parent if up is not None and up.parent is not None else at


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, [], None, [])

    def _node(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        return Node(tag, values, values.get("class", "").split(), self.at, self.root.order)

    def handle_starttag(self, tag, attrs):
        self.at = _place(self.at, tag)
        node = self._node(tag, attrs)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self._node(tag, attrs)

    def handle_endtag(self, tag):
        self.at = _after(self.at, tag)

    def handle_data(self, data):
        self.at.children.append(data)


#: Tags in their plain form, the only one that ``_quick`` reads: ``<`` and ``>`` nowhere but around them, values in double quotes.
_PLAIN = re.compile(r"""(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>(?:[ \t\n\r\f]+[a-zA-Z_:][-a-zA-Z0-9_:.]*(?:="[^"]*")?)*)[ \t\n\r\f]*(?P<empty>/?)""")
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:="([^"]*)")?""")
_IGNORED = re.compile(r"!--(?:[^-]|-(?!-))*--|!doctype.*", re.I | re.S)
_SKIP, _OPEN, _EMPTY, _CLOSE, _RAW, _OTHER = range(6)
_known: dict[str, tuple] = {}


def _tag(head: str) -> tuple:
    """(kind, tag, attributes, classes) of what stands between ``<`` and ``>``."""
    m = _PLAIN.fullmatch(head)
    if not m:
        return (_SKIP if _IGNORED.fullmatch(head) else _OTHER, "", {}, [])
    tag = m["tag"].lower()
    if m["close"]:
        return (_OTHER if m["attrs"] or m["empty"] else _CLOSE, tag, {}, [])
    attrs = {k.lower(): unescape(v) for k, v in _ATTR.findall(m["attrs"])}
    kind = _EMPTY if m["empty"] else _RAW if tag in HTMLParser.CDATA_CONTENT_ELEMENTS else _OPEN
    return (kind, tag, attrs, attrs.get("class", "").split())


def _quick(html: str) -> Node | None:
    """The tree of a page all of whose tags are plain, the same as the tokenizer's; None where one is not."""
    lead, *pieces = html.split("<")
    root = at = Node("", {}, [], None, [])
    order, raw, within = root.order, "", []
    if lead:
        at.children.append(unescape(lead))
    for piece in pieces:
        head, closed, text = piece.partition(">")
        if raw:
            if not (closed and head[:1] == "/" and head[1:].strip().lower() == raw):
                within.append(piece)
                continue
            if content := "<".join(within):
                at.children.append(content)
            raw, kind, tag = "", _CLOSE, raw
        elif not closed:
            return None
        else:
            found = _known.get(head)
            if found is None:
                found = _tag(head)
                if len(head) < 200:
                    if len(_known) >= 4096:
                        _known.clear()
                    _known[head] = found
            kind, tag, attrs, classes = found
        if kind == _OPEN:
            node = Node(tag, attrs, classes, _place(at, tag), order)
            at = node.parent if tag in _VOID else node
        elif kind == _CLOSE:
            at = _after(at, tag)
        elif kind == _EMPTY:
            Node(tag, attrs, classes, at, order)
        elif kind == _RAW:
            at, raw, within = Node(tag, attrs, classes, _place(at, tag), order), tag, [text]
            continue
        elif kind == _OTHER:
            return None
        if text:
            at.children.append(unescape(text) if "&" in text else text)
    return None if raw else root


def closed_references(html: str) -> str:
    """A page in which ``&`` stands for itself wherever no known reference with its semicolon follows."""
    return re.sub(r"&(?:(#?[0-9A-Za-z]+;)|)", lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", html)


def parse(html: str) -> Node:
    """The tree of a page."""
    root = _quick(html or "")
    if root is None:
        builder = _Builder()
        builder.feed(html)
        builder.close()
        root = builder.root
    for node in reversed(root.order):
        node.parent.end = max(node.parent.end, node.end)
    return root


def has(tag: str | None = None, cls: str | None = None) -> Callable[[Node], bool]:
    """A test of tag and class."""
    return lambda n: (tag is None or n.tag == tag) and (cls is None or cls in n.classes)
