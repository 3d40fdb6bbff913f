"""One HTML document as a tree, read back as links and as normalised source.

For use inside Spark tasks.  Implied elements, misnested formatting and misplaced table
content are put where the HTML standard puts them; framesets, rubies and the finer points of
foreign content are ordinary elements here.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from linkloom.sources.markup import (
    _ATTRIBUTE,
    _MARKUP,
    _TOKEN,
    ENDS_PARAGRAPH,
    RAW_TEXT,
    VOID,
    _attribute_text,
)

# Fixed values of the HTML standard.
_BLANKS = " \t\n\f\r"
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_SCOPE = frozenset("applet caption html marquee object table td template th".split())
_SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center "
    "col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input li link listing main marquee menu meta "
    "nav noembed noframes noscript object ol p param plaintext pre script section select source style "
    "summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
_BLOCK_ENDS = frozenset(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure "
    "footer header hgroup listing main menu nav ol pre section summary ul".split()
)
_IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
_TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
_SECTIONS = frozenset("tbody tfoot thead".split())
_HOLDS_ROWS = frozenset("table tbody tfoot thead tr".split())
_MARKED = frozenset("applet caption marquee object td template th".split())
# What the inside of an element is read as; others are read as what they stand in.
_MODES = {
    "table": "table", "tbody": "section", "tfoot": "section", "thead": "section", "tr": "row",
    "td": "cell", "th": "cell", "caption": "cell", "select": "select", "template": "body",
}
# Elements whose text is written as it is.
_VERBATIM = RAW_TEXT - {"textarea", "title"} | {"plaintext"}
_DECODED = RAW_TEXT - _VERBATIM
_ESCAPES = str.maketrans({"&": "&amp;", "'": "&#39;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "\r": "&#13;"})
#: How many open formatting elements are opened again in the next block; browsers bound this too.
_MOST_REOPENED = 256


class Node:
    """An element: its children are elements, texts, and comments as one-tuples."""

    __slots__ = ("name", "attributes", "children", "parent", "opened")

    def __init__(self, name: str, attributes: list[tuple[str, str]]) -> None:
        self.name, self.attributes = name, attributes
        self.children: list[Node | str | tuple[str]] = []
        self.parent: Node | None = None
        self.opened = False


def _last(nodes: list, wanted: Node) -> int:
    """Where a node is in a list, looked for from the end."""
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i] is wanted:
            return i
    return -1


def _attributes(text: str) -> list[tuple[str, str]]:
    return [
        (m[1].lower(), _attribute_text(next((v for v in m.group(2, 3, 4) if v is not None), "")))
        for m in _ATTRIBUTE.finditer(text)
    ]


class _Builder:
    def __init__(self) -> None:
        self.root = Node("#document", [])
        self.html = self.head = self.body = self.form = None
        self.open: list[Node] = []
        self.modes: list[str] = []
        self.count: Counter[str] = Counter()
        self.active: list[Node | None] = []
        self.foster = False

    # Open elements

    def push(self, name: str, attributes: list[tuple[str, str]]) -> Node:
        node = Node(name, attributes)
        self.put(node)
        self.open.append(node)
        self.modes.append(_MODES.get(name) or (self.modes[-1] if self.modes else "body"))
        self.count[name] += 1
        node.opened = True
        return node

    def pop(self) -> Node:
        node = self.open.pop()
        self.modes.pop()
        self.count[node.name] -= 1
        node.opened = False
        return node

    def pop_until(self, names) -> None:
        while self.pop().name not in names:
            pass

    def put(self, node: Node | str | tuple[str]) -> None:
        """Add to the current element; in front of a table what may not stand between its rows."""
        parent = self.open[-1] if self.open else self.root
        self.put_in(parent, node, self.foster and parent.name in _HOLDS_ROWS)

    def put_in(self, parent: Node, node, before_table: bool) -> None:
        if before_table:
            i = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i].name in ("table", "html"))
            table = self.open[i]
            parent = table.parent if table.name == "table" else table
            at = _last(parent.children, table)
            parent.children.insert(at if at >= 0 else len(parent.children), node)
        else:
            parent.children.append(node)
        if isinstance(node, Node):
            node.parent = parent

    def in_scope(self, names, *more: str) -> bool:
        """Whether one of the names is open, and no element between hides it."""
        if not any(self.count[name] > 0 for name in names):
            return False
        for node in reversed(self.open):
            if node.name in names:
                return True
            if node.name in _SCOPE or node.name in more:
                return False
        return False

    def in_table_scope(self, names) -> bool:
        if not any(self.count[name] > 0 for name in names):
            return False
        for node in reversed(self.open):
            if node.name in names:
                return True
            if node.name in ("table", "html", "template"):
                return False
        return False

    def imply_ends(self, but: str = "") -> None:
        while self.open[-1].name in _IMPLIED and self.open[-1].name != but:
            self.pop()

    def close(self, names, but: str = "") -> None:
        self.imply_ends(but)
        self.pop_until(names)

    def close_paragraph(self) -> None:
        if self.in_scope(("p",), "button"):
            self.close(("p",), "p")

    # Formatting elements

    def unmark(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def formatting(self, name: str, attributes: list[tuple[str, str]]) -> None:
        node = self.push(name, attributes)
        own, same = 0, []
        for i in range(len(self.active) - 1, -1, -1):
            entry = self.active[i]
            if entry is None:
                break
            own += 1
            if entry.name == name and entry.attributes == attributes:
                same.append(i)
        if len(same) >= 3:
            del self.active[same[-1]]
        elif own >= _MOST_REOPENED:
            del self.active[len(self.active) - own]
        self.active.append(node)

    def reopen(self) -> None:
        """Open again the formatting elements that an end tag around them has closed."""
        i = len(self.active)
        while i and self.active[i - 1] is not None and not self.active[i - 1].opened:
            i -= 1
        for at in range(i, len(self.active)):
            entry = self.active[at]
            self.active[at] = self.push(entry.name, entry.attributes)

    def last_active(self, name: str) -> Node | None:
        for entry in reversed(self.active):
            if entry is None:
                return None
            if entry.name == name:
                return entry
        return None

    def end_formatting(self, name: str) -> None:
        """Close a formatting element, and split it around a block that it does not end in."""
        if self.open[-1].name == name and _last(self.active, self.open[-1]) < 0:
            self.pop()
            return
        for _ in range(8):
            node = self.last_active(name)
            if node is None:
                self.end_other(name)
                return
            if not node.opened:
                del self.active[_last(self.active, node)]
                return
            at = _last(self.open, node)
            if any(x.name in _SCOPE for x in self.open[at + 1 :]):
                return
            block = next((i for i in range(at + 1, len(self.open)) if self.open[i].name in _SPECIAL), None)
            if block is None:
                while self.pop() is not node:
                    pass
                del self.active[_last(self.active, node)]
                return
            self.split(node, at, block)

    def split(self, node: Node, at: int, block: int) -> None:
        furthest, ancestor = self.open[block], self.open[at - 1]
        mark = _last(self.active, node)
        last, inner = furthest, 0
        for i in range(block - 1, at, -1):
            inner += 1
            own = self.open[i]
            entry = _last(self.active, own)
            if entry >= 0 and inner > 3:
                del self.active[entry]
                mark -= entry < mark
                entry = -1
            if entry < 0:
                self.drop_open(i)
                continue
            clone = Node(own.name, own.attributes)
            clone.opened, own.opened = True, False
            self.active[entry] = self.open[i] = clone
            if last is furthest:
                mark = entry + 1
            self.detach(last)
            clone.children.append(last)
            last.parent, last = clone, clone
        self.detach(last)
        self.put_in(ancestor, last, ancestor.name in _HOLDS_ROWS)
        clone = Node(node.name, node.attributes)
        for child in furthest.children:
            if isinstance(child, Node):
                child.parent = clone
        clone.children, furthest.children = furthest.children, [clone]
        clone.parent = furthest
        old = _last(self.active, node)
        del self.active[old]
        self.active.insert(mark - (old < mark), clone)
        self.drop_open(_last(self.open, node))
        here = _last(self.open, furthest) + 1
        self.open.insert(here, clone)
        self.modes.insert(here, self.modes[here - 1])
        self.count[clone.name] += 1
        clone.opened = True

    def detach(self, node: Node) -> None:
        if node.parent is not None:
            del node.parent.children[_last(node.parent.children, node)]

    def drop_open(self, at: int) -> None:
        node = self.open.pop(at)
        self.modes.pop(at)
        self.count[node.name] -= 1
        node.opened = False

    # The parts before the body

    def ensure_html(self) -> None:
        if self.html is None:
            self.html = self.push("html", [])

    def ensure_head(self) -> None:
        self.ensure_html()
        if self.head is None:
            self.head = self.push("head", [])

    def ensure_body(self) -> None:
        if self.body is None:
            self.ensure_head()
            if self.head.opened:
                self.pop()
            self.body = self.push("body", [])

    # Tokens

    def text(self, data: str, raw: bool = False) -> None:
        if not data:
            return
        if raw:
            self.put(data)
            return
        if self.body is None:
            rest = data.lstrip(_BLANKS)
            if self.head is not None and len(rest) < len(data):
                self.put(data[: len(data) - len(rest)])
            if not rest:
                return
            self.ensure_body()
            data = rest
        if self.open[-1].name in _HOLDS_ROWS:
            if data.strip(_BLANKS):
                self.foster = True
                self.reopen()
                self.put(data)
                self.foster = False
                return
        else:
            self.reopen()
        self.put(data)

    def comment(self, data: str) -> None:
        self.put((data,))

    def start(self, name: str, attributes: list[tuple[str, str]], closed: bool) -> None:
        if name == "html":
            self.ensure_html()
            known = {k for k, _ in self.html.attributes}
            self.html.attributes += [a for a in attributes if a[0] not in known]
        elif self.body is None and name == "head":
            if self.head is None:
                self.ensure_head()
                self.head.attributes = attributes
        elif self.body is None and name in _HEAD:
            self.ensure_head()
            back = not self.head.opened
            if back:  # after the end of the head these still belong to it
                self.open.append(self.head)
                self.modes.append("body")
            self.push(name, attributes)
            if name in VOID or name in ("basefont", "bgsound"):
                self.pop()
            if back:
                del self.open[_last(self.open, self.head)]
                self.modes.pop()
        elif self.body is None:
            self.ensure_body()
            if name == "body":
                self.body.attributes = attributes
            else:
                self.start_by_mode(name, attributes, closed)
        elif name == "body":
            known = {k for k, _ in self.body.attributes}
            self.body.attributes += [a for a in attributes if a[0] not in known]
        elif name != "head":
            self.start_by_mode(name, attributes, closed)

    def start_by_mode(self, name: str, attributes: list[tuple[str, str]], closed: bool) -> None:
        while True:
            mode = self.modes[-1]
            again = False
            if mode == "cell" and name in _TABLE_PARTS:
                if not self.in_table_scope(("td", "th", "caption")):
                    return
                self.close_cell()
                again = True
            elif mode == "body" and name in _TABLE_PARTS:
                if self.open[-1].name != "template":
                    return
                self.push(name, attributes)
                return
            elif mode == "select":
                if name in ("option", "optgroup", "hr", "script", "template"):
                    if self.open[-1].name == "option":
                        self.pop()
                    if name in ("optgroup", "hr") and self.open[-1].name == "optgroup":
                        self.pop()
                    self.push(name, attributes)
                    if name == "hr":
                        self.pop()
                    return
                self_ends = name in ("input", "keygen", "textarea")
                in_table = "table" in self.modes or "row" in self.modes or "section" in self.modes
                if name != "select" and not self_ends and not (name in _TABLE_PARTS | {"table"} and in_table):
                    return
                self.pop_until(("select",))
                if name == "select":
                    return
                again = True
            elif mode == "row" and name in ("td", "th"):
                self.pop_to_holder("row")
                self.push(name, attributes)
                self.active.append(None)
                return
            elif mode == "row" and name in _TABLE_PARTS:
                self.pop_until(("tr",))
                again = True
            elif mode == "section" and name == "tr":
                self.pop_to_holder("section")
                self.push("tr", attributes)
                return
            elif mode == "section" and name in ("td", "th"):
                self.pop_to_holder("section")
                self.push("tr", [])
                again = True
            elif mode == "section" and name in _TABLE_PARTS:
                self.pop_until(_SECTIONS)
                again = True
            elif mode == "table" and name in _TABLE_PARTS:
                self.pop_to_holder("table")
                if name in ("td", "th", "tr"):
                    self.push("tbody", [])
                    again = True
                elif name == "col":
                    if not (self.open[-1].name == "colgroup"):
                        self.push("colgroup", [])
                    self.push("col", attributes)
                    self.pop()
                    self.pop()
                    return
                else:
                    self.push(name, attributes)
                    if name == "caption":
                        self.active.append(None)
                    elif name == "colgroup":
                        self.pop()
                    return
            elif mode in ("table", "section", "row"):
                if name == "table":
                    if not self.in_table_scope(("table",)):
                        return
                    self.pop_until(("table",))
                    again = True
                elif name in ("script", "style", "template"):
                    self.push(name, attributes)
                    return
                elif name == "input" and dict(attributes).get("type", "").lower() == "hidden":
                    self.push(name, attributes)
                    self.pop()
                    return
                else:
                    self.foster = True
                    self.start_in_body(name, attributes, closed)
                    self.foster = False
                    return
            if not again:
                self.start_in_body(name, attributes, closed)
                return

    def pop_to_holder(self, mode: str) -> None:
        """Leave elements that were opened in front of a table but count as inside it."""
        names = {"row": ("tr",), "section": _SECTIONS, "table": ("table",)}[mode]
        while self.open[-1].name not in names and self.open[-1].name not in ("template", "html"):
            self.pop()

    def close_cell(self) -> None:
        self.imply_ends()
        self.pop_until(("td", "th", "caption"))
        self.unmark()

    def start_in_body(self, name: str, attributes: list[tuple[str, str]], closed: bool) -> None:
        if name in ENDS_PARAGRAPH and name not in ("li", "dd", "dt", "table") or name in ("listing", "plaintext"):
            self.close_paragraph()
            if name in _HEADINGS and self.open[-1].name in _HEADINGS:
                self.pop()
            if name == "form":
                if self.form is not None and self.form.opened:
                    return
                self.form = self.push(name, attributes)
                return
            if name == "xmp":
                self.reopen()
            self.push(name, attributes)
            if name == "hr":
                self.pop()
        elif name in ("li", "dd", "dt"):
            ends = ("li",) if name == "li" else ("dd", "dt")
            for node in reversed(self.open):
                if node.name in ends:
                    self.close((node.name,), node.name)
                    break
                if node.name in _SPECIAL and node.name not in ("address", "div", "p"):
                    break
            self.close_paragraph()
            self.push(name, attributes)
        elif name == "a":
            if (before := self.last_active("a")) is not None:
                self.end_formatting("a")
                if (i := _last(self.active, before)) >= 0:
                    del self.active[i]
                if before.opened:
                    self.drop_open(_last(self.open, before))
            self.reopen()
            self.formatting(name, attributes)
        elif name in _FORMATTING:
            self.reopen()
            if name == "nobr" and self.in_scope(("nobr",)):
                self.end_formatting("nobr")
                self.reopen()
            self.formatting(name, attributes)
        elif name == "button":
            if self.in_scope(("button",)):
                self.close(("button",))
            self.reopen()
            self.push(name, attributes)
        elif name == "table":
            self.close_paragraph()
            self.push(name, attributes)
        elif name in ("optgroup", "option"):
            if self.open[-1].name == "option":
                self.pop()
            self.reopen()
            self.push(name, attributes)
        elif name in ("frame", "frameset"):
            return
        else:
            if name not in ("param", "source", "track") and name not in _HEAD:
                self.reopen()
            self.push("img" if name == "image" else name, attributes)
            if name in _MARKED:
                self.active.append(None)
            foreign = self.count["svg"] > 0 or self.count["math"] > 0
            if name in VOID or name in ("image", "keygen", "basefont", "bgsound") or (closed and foreign):
                self.pop()

    def end(self, name: str) -> None:
        if self.body is None:
            if name == "head" and self.head is not None and self.head.opened:
                self.pop()
                return
            if name in ("html", "body", "br"):
                self.ensure_body()
            elif self.open and self.open[-1].name == name and name in _HEAD:
                self.pop()
                return
            else:
                return
        if name in ("html", "body", "head"):
            return
        while True:
            mode = self.modes[-1]
            if name in ("td", "th", "caption"):
                if mode == "cell" and self.in_table_scope((name,)):
                    self.close((name,))
                    self.unmark()
                return
            if name in _TABLE_PARTS or name == "table":
                if name in ("col", "colgroup") or not self.in_table_scope((name,)):
                    return
                if mode == "cell":
                    if self.in_table_scope(("td", "th", "caption")):
                        self.close_cell()
                        continue
                    return
                self.pop_until((name,))
                return
            if mode == "select":
                if name == "select":
                    self.pop_until(("select",))
                elif name == "optgroup":
                    if self.open[-1].name == "option" and self.open[-2].name == "optgroup":
                        self.pop()
                    if self.open[-1].name == "optgroup":
                        self.pop()
                elif name in ("option", "template", "script") and self.open[-1].name == name:
                    self.pop()
                return
            self.foster = self.open[-1].name in _HOLDS_ROWS
            self.end_in_body(name)
            self.foster = False
            return

    def end_in_body(self, name: str) -> None:
        if name == "p":
            if not self.in_scope(("p",), "button"):
                self.push("p", [])
            self.close(("p",), "p")
        elif name == "br":
            self.reopen()
            self.push("br", [])
            self.pop()
        elif name in _FORMATTING:
            self.end_formatting(name)
        elif name in _HEADINGS:
            if self.in_scope(_HEADINGS):
                self.close(_HEADINGS)
        elif name == "form":
            node, self.form = self.form, None
            if node is not None and node.opened and self.in_scope(("form",)):
                self.imply_ends()
                self.drop_open(_last(self.open, node))
        elif name == "li":
            if self.in_scope(("li",), "ol", "ul"):
                self.close(("li",), "li")
        elif name in _BLOCK_ENDS or name in ("dd", "dt", "applet", "marquee", "object"):
            if self.in_scope((name,)):
                self.close((name,), name)
                if name in _MARKED:
                    self.unmark()
        else:
            self.end_other(name)

    def end_other(self, name: str) -> None:
        if not self.count[name] > 0:
            return
        for node in reversed(self.open):
            if node.name == name:
                self.close((name,), name)
                return
            if node.name in _SPECIAL:
                return


def parse(html: str) -> Node:
    """The document's tree."""
    html = html.replace("\r\n", "\n").replace("\r", "\n")
    builder = _Builder()
    position = 0
    while (begin := _MARKUP.search(html, position)) is not None:
        builder.text(unescape(html[position : begin.start()]))
        token = _TOKEN.match(html, begin.start())
        if token is None:
            position = len(html)  # the document ends inside a tag, which counts for nothing
            break
        position = token.end()
        if token["name"] is None:
            data = token.group()
            if data.startswith("<!--"):
                builder.comment(re.sub(r"^<!--|(?:--!?)?>$|^<!--+>$", "", data))
            elif not data[:9].lower() == "<!doctype":
                builder.comment(data[1:-1] if data[1] == "?" else data[2:-1])
            elif builder.html is None:
                builder.root.children.append(("!" + data[2:-1],))
            continue
        name = token["name"].lower()
        if token["end"]:
            builder.end(name)
            continue
        attributes = token["attributes"]
        closed = attributes.endswith("/")
        builder.start(name, _attributes(attributes), closed)
        here = bool(builder.open) and builder.open[-1].name == name
        if name == "plaintext" and here:
            builder.text(html[position:], raw=True)
            position = len(html)
        elif name in RAW_TEXT and here:
            close = re.compile(rf"</{name}(?=[\s/>])|\Z", re.IGNORECASE).search(html, position)
            data = html[position : close.start()]
            builder.text(unescape(data) if name in _DECODED else data, raw=True)
            builder.pop()
            end = html.find(">", close.start())
            position = end + 1 if end >= 0 else len(html)
        elif name in ("pre", "listing", "textarea") and here and html.startswith("\n", position):
            position += 1
    builder.text(unescape(html[position:]))
    builder.ensure_body()
    return builder.root


def _start_tag(node: Node) -> str:
    return f"<{node.name}" + "".join(f' {k}="{v.translate(_ESCAPES)}"' for k, v in node.attributes) + ">"


def read_back(root: Node) -> tuple[list[tuple[str, str]], str]:
    """``(href, text)`` of every anchor with an ``href`` in tree order, and the tree as source."""
    out: list[str] = []
    found: list[tuple[str, list[str]]] = []
    inside: list[list[str]] = []
    stack: list[tuple[Node, Iterator, bool]] = [(root, iter(root.children), False)]
    while stack:
        node, rest, anchor = stack[-1]
        for child in rest:
            if isinstance(child, str):
                out.append(child if node.name in _VERBATIM else child.translate(_ESCAPES))
                for texts in inside:
                    texts.append(child)
            elif isinstance(child, tuple):
                out.append(f"<{child[0]}>" if node is root and child[0].startswith("!") else f"<!--{child[0]}-->")
            else:
                out.append(_start_tag(child))
                href = next((v for k, v in child.attributes if k == "href"), None) if child.name == "a" else None
                if href is not None:
                    inside.append([])
                    found.append((href, inside[-1]))
                if child.name in VOID:
                    continue
                stack.append((child, iter(child.children), href is not None))
                break
        else:
            stack.pop()
            if anchor:
                inside.pop()
            if node is not root:
                out.append(f"</{node.name}>")
    return [(href, "".join(texts)) for href, texts in found], "".join(out)
