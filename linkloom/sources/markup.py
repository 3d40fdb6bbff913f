"""Anchors of one HTML document, for use inside Spark tasks."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.entities import html5

# Fixed values of the HTML standard.
# Elements whose content is text, not markup (scripting on).
RAW_TEXT = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
# Elements that never have content.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Start tags that end an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre "
    "section summary table ul xmp".split()
)
# Start tags that end an open sibling of the given names.
ENDS_SIBLING = {
    "li": ("li",),
    "dd": ("dd", "dt"),
    "dt": ("dd", "dt"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tr": ("td", "th", "tr"),
    "option": ("option",),
}
# Elements beyond which no end tag or sibling rule reaches.
SCOPE = frozenset("applet caption html marquee object table template".split())


# A comment, any other declaration, or a tag.  Quotes count only after "=".
_TOKEN = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+>|/[^a-zA-Z][^>]*+>|"""
    r"""(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"""
    r"""(?P<attributes>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>)""",
    re.DOTALL,
)
_MARKUP = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(
    r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?"""
)
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)")


def _attribute_text(value: str) -> str:
    """Decode references; one without a semicolon must be a whole word not before "="."""

    def decode(match: re.Match) -> str:
        name = match.group(1)
        if name[0] == "#" or name.endswith(";"):
            return unescape(match.group())
        if name in html5 and value[match.end() : match.end() + 1] != "=":
            return html5[name]
        return match.group()

    return _REFERENCE.sub(decode, value) if "&" in value else value


def _href(attributes: str) -> str | None:
    for match in _ATTRIBUTE.finditer(attributes):
        if match.group(1).lower() == "href":
            value = match.group(2) or match.group(3) or match.group(4) or ""
            return _attribute_text(value)
    return None


class _Tracker:
    """Open elements around and inside the current anchor."""

    def __init__(self) -> None:
        self.found: list[tuple[str, str]] = []
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.href: str | None = None
        self.text: list[str] = []
        self.depth = 0

    def finish(self) -> None:
        if self.href is not None:
            self.found.append((self.href, "".join(self.text)))
            self.href, self.text = None, []

    def pop_to(self, index: int) -> None:
        if self.href is not None and index <= self.depth:
            self.finish()
        self.count.subtract(self.open[index:])
        del self.open[index:]

    def pop_open(self, names) -> None:
        """Close the innermost of ``names``, unless a scope lies in between."""
        if not any(self.count[name] > 0 for name in names):
            return
        for index in range(len(self.open) - 1, -1, -1):
            if self.open[index] in names:
                self.pop_to(index)
                return
            if self.open[index] in SCOPE:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in ENDS_PARAGRAPH:
            self.pop_open(("p",))
        if name in ENDS_SIBLING:
            self.pop_open(ENDS_SIBLING[name])
        if name == "a":
            self.pop_open(("a",))
            if (href := _href(attributes)) is not None:
                self.href, self.depth = href, len(self.open)
        if name not in VOID:
            self.open.append(name)
            self.count[name] += 1

    def end(self, name: str) -> None:
        if name not in SCOPE:
            self.pop_open((name,))
        elif self.count[name] > 0:
            self.pop_to(len(self.open) - 1 - self.open[::-1].index(name))


def anchors(html: str) -> list[tuple[str, str]]:
    """``(href, text)`` of every anchor with an ``href``, in document order.

    An anchor's text ends at its end tag, at the next ``<a>``, at the end of an
    element around it, or at the end of the document.
    """
    if "<a" not in html and "<A" not in html:
        return []
    tracker = _Tracker()
    position = 0
    while (begin := _MARKUP.search(html, position)) is not None:
        if tracker.href is not None:
            tracker.text.append(unescape(html[position : begin.start()]))
        token = _TOKEN.match(html, begin.start())
        if token is None:
            # The document ends inside a tag, which then counts for nothing.
            position = len(html)
            break
        position = token.end()
        if token["name"] is None:
            continue
        name = token["name"].lower()
        if token["end"]:
            tracker.end(name)
            continue
        tracker.start(name, token["attributes"])
        if name in RAW_TEXT:
            close = re.compile(rf"</{name}(?=[\s/>])|\Z", re.IGNORECASE).search(html, position)
            if tracker.href is not None:
                tracker.text.append(html[position : close.start()])
            position = close.start()
    if tracker.href is not None:
        tracker.text.append(unescape(html[position:]))
        tracker.finish()
    return tracker.found
