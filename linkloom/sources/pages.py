"""Links found on HTML pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.text import WHITE_SPACE, title_or_href
from linkloom.sources.markup import anchors
from linkloom.sources.tree import parse, read_back
from linkloom.workspace import stage

# Fixed value: absolute web addresses in running text, same text in Java and Python.
TEXT_URL = r"""(?i)https?://[^<"' (\r\n)\t]+"""

# Anchors come before text URLs in a page's link order.
FROM_ANCHOR, FROM_TEXT = 0, 1

EMISSION_KINDS = ("item", "link", "follow")

Scanner = Callable[[str, str], Iterable[tuple[str, str, str]]]


def _link_fields(pages: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType(
        [pages.schema[key] for key in keys]
        + [
            T.StructField("src", T.IntegerType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("title", T.StringType()),
            T.StructField("url", T.StringType()),
        ]
    )


def _named_anchors(html: str) -> list[tuple[str, str]]:
    return [(href, text if text.strip(WHITE_SPACE) else href) for href, text in anchors(html)]


# How the written-out tree escapes text and attribute values.
_WRITTEN = {"&#34;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&#13;": "\r", "&amp;": "&"}
_WRITTEN_REFERENCE = re.compile("|".join(_WRITTEN))
# Pages without addresses in which each anchor holds just its text, outside of elements that
# move or drop what is in them: their tree has the anchors that the tokenizer sees.
_PLAIN_ANCHOR = re.compile(r"<a(?:\s[^<>]*)?>[^<]*</a\s*>", re.IGNORECASE)
_START = re.compile(r"<a[\s/>]", re.IGNORECASE)
_MOVES = re.compile(r"<(?:table|select|template|svg|math)", re.IGNORECASE)


def _page_links(body: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Anchors as ``(href, title)`` in tree order, and addresses in the written-out tree."""
    if "://" not in body and not _MOVES.search(body) and (
        len(_START.findall(body)) == len(_PLAIN_ANCHOR.findall(body))
    ):
        return _named_anchors(body), []
    found, source = read_back(parse(body))
    named = [(href, text if text.strip(WHITE_SPACE) else href) for href, text in found]
    return named, _source_urls(source)


def _source_urls(source: str) -> list[str]:
    urls = re.findall(TEXT_URL, source) if "://" in source else []
    return [_WRITTEN_REFERENCE.sub(lambda m: _WRITTEN[m[0]], u) if "&" in u else u for u in urls]


def _scan_links(
    pages: DataFrame,
    keys: Sequence[str],
    html: str,
    links: Callable[[str], Iterator[tuple[int, int, str, str]]],
) -> DataFrame:
    """One narrow pass: read each page, emit its links.  No shuffle."""
    schema = _link_fields(pages, keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[tuple[int, int, str, str]] = []
            for row, body in enumerate(batch.column(html)):
                if body := body.as_py():
                    for link in links(body):
                        rows.append(row)
                        found.append(link)
            if not found:
                continue
            src, pos, title, url = zip(*found)
            index = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(index) for key in keys]
                + [
                    pa.array(src, pa.int32()),
                    pa.array(pos, pa.int32()),
                    pa.array(title, pa.string()),
                    pa.array(url, pa.string()),
                ],
                names=schema.names,
            )

    return pages.select(*keys, html).mapInArrow(scan, schema)


def _all_anchors(body: str) -> Iterator[tuple[int, int, str, str]]:
    for pos, (href, title) in enumerate(_named_anchors(body)):
        yield FROM_ANCHOR, pos, title, href


def _all_text_urls(body: str) -> Iterator[tuple[int, int, str, str]]:
    if "://" in body:
        for pos, url in enumerate(_source_urls(read_back(parse(body))[1])):
            yield FROM_TEXT, pos, url, url


def _first_links(body: str) -> Iterator[tuple[int, int, str, str]]:
    """Each address once, where it stands first; anchors come before text."""
    named, urls = _page_links(body)
    seen: set[str] = set()
    for pos, (href, title) in enumerate(named):
        if href not in seen:
            seen.add(href)
            yield FROM_ANCHOR, pos, title, href
    for pos, url in enumerate(urls):
        if url not in seen:
            seen.add(url)
            yield FROM_TEXT, pos, url, url


# --- native extraction: column expressions only -------------------------------------

_ATTRIBUTES = r"""[aA](?=[\s/])((?:[^>"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+)"""
_COMMENT = r"!--.*?(?:-->|\z)"
_RAW_TEXT = "iframe|noembed|noframes|noscript|script|style|textarea|title|xmp"
# One pass: comments and raw text are matched too, so that nothing inside is found.
_SCAN = (
    rf"(?s)<(?:{_COMMENT}|((?i:{_RAW_TEXT}))\b.*?(?:</(?i:\1)\s*+>|\z)"
    rf"|{_ATTRIBUTES}(?:>(?:[^<]++|<{_COMMENT}|<(?!/[aA]\s*+>|[aA][\s/>]))*+|\z))"
)
_ANCHOR_PARTS = rf"(?s)^<{_ATTRIBUTES}>(.*)"
_HREF = (
    r"""(?is)(?:^|[\s/"'])href(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))|(?=[\s/]|\z))"""
)


def _unescape(text: Column) -> Column:
    """The predefined entities; the ampersand last, so nothing is decoded twice."""
    for entity, char in (
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&apos;", "'"),
        ("&#39;", "'"),
        ("&nbsp;", "\u00a0"),
        ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _native_anchors(html: Column) -> Column:
    """Array of (src, pos, title, url) structs."""
    found = F.filter(
        F.regexp_extract_all(html, F.lit(_SCAN), F.lit(0)),
        lambda m: m.startswith("<a") | m.startswith("<A"),
    )

    def one(anchor: Column) -> Column:
        attributes = F.regexp_extract(anchor, _ANCHOR_PARTS, 1)
        text = F.regexp_replace(F.regexp_extract(anchor, _ANCHOR_PARTS, 2), rf"(?s)<(?:{_COMMENT}|[^>]*+>)", "")
        href = F.concat(*[F.regexp_extract(attributes, _HREF, group) for group in (1, 2, 3)])
        return F.struct(
            attributes.rlike(_HREF).alias("has_href"),
            _unescape(text).alias("text"),
            _unescape(href).alias("url"),
        )

    kept = F.filter(F.transform(found, one), lambda a: a["has_href"])
    return F.transform(
        kept,
        lambda a, pos: F.struct(
            F.lit(FROM_ANCHOR).alias("src"),
            pos.cast("int").alias("pos"),
            title_or_href(a["text"], a["url"]).alias("title"),
            a["url"].alias("url"),
        ),
    )


def _native_text_urls(text: Column) -> Column:
    urls = F.regexp_extract_all(text, F.lit(TEXT_URL), F.lit(0))

    def one(raw: Column, pos: Column) -> Column:
        url = F.replace(raw, F.lit("&amp;"), F.lit("&"))
        return F.struct(
            F.lit(FROM_TEXT).alias("src"),
            pos.cast("int").alias("pos"),
            url.alias("title"),
            url.alias("url"),
        )

    return F.transform(urls, one)


# Markup that the patterns might read otherwise than a tokenizer: anchors with
# references beyond the predefined ones or values without quotes (or with `=` in quotes).
_OTHER_REFERENCE = r"(?i)<a[\s/>][^<]*&(?!(?:lt|gt|quot|apos|#39|nbsp|amp);)[#A-Za-z]"
_BARE_VALUE = r"""(?i)<a\s[^<>]*=\s*+[^\s"'>]"""
_ANY_ANCHOR = r"(?i)<a[\s/>]"
_CLOSED_ANCHOR = r"""(?i)<a(?:\s++[^<>]*+)?>[^<]*+</a\s*+>"""


def is_regular(html: Column) -> Column:
    """Pages on which the patterns and the tokenizer agree: every anchor is closed right after its text."""
    return F.coalesce(
        ~html.rlike(_OTHER_REFERENCE)
        & ~html.rlike(_BARE_VALUE)
        & (F.regexp_count(html, F.lit(_ANY_ANCHOR)) == F.regexp_count(html, F.lit(_CLOSED_ANCHOR))),
        F.lit(True),
    )


def _by_markup(pages: DataFrame, html: str) -> tuple[DataFrame, DataFrame]:
    regular = is_regular(F.col(html))
    return pages.where(regular), pages.where(~regular)


def _explode(pages: DataFrame, keys: Sequence[str], links: Column) -> DataFrame:
    return pages.select(*keys, F.inline(links))


def anchor_links(
    pages: DataFrame,
    keys: Sequence[str] = ("page_id",),
    html: str = "html",
    method: str = "parser",
) -> DataFrame:
    """Every ``<a href>`` in page order; a blank text gives the href as title.

    ``method="parser"`` reads the markup with an HTML tokenizer in Arrow batches.
    ``method="native"`` gives the same by patterns in generated code; pages whose markup
    the patterns could read differently go to the tokenizer (see :func:`is_regular`).
    """
    if method == "parser":
        return _scan_links(pages, keys, html, _all_anchors)
    if method == "native":
        regular, other = _by_markup(pages, html)
        return _explode(regular, keys, _native_anchors(F.col(html))).unionByName(
            _scan_links(other, keys, html, _all_anchors)
        )
    raise ValueError(f"unknown method: {method}")


def text_urls(
    pages: DataFrame,
    keys: Sequence[str] = ("page_id",),
    text: str = "html",
    method: str = "parser",
) -> DataFrame:
    """Absolute URLs anywhere in a page, comments and attributes included.

    The parser builds the page's tree, writes it out again with quoted values and
    escaped text, and searches that: an address ends where its text or value does.
    ``method="native"`` searches the source as it stands, which gives the same where
    values are quoted, no quote follows an address in text, and no tag is left over.
    """
    if method == "parser":
        return _scan_links(pages, keys, text, _all_text_urls)
    if method == "native":
        return _explode(pages, keys, _native_text_urls(F.col(text)))
    raise ValueError(f"unknown method: {method}")


def page_links(
    pages: DataFrame,
    keys: Sequence[str] = ("page_id",),
    html: str = "html",
    method: str = "parser",
) -> DataFrame:
    """Anchors, then text URLs; the first link of a URL per page wins.

    ``keys`` must identify a page.  With the parser a page never leaves its task,
    so there is no shuffle at all.  Text URLs are searched in the written-out tree, see
    :func:`text_urls`; they are compared in decoded form, so the address of an ``href``
    is not found a second time.  The native form groups by (page, URL), with the first
    link already picked before the shuffle, searches text URLs in the page source, and
    leaves pages of irregular anchors to the parser.
    """
    if method == "parser":
        return _scan_links(pages, keys, html, _first_links)
    if method != "native":
        raise ValueError(f"unknown method: {method}")
    column = F.col(html)
    regular, other = _by_markup(pages, html)
    links = _explode(regular, keys, F.concat(_native_anchors(column), _native_text_urls(column)))
    first = links.groupBy(*keys, "url").agg(F.min(F.struct("src", "pos", "title")).alias("__first"))
    return first.select(*keys, "__first.src", "__first.pos", "__first.title", "url").unionByName(
        _scan_links(other, keys, html, _first_links)
    )


def scan_pages(
    pages: DataFrame,
    scanner: Scanner,
    keys: Sequence[str] = ("page_id",),
    url: str = "url",
    body: str = "html",
) -> DataFrame:
    """Run a user scanner over each body.

    ``scanner(url, body)`` yields ``(kind, title, url)`` with ``kind`` one of
    ``item``, ``link``, ``follow``.  The result is one tagged table, see
    :func:`split_emissions`.
    """
    schema = T.StructType(
        [pages.schema[key] for key in keys]
        + [
            T.StructField("pos", T.IntegerType()),
            T.StructField("kind", T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("url", T.StringType()),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[tuple[int, str, str, str]] = []
            urls = batch.column(url).to_numpy(zero_copy_only=False)
            bodies = batch.column(body).to_numpy(zero_copy_only=False)
            for row, (address, text) in enumerate(zip(urls, bodies)):
                for pos, (kind, title, target) in enumerate(scanner(address, text or "")):
                    if kind not in EMISSION_KINDS:
                        raise ValueError(f"unknown emission kind: {kind}")
                    rows.append(row)
                    found.append((pos, kind, title, target))
            if not found:
                continue
            index = pa.array(rows, pa.int64())
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(index) for key in keys]
                + [pa.array(columns[0], pa.int32())]
                + [pa.array(values, pa.string()) for values in columns[1:]],
                names=schema.names,
            )

    columns = list(dict.fromkeys([*keys, url, body]))
    return pages.select(*columns).mapInArrow(scan, schema)


def split_emissions(emissions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The item, link and follow rows of a tagged scan.

    A batch scan is written down first, so that the three tables share one pass over the pages.
    """
    if not emissions.isStreaming:
        emissions = stage(emissions, "emissions")
    items, links, follows = (
        emissions.where(F.col("kind") == kind).drop("kind") for kind in EMISSION_KINDS
    )
    return items, links, follows.drop("title")
