"""Feed documents to items."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED_TYPES = ("rss",)

# Prolog, then the local name of the root element.
_ROOT = (
    r"(?s)^\uFEFF?(?:\s++|<\?.*?\?>|<!--.*?-->|<![^>]*+>)*+"
    r"<(?:([A-Za-z_][\w.\-]*+):)?([A-Za-z_][\w.\-]*+)"
)
# Fixed value: the namespace of items in RDF feeds.
_RDF_ITEMS = r"""xmlns:([A-Za-z_][\w.\-]*+)\s*=\s*["']http://purl\.org/rss/1\.0/["']"""

# One schema for all kinds: RSS keeps items inside the channel, RDF beside it.
# The corrupt-record column must come last, or from_xml shifts the other fields.
_DOCUMENT = """
channel struct<item: array<struct<title: string, link: string, pubDate: string>>>,
item array<struct<title: string, link: string, `dc:date`: string>>,
entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>,
                   published: string, updated: string>>,
_corrupt_record string
"""
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def feed_kind(document: Column) -> Column:
    """``rss``, ``rdf`` or ``atom`` by the root element; NULL if it is no feed."""
    root = F.lower(F.regexp_extract(document, _ROOT, 2))
    return (
        F.when(root == "rss", "rss").when(root == "rdf", "rdf").when(root == "feed", "atom")
    )


def _bare(document: Column) -> Column:
    """The document without the prefix of its feed elements, if these have one.

    That is the root's own prefix in RSS and Atom; an RDF root always has one, and there
    it is the prefix bound to the namespace of items.  Other prefixes stay.
    """
    prefix = F.when(feed_kind(document) == "rdf", F.regexp_extract(document, _RDF_ITEMS, 1)).otherwise(
        F.regexp_extract(document, _ROOT, 1)
    )
    tags = F.concat(F.lit("(</?)"), F.regexp_replace(prefix, r"([.\-])", r"\\$1"), F.lit(":"))
    return F.when(F.coalesce(prefix, F.lit("")) == "", document).otherwise(
        F.regexp_replace(document, tags, F.lit("$1"))
    )


def _feed_date(text: Column) -> Column:
    """Mail-style or ISO dates; anything else is NULL."""
    mail = F.regexp_replace(text, r"^\s*[A-Za-z]+,\s*", "")
    return F.coalesce(
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(text),
    )


def feed_items(
    documents: DataFrame,
    as_of: datetime,
    keys: Sequence[str] = (),
    document: str = "document",
    pub_date: str = "as_of",
) -> tuple[DataFrame, DataFrame]:
    """Parse whole feed documents.

    Returns ``(items, failures)``: items carry ``keys``, ``pos``, ``title``,
    ``url``, ``pub_date``; failures carry ``keys`` and ``reason``.  A document
    that cannot be parsed as a whole gives no items.  The publication date is the
    ingest time, or the feed's own date with ``pub_date="feed"`` (then the ingest
    time where the feed gives none).
    """
    if pub_date not in ("as_of", "feed"):
        raise ValueError(f"unknown pub_date: {pub_date}")
    now = F.lit(as_of)

    def item(title: Column, url: Column, date: Column) -> Column:
        when = F.coalesce(_feed_date(date), now) if pub_date == "feed" else now
        return F.struct(
            F.coalesce(title, F.lit("")).alias("title"),
            F.coalesce(url, F.lit("")).alias("url"),
            when.alias("pub_date"),
        )

    def atom_url(links: Column) -> Column:
        alternate = F.filter(
            links, lambda link: F.coalesce(link["_rel"], F.lit("alternate")) == "alternate"
        )
        return F.get(alternate, 0)["_href"]

    # An XML declaration must be the first thing in a document.
    text = F.regexp_replace(_bare(F.col(document)), r"^[\s\uFEFF]+", "")
    # Behind a generator, so that a filter on the result does not parse a second time.
    parsed = documents.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    feed_kind(F.col(document)).alias("__kind"),
                    F.from_xml(text, _DOCUMENT, _OPTIONS).alias("__feed"),
                )
            )
        ).alias("__parsed"),
    ).select(*keys, "__parsed.*")
    corrupt = F.coalesce(F.col("__feed._corrupt_record"), F.lit(""))
    reason = F.when(corrupt != "", "malformed document").when(F.col("__kind").isNull(), "not a feed")
    entries = (
        F.when(
            F.col("__kind") == "atom",
            F.transform(
                "__feed.entry",
                lambda e: item(
                    e["title"], atom_url(e["link"]), F.coalesce(e["published"], e["updated"])
                ),
            ),
        )
        .when(
            F.col("__kind") == "rdf",
            F.transform("__feed.item", lambda i: item(i["title"], i["link"], i["dc:date"])),
        )
        .otherwise(
            F.transform("__feed.channel.item", lambda i: item(i["title"], i["link"], i["pubDate"]))
        )
    )
    failures = parsed.select(*keys, reason.alias("reason")).where("reason is not null")
    items = (
        parsed.where(reason.isNull())
        .select(*keys, F.posexplode(entries).alias("pos", "__item"))
        .select(*keys, "pos", "__item.*")
    )
    return items, failures


def read_feed_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Feed documents from files: one row per file, ``(feed, document)``."""
    return (
        spark.read.text(paths, wholetext=True)
        .select(F.input_file_name().alias("feed"), F.col("value").alias("document"))
    )


def union_feeds(feeds: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All feeds as one table.  Each feed is ``(type, documents)``."""
    for kind, _ in feeds:
        if kind not in FEED_TYPES:
            raise ValueError(f"unknown feed type: {kind}")
    if not feeds:
        raise ValueError("no feeds given")
    return reduce(DataFrame.unionByName, [documents for _, documents in feeds])
