"""Recent links as an RSS feed."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import rfc1123
from linkloom.operators.stores import OUTPUT_MAX_AGE, recent_by_key

# Channel head of the output feed.
CHANNEL_LINK = "http://example.com"


def output_feed(
    links: DataFrame, as_of: datetime, max_age: timedelta = OUTPUT_MAX_AGE
) -> DataFrame:
    """Links young enough for the feed, as items dated ``as_of``, in URL order."""
    return recent_by_key(links, max_age, as_of).select(
        "title", "url", F.lit(as_of).alias("pub_date")
    )


def _xml_text(text: Column) -> Column:
    """Escaped for element content; characters XML 1.0 forbids are left out."""
    clean = F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[^\t\n\r\x20-퟿-�\x{10000}-\x{10FFFF}]", ""
    )
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        clean = F.replace(clean, F.lit(char), F.lit(entity))
    return clean


def feed_item_xml() -> Column:
    """One ``<item>`` from ``title``, ``url``, ``pub_date``; a pure projection."""
    parts = []
    for tag, value in (
        ("title", _xml_text(F.col("title"))),
        ("guid", _xml_text(F.col("url"))),
        ("link", _xml_text(F.col("url"))),
        ("description", _xml_text(F.col("title"))),
        ("pubDate", rfc1123(F.col("pub_date"))),
    ):
        parts += [F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>")]
    return F.concat(F.lit("<item>"), *parts, F.lit("</item>"))


def _head(title: str, description: str, as_of: datetime) -> Column:
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'),
        F.lit("<title>"), _xml_text(F.lit(title)), F.lit("</title>"),
        F.lit("<description>"), _xml_text(F.lit(description)), F.lit("</description>"),
        F.lit(f"<link>{CHANNEL_LINK}</link><pubDate>"), rfc1123(F.lit(as_of)),
        F.lit("</pubDate>"),
    )


_TAIL = "</channel></rss>"


def feed_frame(spark: SparkSession, title: str, description: str, as_of: datetime) -> tuple[str, str]:
    """What stands before and behind the items of a feed document."""
    return spark.range(1).select(_head(title, description, as_of)).first()[0], _TAIL


def write_feed(
    items: DataFrame,
    path: str,
    as_of: datetime,
    title: str = "links",
    description: str = "recent links",
) -> None:
    """Write the feed as text, one ``<item>`` per line, in URL order.

    The part files in name order, one after the other, are the document: the head
    sorts before and the tail after all items.  No task holds more than its part.
    """
    spark = items.sparkSession
    edge = spark.range(1).select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("place"), _head(title, description, as_of).alias("value")),
                F.struct(F.lit(2).alias("place"), F.lit(_TAIL).alias("value")),
            )
        ).alias("edge")
    ).select("edge.place", F.lit("").alias("url"), "edge.value")
    body = items.select(F.lit(1).alias("place"), "url", feed_item_xml().alias("value"))
    (
        edge.unionByName(body)
        .orderBy("place", "url")
        .select("value")
        .write.mode("overwrite")
        .option("lineSep", "\n")
        .text(path)
    )
