"""Where rows come from: feeds, fetched payloads, page scans."""

from linkloom.sources.feeds import feed_items, feed_kind, read_feed_files, union_feeds
from linkloom.sources.fetched import (
    decode_bodies,
    fetch_failures,
    follow_frontier,
    items_to_pages,
    read_fetch_results,
)
from linkloom.sources.pages import (
    anchor_links,
    page_links,
    scan_pages,
    split_emissions,
    text_urls,
)
from linkloom.sources.resources import register_source, row_group_pages, row_groups
from linkloom.sources.scanner_function import register_scanner

__all__ = [
    "anchor_links",
    "decode_bodies",
    "feed_items",
    "feed_kind",
    "fetch_failures",
    "follow_frontier",
    "items_to_pages",
    "page_links",
    "read_feed_files",
    "read_fetch_results",
    "register_scanner",
    "register_source",
    "row_group_pages",
    "row_groups",
    "scan_pages",
    "split_emissions",
    "text_urls",
    "union_feeds",
]
