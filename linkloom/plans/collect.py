"""Feeds to stored links in one batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.link_filters import Step, apply_chain
from linkloom.operators.stores import CLEANUP_MAX_AGE, new_rows, resume_items
from linkloom.sources.fetched import items_to_pages
from linkloom.sources.pages import page_links


@dataclass(frozen=True)
class Collected:
    """What one batch adds to the stores."""

    items: DataFrame
    links: DataFrame
    scanned: DataFrame


def collect_links(
    items: DataFrame,
    pages: DataFrame,
    item_store: DataFrame,
    link_store: DataFrame,
    item_steps: Sequence[Step],
    link_steps: Sequence[Step],
    as_of: datetime,
    item_order: Sequence[str] = ("page_id",),
    method: str = "parser",
    scanned: DataFrame | None = None,
    max_age: timedelta = CLEANUP_MAX_AGE,
) -> Collected:
    """Filter items, keep new ones, scan pages, filter links, keep new ones.

    A page may come later than its item.  So pages are scanned for new items and for
    stored ones younger than ``max_age``, less those whose URL is in ``scanned``; the
    result's ``scanned`` are the URLs whose page was here.  Without a ``scanned`` table
    every stored item counts as scanned.

    ``pages`` has ``page_id``, ``url``, ``html``.  Links are ordered by
    ``(page_id, src, pos)``; the first one of a URL wins.  Item columns are pruned
    to the URL before the join, so the wide page rows meet a narrow side.
    """
    accepted = new_rows(apply_chain(items, item_steps), item_store, item_order)
    open_urls = accepted.select("url")
    if scanned is not None:
        open_urls = resume_items(item_store, open_urls, max_age, as_of).join(
            scanned.select("url"), "url", "left_anti"
        )
    wanted = items_to_pages(open_urls, pages)
    links = page_links(wanted.select("page_id", "html"), method=method)
    kept = apply_chain(links, link_steps)
    fresh = new_rows(kept, link_store, ("page_id", "src", "pos"))
    added = F.lit(as_of).alias("added")
    return Collected(
        items=accepted.select("title", "url", "pub_date", added),
        links=fresh.select("title", "url", added),
        scanned=wanted.select("url").distinct().select("url", added),
    )
