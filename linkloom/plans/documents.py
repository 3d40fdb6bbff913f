"""Feed documents and page payloads to links, failures and the output feed, in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.link_filters import Step
from linkloom.operators.stores import CLEANUP_MAX_AGE, OUTPUT_MAX_AGE, resume_items
from linkloom.plans.collect import collect_links
from linkloom.sinks.feed import output_feed
from linkloom.sources.feeds import feed_items
from linkloom.sources.fetched import decode_bodies, fetch_failures
from linkloom.workspace import stage


@dataclass(frozen=True)
class DocumentRun:
    """What one run adds to the stores, and why wanted URLs gave nothing."""

    items: DataFrame
    links: DataFrame
    scanned: DataFrame
    failures: DataFrame

    def feed(self, link_store: DataFrame, as_of: datetime, max_age: timedelta = OUTPUT_MAX_AGE) -> DataFrame:
        """The output feed once this run's links are stored."""
        links = link_store.select("title", "url", "added").unionByName(self.links)
        return output_feed(links, as_of, max_age)


def collect_documents(
    feeds: DataFrame,
    fetched_feeds: DataFrame,
    fetched_pages: DataFrame,
    item_store: DataFrame,
    link_store: DataFrame,
    item_steps: Sequence[Step],
    link_steps: Sequence[Step],
    as_of: datetime,
    scanned: DataFrame | None = None,
    max_age: timedelta = CLEANUP_MAX_AGE,
    pub_date: str = "as_of",
    report_missing_pages: bool = True,
) -> DocumentRun:
    """One run over what was fetched.

    ``feeds`` lists the wanted feed URLs, column ``url``.  ``fetched_feeds`` and ``fetched_pages``
    are fetch results ``(url, status, content_type, body)``.  Feed payloads are decoded and parsed
    once, into a table; items go through their chain into the item store, their pages are decoded
    and scanned, and links go through theirs.  Items of a feed keep their order, feeds go by URL.

    ``failures`` has ``url, stage, reason`` for feeds that were not fetched, were refused or
    are malformed, and for pages of new or open items that were not fetched or refused.  One
    of them never stops the others.
    """
    documents = stage(decode_bodies(fetched_feeds, keys=["url"], text="document"), "documents")
    named = documents.select(F.col("url").alias("feed"), "document")
    items, unparsable = feed_items(named, as_of, keys=["feed"], pub_date=pub_date)
    items = stage(items, "items")
    pages = decode_bodies(fetched_pages, keys=["url"], text="html").withColumn("page_id", F.col("url"))
    collected = collect_links(
        items, pages, item_store, link_store, item_steps, link_steps, as_of,
        ("feed", "pos"), scanned=scanned, max_age=max_age,
    )
    accepted = stage(collected.items, "accepted")
    wanted = accepted.select("url")
    if scanned is not None:
        wanted = resume_items(item_store, wanted, max_age, as_of).join(scanned.select("url"), "url", "left_anti")
    failures = fetch_failures(feeds, fetched_feeds, unparsable.select(F.col("feed").alias("url"), "reason"))
    page_failures = fetch_failures(wanted, fetched_pages.select("url", "status"))
    if not report_missing_pages:
        page_failures = page_failures.where("reason <> 'not fetched'")
    return DocumentRun(accepted, collected.links, collected.scanned, failures.unionByName(page_failures))
