"""What to fetch next: feeds by their interval, pages by back-off."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.schedule import (
    Cleanups,
    attempt_state,
    due_fetches,
    fibonacci,
    interval_or_default,
    periodic,
    with_attempts,
)
from linkloom.operators.stores import resume_items
from linkloom.plans.spec import PipelineSpec, feed_table


def due_feeds(
    spark: SparkSession, spec: PipelineSpec, attempts: DataFrame, as_of: datetime
) -> DataFrame:
    """Feeds of the spec whose interval has passed since the last attempt."""
    state = with_attempts(feed_table(spark, spec), attempt_state(attempts))
    schedule = periodic(interval_or_default(F.col("fetch_interval"), spec.fetch_interval))
    return due_fetches(state, schedule, as_of)


def due_pages(
    spec: PipelineSpec,
    item_store: DataFrame,
    new_items: DataFrame,
    attempts: DataFrame,
    as_of: datetime,
    scanned: DataFrame | None = None,
) -> DataFrame:
    """Pages of stored and new items that are to be tried now, or tried again.

    Attempts are counted since the last cleanup that forgot the URL.  Pages in
    ``scanned`` have been read and are not tried again.
    """
    urls = resume_items(item_store, new_items, spec.cleanup_max_age, as_of)
    if scanned is not None:
        urls = urls.join(scanned.select("url"), "url", "left_anti")
    cleanups = Cleanups(spec.cleanup_interval, spec.cleanup_max_age)
    state = with_attempts(urls, attempt_state(attempts, cleanups, as_of))
    return due_fetches(state, fibonacci(spec.fetch_interval, spec.max_attempts), as_of)
