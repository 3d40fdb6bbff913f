"""Insert-if-absent item and link tables, age-based reads, retention.

A store is a table of rows with a unique ``url`` and the time it was ``added``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.first_wins import first_per_key

CLEANUP_MAX_AGE = timedelta(hours=24)
CLEANUP_INTERVAL = timedelta(hours=1)
OUTPUT_MAX_AGE = timedelta(hours=6)


def new_rows(batch: DataFrame, store: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows an insert-if-absent of ``batch`` would add: first per URL, not stored yet."""
    first = first_per_key(batch, ["url"], order)
    return first.join(store.select("url"), "url", "left_anti").select(*batch.columns)


def insert_absent(
    batch: DataFrame, store: DataFrame, order: Sequence[str], as_of: datetime
) -> DataFrame:
    """The store after inserting ``batch``.  Stored rows never change."""
    added = new_rows(batch, store, order).withColumn("added", F.lit(as_of))
    return store.unionByName(added.select(*store.columns))


def flag_existing(batch: DataFrame, store: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each row of ``batch`` with ``existed``: was its URL stored when its turn came?

    ``order`` must identify a row.  The join back is on URL *and* order, so rows of
    one frequent URL still spread over all tasks.
    """
    inserted = new_rows(batch.select("url", *order), store, order).withColumn(
        "__inserted", F.lit(True)
    )
    return (
        batch.join(inserted, ["url", *order], "left")
        .withColumn("existed", F.col("__inserted").isNull())
        .select(*batch.columns, "existed")
    )


def recent(store: DataFrame, max_age: timedelta, as_of: datetime) -> DataFrame:
    """Rows added less than ``max_age`` ago; a plain range predicate that reaches the scan."""
    return store.where(F.col("added") > F.lit(as_of - max_age))


def recent_by_key(store: DataFrame, max_age: timedelta, as_of: datetime) -> DataFrame:
    """:func:`recent` in key order, for final output."""
    return recent(store, max_age, as_of).orderBy("url")


def retain(table: DataFrame, max_age: timedelta, as_of: datetime, ts: str = "added") -> DataFrame:
    """What a cleanup leaves: everything not older than the cutoff."""
    return table.where(~(F.col(ts) < F.lit(as_of - max_age)))


def resume_items(
    store: DataFrame, fresh: DataFrame, max_age: timedelta, as_of: datetime
) -> DataFrame:
    """URLs to fetch after a restart: stored items still in age, and new items."""
    return recent(store, max_age, as_of).select("url").union(fresh.select("url")).distinct()
