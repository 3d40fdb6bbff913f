"""Deterministic first-row-per-key, and acceptance with expiry."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``.

    This is an aggregate, not a window: each task keeps one row per key before
    the shuffle, so a key that holds a third of all rows costs no more than others.
    """
    rest = [column for column in rows.columns if column not in keys and column not in order]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return first.select(
        *[c if c in keys else F.col("__first")[c].alias(c) for c in rows.columns]
    )


def _interval_index(micros: Column, step: int) -> Column:
    """Number of whole steps in ``micros``, in exact integer arithmetic."""
    whole = micros - F.pmod(micros, F.lit(step))
    return F.greatest(F.call_function("div", whole, F.lit(step)), F.lit(0).cast("bigint"))


def first_seen_ttl(
    rows: DataFrame,
    max_age: timedelta,
    cleanup_interval: timedelta,
    start: datetime,
    ts: str = "ts",
    order: Sequence[str] = (),
) -> DataFrame:
    """Rows accepted by an insert-if-absent store that is cleaned periodically.

    A cleanup runs at ``start + k * cleanup_interval`` for k = 1, 2, ... and
    removes a URL accepted before ``cleanup - max_age``.  A URL is accepted if the
    store does not hold it; being seen again does not refresh it.

    Within one interval between cleanups only a URL's first row can be accepted,
    so rows are reduced to one per URL and interval before they are shuffled.  What
    remains to be folded per URL is bounded by the number of intervals.
    """
    step = int(cleanup_interval / timedelta(microseconds=1))
    age = int(max_age / timedelta(microseconds=1))
    if step <= 0 or age < 0:
        raise ValueError("cleanup_interval must be positive and max_age not negative")
    origin = F.unix_micros(F.lit(start))

    columns = rows.columns
    first = [ts, *order] + [c for c in columns if c not in ("url", ts, *order)]
    per_interval = (
        rows.withColumn("__tick", _interval_index(F.unix_micros(F.col(ts)) - origin, step))
        .groupBy("url", "__tick")
        .agg(F.min(F.struct(*first)).alias("__row"))
    )
    # An acceptance at ``a`` ends with the first cleanup later than ``a + max_age``.
    ends = _interval_index(F.unix_micros(F.col(f"__row.{ts}")) + F.lit(age) - origin, step) + 1
    candidates = per_interval.groupBy("url").agg(
        F.array_sort(
            F.collect_list(F.struct("__tick", ends.alias("__ends"), F.col("__row").alias("row")))
        ).alias("seen")
    )
    # Walk the intervals: accept, then skip up to the end of that acceptance.
    empty = F.filter("seen", lambda _: F.lit(False))
    accepted = F.aggregate(
        "seen",
        F.struct(F.lit(0).cast("bigint").alias("free_from"), empty.alias("rows")),
        lambda state, x: F.when(
            x["__tick"] >= state["free_from"],
            F.struct(
                x["__ends"].alias("free_from"),
                F.concat(state["rows"], F.array(x)).alias("rows"),
            ),
        ).otherwise(state),
        lambda state: F.transform(state["rows"], lambda x: x["row"]),
    )
    return candidates.select("url", F.inline(accepted)).select(*columns)
