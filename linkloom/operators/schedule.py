"""When to fetch a URL again, from the log of attempts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.backoff import fibonacci_multiplier

FETCH_INTERVAL = timedelta(minutes=65)
MAX_ATTEMPTS = 7

# (last attempt or NULL, attempts) -> (go on?, due time or NULL for "at once")
Schedule = Callable[[Column, Column], tuple[Column, Column]]


EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Cleanups:
    """Cleanups at ``origin + k * interval``: each forgets URLs last tried over ``max_age`` before it."""

    interval: timedelta
    max_age: timedelta
    origin: datetime = EPOCH

    def forgets(self, last: Column) -> Column:
        """When a URL last tried at ``last`` is forgotten: the first cleanup after its age is up."""
        step = self.interval // timedelta(microseconds=1)
        start = (self.origin - EPOCH) // timedelta(microseconds=1)
        age = self.max_age // timedelta(microseconds=1)
        turns = F.floor((F.unix_micros(last) + F.lit(age - start)) / step) + 1
        return F.timestamp_micros((turns * step + start).cast("long"))


def attempt_state(
    log: DataFrame,
    cleanups: Cleanups | None = None,
    as_of: datetime | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """Per URL the number of attempts and the time of the last one.

    With ``cleanups`` the count of a URL starts again after each that forgets it, and a
    URL that is forgotten by ``as_of`` is left out.  ``state`` is what this gave for the
    log before; ``log`` then has the rows since.
    """
    if cleanups is None and state is None:
        return log.groupBy("url").agg(F.count("*").alias("attempts"), F.max("ts").alias("last"))
    # Attempts at one time are one row from here on, counted before the shuffle.
    steps = log.groupBy("url", "ts").agg(F.count("*").alias("n"))
    if state is not None:
        steps = steps.unionByName(state.select("url", F.col("last").alias("ts"), F.col("attempts").alias("n")))
    if cleanups is None:
        return steps.groupBy("url").agg(F.sum("n").alias("attempts"), F.max("ts").alias("last"))
    order = W.partitionBy("url").orderBy("ts")
    before = F.lag("ts").over(order)
    spells = steps.withColumn(
        "__new", F.coalesce((cleanups.forgets(before) <= F.col("ts")).cast("int"), F.lit(0))
    ).withColumn("__spell", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    counts = spells.groupBy("url", "__spell").agg(F.sum("n").alias("attempts"), F.max("ts").alias("last"))
    latest = counts.groupBy("url").agg(F.max_by(F.struct("attempts", "last"), "__spell").alias("s")).select("url", "s.*")
    return latest if as_of is None else latest.where(cleanups.forgets(F.col("last")) > F.lit(as_of))


def with_attempts(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Candidates with their state; a URL never tried counts as (never, 0)."""
    return candidates.join(state.select("url", "attempts", "last"), "url", "left").withColumn(
        "attempts", F.coalesce("attempts", F.lit(0).cast("bigint"))
    )


def periodic(interval: timedelta | Column = FETCH_INTERVAL) -> Schedule:
    """Always go on; due one interval after the last attempt.

    ``interval`` may be a column, for feeds with an interval of their own.
    """
    step = interval if isinstance(interval, Column) else F.lit(interval)
    return lambda last, attempts: (F.lit(True), last + step)


def interval_or_default(interval: Column, default: timedelta = FETCH_INTERVAL) -> Column:
    """A feed's own interval; missing or zero means the default."""
    return F.coalesce(F.nullif(interval, F.lit(timedelta(0))), F.lit(default))


def fibonacci(
    interval: timedelta = FETCH_INTERVAL, max_attempts: int = MAX_ATTEMPTS
) -> Schedule:
    """Stop after ``max_attempts``; until then wait fib(attempts) intervals."""

    def next_attempt(last: Column, attempts: Column) -> tuple[Column, Column]:
        wait = F.lit(interval) * fibonacci_multiplier(attempts, max_attempts)
        return attempts < max_attempts, last + wait

    return next_attempt


def plan(state: DataFrame, schedule: Schedule, as_of: datetime) -> DataFrame:
    """Add ``should_continue`` and ``due``; never tried means due at ``as_of``."""
    should_continue, due = schedule(F.col("last"), F.col("attempts"))
    return state.withColumn("should_continue", should_continue).withColumn(
        "due", F.when(F.col("should_continue"), F.coalesce(due, F.lit(as_of)))
    )


def due_fetches(state: DataFrame, schedule: Schedule, as_of: datetime) -> DataFrame:
    """URLs to fetch now."""
    return plan(state, schedule, as_of).where(
        F.col("should_continue") & (F.col("due") <= F.lit(as_of))
    )
