"""Endless operators whose state moves by the clock: exact expiry, and schedules that emit.

Both follow event time.  The watermark is the clock: it moves with the rows of the stream, and
rows without a URL move it too, so a source of ticks keeps it going when nothing else comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from linkloom.operators.schedule import FETCH_INTERVAL, MAX_ATTEMPTS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_MICRO = timedelta(microseconds=1)


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Start queries with timers inside: their state store is chosen when they start."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _micros(moment: datetime) -> int:
    """Microseconds since 1970; a moment without a zone is UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return (moment - _EPOCH) // _MICRO


def _ceil(micros: int) -> int:
    return -(-micros // 1000)


class _FirstSeen(StatefulProcessor):
    """One URL: rows that wait for the watermark, and from which cleanup on it is unknown again."""

    def __init__(self, row: T.StructType, age: int, step: int, origin: int) -> None:
        self.row, self.age, self.step, self.origin = row, age, step, origin
        self.names = row.fieldNames()[1:]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", "tick long")
        self.waiting = handle.getListState("waiting", self.row)

    def _tick(self, micros: int) -> int:
        return max(0, (micros - self.origin) // self.step)

    def _advance(self, waiting: list[tuple], watermark: int) -> Iterator[Row]:
        """Decide the rows up to the watermark, in order; set the next timer."""
        known = self.free.get() if self.free.exists() else None
        free_from = known[0] if known is not None else None
        later = [row for row in waiting if row[0] > watermark * 1000]
        accepted = []
        for row in sorted(row for row in waiting if row[0] <= watermark * 1000):
            if free_from is None or self._tick(row[0]) >= free_from:
                free_from = self._tick(row[0] + self.age) + 1
                accepted.append(row)
        if len(later) < len(waiting) or later:
            self.waiting.put(later) if later else self.waiting.clear()
        if free_from is not None:
            forgotten = self.origin + free_from * self.step
            if forgotten <= watermark * 1000 and not later:
                self.free.clear()
            else:
                if known is None or known[0] != free_from:
                    self.free.update((free_from,))
                if not later:
                    self.handle.registerTimer(_ceil(forgotten))
        if later:
            self.handle.registerTimer(_ceil(min(row[0] for row in later)))
        for row in accepted:
            yield Row(**dict(zip(self.names, row[1:])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        waiting += [tuple(row) for row in rows]
        yield from self._advance(waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._advance(waiting, timerValues.getCurrentWatermarkInMs())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Go on from what a stopped query remembered, see :func:`remembered`."""
        if initialState["tick"] is not None:
            self.free.update((initialState["tick"],))
        later = [tuple(row[name] for name in self.row.fieldNames()) for row in initialState["waiting"] or ()]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(_ceil(min(row[0] for row in later)))
        elif initialState["tick"] is not None:
            self.handle.registerTimer(_ceil(self.origin + initialState["tick"] * self.step))


def _ordered(rows: DataFrame, ts: str, order: Sequence[str]) -> DataFrame:
    """Row time in microseconds and the order columns first, so that tuples sort as the rows do."""
    first = list(dict.fromkeys(order))
    rest = [c for c in rows.columns if c not in first]
    return rows.select(F.unix_micros(F.col(ts)).alias("__micros"), *first, *rest)


def stream_first_seen_exact(
    rows: DataFrame,
    max_age: timedelta,
    cleanup_interval: timedelta,
    start: datetime,
    ts: str = "ts",
    order: Sequence[str] = (),
    delay: str = "0 seconds",
    remembered: DataFrame | None = None,
) -> DataFrame:
    """:func:`~linkloom.operators.first_wins.first_seen_ttl` on a stream, to the same instant.

    A row is decided when the watermark has passed its time, after all earlier rows of its URL, so
    rows may come up to ``delay`` out of order.  A timer forgets the URL at the cleanup that
    removes it: state is one number per remembered URL, and the rows of the last ``delay``.
    Rows without a URL only move the clock.

    ``remembered`` is what a stopped query knew, see :func:`remembered_urls`.  Start the
    query inside :func:`timed_state`.
    """
    columns = rows.columns
    # Rows without a URL are left out by the processor: a filter would be moved in front of the
    # watermark, which then would not see them.
    staged = _ordered(rows.withWatermark(ts, delay), ts, order)
    processor = _FirstSeen(
        staged.schema, max_age // _MICRO, cleanup_interval // _MICRO, _micros(start)
    )
    out = T.StructType(staged.schema.fields[1:])
    initial = None if remembered is None else remembered.groupBy("url")
    return (
        staged.groupBy("url")
        .transformWithState(processor, out, "append", "eventTime", initialState=initial)
        .select(*columns)
    )


def remembered_urls(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``url, tick, waiting``: what a stopped query of :func:`stream_first_seen_exact` remembers.

    Read from its state store.  ``tick`` is the cleanup that forgets the URL; ``waiting`` are
    rows the watermark has not passed.  A query with other parameters than the grouping, such as
    another ``delay``, can go on from it.
    """
    read = spark.read.format("statestore")
    free = (
        read.option("stateVarName", "free")
        .load(checkpoint)
        .select(F.col("key.url").alias("url"), F.col("value.tick").alias("tick"))
    )
    waiting = (
        spark.read.format("statestore")
        .option("stateVarName", "waiting")
        .option("flattenCollectionTypes", "false")
        .load(checkpoint)
        .select(F.col("key.url").alias("url"), F.col("list_value").alias("waiting"))
    )
    return free.join(waiting, "url", "full").select("url", "tick", "waiting")


def fibonacci_waits(
    interval: timedelta = FETCH_INTERVAL, max_attempts: int = MAX_ATTEMPTS
) -> Callable[[int], timedelta | None]:
    """The wait after a number of attempts; none once there are ``max_attempts``."""
    numbers = [0, 1]
    while len(numbers) <= max_attempts:
        numbers.append(numbers[-1] + numbers[-2])

    def wait(attempts: int) -> timedelta | None:
        return None if attempts >= max_attempts else numbers[attempts] * interval

    return wait


def periodic_waits(interval: timedelta = FETCH_INTERVAL) -> Callable[[int], timedelta | None]:
    """The same wait after each attempt, without end."""
    return lambda attempts: interval


#: Groups of URLs by hash that share one state and its timers, and what a row of the schedule holds at most.
_GROUPS = 4_096
_ROW = 10_000


class _Due(StatefulProcessor):
    """A group of URLs: how often each was due, and when it is next; null once there is no next time.

    A call to the state or to a timer costs far more than the work on one URL, so a group reads
    its URLs at once, writes them at once and has one timer, for the earliest of them.
    """

    def __init__(self, wait: Callable[[int], timedelta | None], tick: int, origin: int) -> None:
        self.wait, self.tick, self.origin = wait, tick, origin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("plan", "urls array<string>, attempts array<long>, next array<long>")

    def _tick_at(self, micros: int) -> int:
        """The first tick that is not before a moment."""
        return self.origin + -(-(micros - self.origin) // self.tick) * self.tick

    def _plan(self) -> list[list]:
        plan = self.state.get()
        return [[], [], []] if plan is None else [list(column) for column in plan]

    def _run(self, urls: list[str], attempts: list[int], following: list[int | None], watermark: int) -> Iterator[Row]:
        """Emit at every tick up to the watermark at which a URL is due."""
        now = watermark * 1000
        out: list[list] = [[], [], []]
        for i, due in enumerate(following):
            if due is None or due > now:
                continue
            n = attempts[i]
            while due is not None and due <= now:
                n += 1
                for column, value in zip(out, (urls[i], due, n)):
                    column.append(value)
                if len(out[0]) >= _ROW:
                    yield Row(url=out[0], tick=out[1], attempt=out[2])
                    out = [[], [], []]
                wait = self.wait(n)
                due = None if wait is None else self._tick_at(due + max(wait // _MICRO, 1))
            attempts[i], following[i] = n, due
        if out[0]:
            yield Row(url=out[0], tick=out[1], attempt=out[2])
        self.state.update((urls, attempts, following))
        if (first := min((due for due in following if due is not None), default=None)) is not None:
            self.handle.registerTimer(_ceil(first))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first: dict[str, int] = {}
        for row in rows:
            url, micros = row["url"], row["__micros"]
            if url is not None and micros < first.get(url, micros + 1):
                first[url] = micros
        if not first or self.wait(0) is None:
            return
        urls, attempts, following = self._plan()
        fresh = list(first.keys() - set(urls))
        if not fresh:
            return
        urls += fresh
        attempts += [0] * len(fresh)
        following += [self._tick_at(first[url]) for url in fresh]
        yield from self._run(urls, attempts, following, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        plan, watermark = self._plan(), timerValues.getCurrentWatermarkInMs()
        # A timer may be left from before an earlier one was set.
        if any(due is not None and due <= watermark * 1000 for due in plan[2]):
            yield from self._run(*plan, watermark)


def stream_due_urls(
    urls: DataFrame,
    wait: Callable[[int], timedelta | None],
    tick: timedelta,
    origin: datetime,
    ts: str = "ts",
    delay: str = "0 seconds",
    groups: int = _GROUPS,
) -> DataFrame:
    """``url, tick, attempt``: the endless schedule, each URL at every tick at which it is due.

    A URL is due at the first tick after it is known.  Being due counts as an attempt, after
    which it waits ``wait(attempts)``, until that gives none.  Ticks are ``origin + k * tick``; a
    timer wakes the URL at its next one.  What comes out equals asking
    :func:`~linkloom.operators.schedule.due_fetches` at every tick and logging its answer as
    attempts.  State is the URL and two numbers per URL, kept by ``groups`` hashes of URLs: a group
    is read and written whole when one of its URLs is due or new.  Rows without a URL only move
    the clock.
    """
    known = urls.withWatermark(ts, delay)
    processor = _Due(wait, tick // _MICRO, _micros(origin))
    return (
        known.select(
            F.pmod(F.xxhash64("url"), F.lit(groups)).alias("__group"), "url", F.unix_micros(F.col(ts)).alias("__micros")
        )
        .groupBy("__group")
        .transformWithState(
            processor, "url array<string>, tick array<long>, attempt array<long>", "append", "eventTime"
        )
        .select(F.inline(F.arrays_zip("url", "tick", "attempt")))
        .select("url", F.timestamp_micros("tick").alias("tick"), "attempt")
    )
