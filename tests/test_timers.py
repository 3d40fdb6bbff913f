"""Streams whose state moves by the clock, against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom.operators.first_wins import first_seen_ttl
from linkloom.operators.schedule import attempt_state, due_fetches, fibonacci, with_attempts
from linkloom.streaming import (
    fibonacci_waits,
    periodic_waits,
    remembered_urls,
    stream_due_urls,
    stream_first_seen_exact,
    timed_state,
)
from linkloom.workspace import scratch_path

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)
SCHEMA = "ord long, ts timestamp, url string, title string"


def files(spark, schema, *batches):
    """A stream of one file for each list of rows."""
    path = scratch_path(spark, "batches")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/at={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(spark, stream, checkpoint=None):
    path = scratch_path(spark, "out")
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def visits(n, seed):
    rng = random.Random(seed)
    moments = sorted(START + rng.random() * 200 * HOUR for _ in range(n))
    return [(i, ts.replace(microsecond=ts.microsecond), f"u{rng.randrange(12)}", f"t{i}") for i, ts in enumerate(moments)]


# The clock of a batch is what the batches before it have seen: the second tick makes the first count.
TICKS = [[(10**9, START + 5000 * HOUR, None, None)]] * 2


@pytest.mark.parametrize("age", [0, 30])
def test_first_seen_exact_equals_the_batch_operator(spark, age):
    rows = visits(250, age)
    settings = (age * HOUR, 5 * HOUR, START)
    want = first_seen_ttl(spark.createDataFrame(rows, SCHEMA), *settings, order=["ord"])
    cuts = [rows[i : i + 50] for i in range(0, 250, 50)] + TICKS
    with timed_state(spark):
        got = run(spark, stream_first_seen_exact(files(spark, SCHEMA, *cuts), *settings, order=["ord"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.columns == ["ord", "ts", "url", "title"]


def test_first_seen_exact_waits_for_rows_out_of_order(spark):
    rows = visits(120, 3)
    rng = random.Random(1)
    late = sorted(rows, key=lambda r: r[1] + rng.random() * 20 * HOUR)
    settings = (6 * HOUR, HOUR, START)
    want = first_seen_ttl(spark.createDataFrame(rows, SCHEMA), *settings, order=["ord"])
    cuts = [late[i : i + 40] for i in range(0, 120, 40)] + TICKS
    with timed_state(spark):
        stream = stream_first_seen_exact(files(spark, SCHEMA, *cuts), *settings, order=["ord"], delay="40 hours")
        got = run(spark, stream)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_stopped_query_is_continued_by_another(spark):
    rows = visits(200, 5)
    settings = (20 * HOUR, HOUR, START)
    want = first_seen_ttl(spark.createDataFrame(rows, SCHEMA), *settings, order=["ord"])
    with timed_state(spark):
        checkpoint = scratch_path(spark, "stopped")
        first = files(spark, SCHEMA, rows[:60], rows[60:100])
        before = run(spark, stream_first_seen_exact(first, *settings, order=["ord"], delay="3 hours"), checkpoint)
        known = remembered_urls(spark, checkpoint)
        assert set(known.columns) == {"url", "tick", "waiting"}
        rest = files(spark, SCHEMA, rows[100:150], rows[150:], *TICKS)
        # The other query has another delay.
        stream = stream_first_seen_exact(rest, *settings, order=["ord"], delay="1 hour", remembered=known)
        after = run(spark, stream)
    got = [*before.collect(), *after.collect()]
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def asked_at_every_tick(spark, urls, schedule, ticks):
    """The due set at each tick, whose answer is logged as attempts."""
    log, out = [], []
    for tick in ticks:
        known = spark.createDataFrame([(u,) for u, ts in urls if ts <= tick], "url string")
        attempts = spark.createDataFrame(log, "url string, ts timestamp")
        due = due_fetches(with_attempts(known, attempt_state(attempts)), schedule, tick)
        for r in due.collect():
            log.append((r.url, tick))
            out.append((r.url, tick, r.attempts + 1))
    return sorted(out)


def test_due_urls_equal_asking_at_every_tick(spark):
    urls = [("a", START), ("b", START + HOUR / 2), ("c", START + 3 * HOUR), ("d", START + 9 * HOUR + timedelta(microseconds=1))]
    ticks = [START + i * HOUR for i in range(0, 40)]
    want = asked_at_every_tick(spark, urls, fibonacci(1.5 * HOUR, 5), ticks)
    schema = "url string, ts timestamp"
    again = [("a", START + 5 * HOUR)]  # known already
    batches = [urls[:2], urls[2:3] + again, urls[3:], [(None, START + 20 * HOUR)], *[[(None, START + 39 * HOUR + HOUR / 2)]] * 2]
    with timed_state(spark):
        stream = stream_due_urls(files(spark, schema, *batches), fibonacci_waits(1.5 * HOUR, 5), HOUR, START)
        got = run(spark, stream)
    assert sorted((r.url, r.tick, r.attempt) for r in got.collect()) == want


def test_periodic_schedule_has_no_end(spark):
    batches = [[("a", START + HOUR)], [(None, START + 10 * HOUR)], *[[(None, START + 31 * HOUR)]] * 2]
    with timed_state(spark):
        stream = stream_due_urls(files(spark, "url string, ts timestamp", *batches), periodic_waits(4 * HOUR), HOUR, START)
        got = run(spark, stream)
    assert sorted(r.attempt for r in got.collect()) == list(range(1, 9))
    assert got.agg(F.max("tick")).first()[0] == START + 29 * HOUR


def test_due_urls_share_the_state_of_their_group(spark):
    """As many states as groups, however many URLs there are; each URL keeps its own plan."""
    rng = random.Random(7)
    urls = [(f"u{i}", START + rng.randrange(12 * 3600) * (HOUR / 3600)) for i in range(60)]
    batches = [urls[:25], urls[25:] + urls[:5], *TICKS]
    schema = "url string, ts timestamp"
    got = {}
    with timed_state(spark):
        for groups in (1, 3, 4_096):
            checkpoint = scratch_path(spark, "groups")
            stream = stream_due_urls(
                files(spark, schema, *[[(r[0], r[1]) if len(r) == 2 else (None, r[1]) for r in b] for b in batches]),
                fibonacci_waits(1.5 * HOUR, 5), HOUR, START, groups=groups,
            )
            got[groups] = sorted((r.url, r.tick, r.attempt) for r in run(spark, stream, checkpoint).collect())
            plans = spark.read.format("statestore").option("stateVarName", "plan").load(checkpoint)
            assert plans.count() <= min(groups, 60)
    want = []
    for url, ts in urls:
        due = -(-(ts - START) // HOUR)
        for attempt, wait in enumerate((1, 1, 2, 3, 0), 1):
            want.append((url, START + due * HOUR, attempt))
            due += -(-(wait * 1.5 * HOUR) // HOUR)
    assert got[1] == got[3] == got[4_096] == sorted(want)


def test_rows_are_numbered_range_by_range(spark):
    from workload.queries import _numbered

    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("a"), F.lit("x").alias("b")).repartition(7)
    got = _numbered(rows, ["a", "b"], "ord")
    assert [tuple(r) for r in got.orderBy("a").collect()] == [(i, "x", i + 1) for i in range(500)]
    assert "Exchange SinglePartition" not in got._jdf.queryExecution().toString()
    assert _numbered(rows.limit(0), ["a"], "ord").count() == 0
