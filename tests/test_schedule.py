from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linkloom.functions import fibonacci_numbers
from linkloom.operators.schedule import (
    Cleanups,
    attempt_state,
    due_fetches,
    fibonacci,
    interval_or_default,
    periodic,
    plan,
    with_attempts,
)

NOW = datetime(2024, 3, 1, 12)
HOUR = timedelta(hours=1)
STATE = "url string, attempts long, last timestamp"


def planned(spark, schedule, last, attempts):
    row = plan(spark.createDataFrame([("u", attempts, last)], STATE), schedule, NOW).first()
    return row.should_continue, row.due


def test_periodic(spark):
    assert planned(spark, periodic(HOUR), None, 0) == (True, NOW)
    last = NOW - timedelta(minutes=5)
    assert planned(spark, periodic(HOUR), last, 99) == (True, last + HOUR)


def test_periodic_with_own_interval(spark):
    rows = spark.createDataFrame(
        [("a", timedelta(minutes=90)), ("b", timedelta(0)), ("c", None)],
        "url string, own interval day to second",
    ).withColumn("last", F.lit(NOW)).withColumn("attempts", F.lit(1))
    got = plan(rows, periodic(interval_or_default(F.col("own"), HOUR)), NOW).collect()
    assert {r.url: r.due - NOW for r in got} == {
        "a": timedelta(minutes=90), "b": HOUR, "c": HOUR,
    }


def test_fibonacci(spark):
    schedule = fibonacci(HOUR, 5)
    assert planned(spark, schedule, None, 0) == (True, NOW)
    assert planned(spark, schedule, NOW, 0) == (True, NOW)
    assert planned(spark, schedule, NOW, 1) == (True, NOW + HOUR)
    assert planned(spark, schedule, NOW, 3) == (True, NOW + 2 * HOUR)
    assert planned(spark, schedule, NOW, 4) == (True, NOW + 3 * HOUR)
    assert planned(spark, schedule, NOW, 5) == (False, None)
    assert planned(spark, schedule, NOW, 10) == (False, None)
    assert fibonacci_numbers(8) == [0, 1, 1, 2, 3, 5, 8, 13]
    assert fibonacci_numbers(1) == [0]


def test_attempts_and_due(spark):
    log = spark.createDataFrame(
        [("a", NOW - 3 * HOUR), ("a", NOW - 2 * HOUR), ("b", NOW)], "url string, ts timestamp"
    )
    candidates = spark.createDataFrame([("a",), ("b",), ("new",)], "url string")
    state = with_attempts(candidates, attempt_state(log))
    assert {r.url: (r.attempts, r.last) for r in state.collect()} == {
        "a": (2, NOW - 2 * HOUR), "b": (1, NOW), "new": (0, None),
    }
    got = due_fetches(state, fibonacci(HOUR), NOW).collect()
    assert {r.url: r.due for r in got} == {"a": NOW - HOUR, "new": NOW}
    assert due_fetches(state, fibonacci(HOUR, 0), NOW).isEmpty()


def test_counts_start_again_after_a_cleanup(spark):
    day = lambda d, hour=0: datetime(2024, 1, d, hour)
    log = [("u", day(1, h)) for h in range(7)] + [("v", day(1)), ("v", day(2, 1)), ("u", day(10)), ("w", day(9))]
    df = spark.createDataFrame(log, "url string, ts timestamp")
    cleanups = Cleanups(timedelta(hours=24), timedelta(hours=48))

    def state(as_of, **options):
        rows = attempt_state(df.where(F.col("ts") <= F.lit(as_of)), cleanups, as_of, **options).collect()
        return {r.url: (r.attempts, r.last) for r in rows}

    # Forgotten at the first midnight over 48 hours after the last attempt.
    assert state(day(3, 23)) == {"u": (7, day(1, 6)), "v": (2, day(2, 1))}
    assert state(day(4)) == {"v": (2, day(2, 1))}
    assert state(day(5)) == {}
    assert state(day(10, 1)) == {"u": (1, day(10)), "w": (1, day(9))}
    # The same in two steps, the state of the first carried on.
    for split in (day(1, 3), day(4, 12), day(9, 12)):
        first = attempt_state(df.where(F.col("ts") <= F.lit(split)), cleanups)
        rest = df.where(F.col("ts") > F.lit(split))
        rows = attempt_state(rest, cleanups, day(10, 1), first).collect()
        assert {r.url: (r.attempts, r.last) for r in rows} == {"u": (1, day(10)), "w": (1, day(9))}
