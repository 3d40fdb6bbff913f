import random
from datetime import datetime, timedelta

from linkloom.operators.first_wins import first_per_key, first_seen_ttl


def test_first_per_key(spark):
    rows = spark.createDataFrame(
        [(3, "u", "c"), (1, "u", "z"), (2, "u", "a"), (5, "v", None)],
        "ord int, url string, title string",
    )
    got = first_per_key(rows, ["url"], ["ord"])
    assert got.columns == rows.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "u", "z"), (5, "v", None)]


def test_first_per_key_shuffles_one_row_per_key(spark):
    rows = spark.range(1000).selectExpr("id", "string(id % 3) AS url", "'t' AS title")
    plan = first_per_key(rows, ["url"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") > plan.index("Exchange hashpartitioning(url")


def brute_force(rows, max_age, interval, start):
    """Run the store and its cleanups in time order."""
    stored, kept, tick = {}, [], start + interval
    for ts, url, ord_ in sorted(rows):
        while tick <= ts:
            stored = {u: a for u, a in stored.items() if not a < tick - max_age}
            tick += interval
        if url not in stored:
            stored[url] = ts
            kept.append(ord_)
    return sorted(kept)


def test_first_seen_ttl_equals_a_simulated_store(spark):
    start = datetime(2024, 5, 1)
    rng = random.Random(11)
    for max_age, interval in ((6, 1), (1, 5), (0, 2), (7, 3)):
        rows = [
            (start + timedelta(minutes=rng.randint(0, 4_000)), f"u{rng.randint(0, 6)}", i)
            for i in range(600)
        ]
        # Rows exactly at a cleanup, and exactly at the edge of age.
        rows += [(start + timedelta(hours=h), "edge", 1_000 + h) for h in range(60)]
        df = spark.createDataFrame(rows, "ts timestamp, url string, ord int")
        got = first_seen_ttl(
            df, timedelta(hours=max_age), timedelta(hours=interval), start, order=["ord"]
        )
        assert got.columns == df.columns
        want = brute_force(rows, timedelta(hours=max_age), timedelta(hours=interval), start)
        assert sorted(r.ord for r in got.collect()) == want
