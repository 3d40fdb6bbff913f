from datetime import datetime, timedelta
from uuid import uuid4

from pyspark.sql import functions as F

from linkloom.operators.stores import (
    flag_existing,
    insert_absent,
    new_rows,
    recent,
    recent_by_key,
    resume_items,
    retain,
)
from linkloom.schemas import STORED_LINK
from linkloom.sinks import StoreTable
from linkloom.workspace import scratch_path

NOW = datetime(2024, 3, 1, 12)
HOUR = timedelta(hours=1)


def store(spark, *rows):
    return spark.createDataFrame(list(rows), STORED_LINK)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "ord int, title string, url string")


def test_insert_absent_first_write_wins(spark):
    old = store(spark, ("kept", "u1", NOW - HOUR))
    new = batch(spark, (2, "late", "u2"), (1, "early", "u2"), (3, "x", "u1"))
    rows = sorted(tuple(r) for r in insert_absent(new, old, ["ord"], NOW).collect())
    assert rows == [("early", "u2", NOW), ("kept", "u1", NOW - HOUR)]
    # A second time nothing is new.
    assert new_rows(new, insert_absent(new, old, ["ord"], NOW), ["ord"]).isEmpty()


def test_flag_existing(spark):
    old = store(spark, ("t", "u1", NOW))
    new = batch(spark, (1, "a", "u1"), (2, "b", "u2"), (3, "c", "u2"), (4, "d", "u3"))
    got = {r.ord: r.existed for r in flag_existing(new, old, ["ord"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_recent_is_strict_and_in_key_order(spark):
    rows = store(spark, ("", "b", NOW), ("", "a", NOW - HOUR), ("", "B", NOW), ("", "é", NOW))
    assert [r.url for r in recent_by_key(rows, HOUR, NOW).collect()] == ["B", "b", "é"]
    assert recent(rows, timedelta(0), NOW).isEmpty()
    assert recent(store(spark), HOUR, NOW).isEmpty()


def test_retain_keeps_the_cutoff(spark):
    rows = store(spark, ("", "a", NOW - HOUR), ("", "b", NOW - HOUR - timedelta(seconds=1)))
    assert [r.url for r in retain(rows, HOUR, NOW).collect()] == ["a"]
    assert retain(rows, timedelta(0), NOW + HOUR).isEmpty()


def test_resume_items(spark):
    old = store(spark, ("", "a", NOW), ("", "b", NOW - 30 * HOUR))
    new = spark.createDataFrame([("a",), ("c",)], "url string")
    got = resume_items(old, new, timedelta(hours=24), NOW).collect()
    assert sorted(r.url for r in got) == ["a", "c"]


def test_store_table(spark):
    name = f"store_{uuid4().hex}"
    table = StoreTable(spark, name, STORED_LINK, scratch_path(spark, "store"))
    days = [datetime(2024, 3, day, 6) for day in (1, 2, 3)]
    for i, day in enumerate(days):
        table.insert_absent(batch(spark, (1, f"t{i}", f"u{i}"), (2, "again", "u0")), ["ord"], day)
    # A batch that is run again adds nothing.
    table.insert_absent(batch(spark, (1, "t2", "u2")), ["ord"], days[2])
    assert sorted(tuple(r) for r in table.read().collect()) == [
        ("t0", "u0", days[0]), ("t1", "u1", days[1]), ("t2", "u2", days[2]),
    ]
    recent_rows = table.recent(timedelta(hours=25), days[2])
    assert sorted(r.url for r in recent_rows.collect()) == ["u1", "u2"]
    plan = recent_rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(added_day" in plan

    later = days[1] + HOUR
    table.insert_absent(batch(spark, (1, "t3", "u3")), ["ord"], later)
    # The cutoff falls into the second day, between its two rows.
    table.cleanup(timedelta(hours=23), later + timedelta(hours=23))
    assert sorted(r.url for r in table.read().collect()) == ["u2", "u3"]
    # A removed URL is new again.
    table.insert_absent(batch(spark, (1, "back", "u0")), ["ord"], days[2])
    assert table.read().where(F.col("url") == "u0").first().title == "back"
    table.cleanup(timedelta(0), days[2] + timedelta(days=9))
    assert table.read().isEmpty()
    spark.sql(f"DROP TABLE {name}")


def test_bucketed_store_is_not_moved(spark):
    name = f"store_{uuid4().hex}"
    table = StoreTable(spark, name, STORED_LINK, scratch_path(spark, "store"), buckets=6)
    for i in range(3):
        rows = [(n, "t", f"u{n + 5 * i}") for n in range(10)]
        table.insert_absent(batch(spark, *rows), ["ord"], NOW + i * HOUR)
    assert sorted(r.url for r in table.read().collect()) == sorted(f"u{n}" for n in range(20))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = new_rows(batch(spark, (1, "t", "u1"), (2, "t", "new")), table.read(), ["ord"])
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert [r.url for r in fresh.collect()] == ["new"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # The scan of the store is joined as it lies; only the batch is shuffled.
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    join = next(i for i, line in enumerate(lines) if "LeftAnti" in line)
    store_side = lines[max(i for i in range(join, scan) if "+- Sort" in lines[i]) : scan]
    assert not any("Exchange" in line for line in store_side), plan
    spark.sql(f"DROP TABLE {name}")


def test_summaries_leave_days_unread(spark):
    """Five days of 200 URLs: a batch reads the days it shares URLs with, and inserts the same rows."""
    plain, summed = (
        StoreTable(spark, f"store_{uuid4().hex}", STORED_LINK, scratch_path(spark, "store"), summaries=s)
        for s in (False, True)
    )
    days = [datetime(2024, 3, day, 6) for day in range(1, 6)]
    for i, day in enumerate(days):
        rows = [(n, "t", f"u{n + 190 * i}") for n in range(200)]
        for table in (plain, summed):
            table.insert_absent(batch(spark, *rows), ["ord"], day)
    mixed = batch(spark, (1, "x", "u5"), (2, "x", "u6"), (3, "x", "u400"), (4, "x", "new"))
    assert summed.days_to_compare(mixed) == ["2024-03-01", "2024-03-03"]
    assert summed.days_to_compare(batch(spark, (1, "x", "new"))) == []
    assert plain.days_to_compare(mixed) == [f"2024-03-0{d}" for d in range(1, 6)]
    read = summed.read_days(summed.days_to_compare(mixed))
    assert {f.rsplit("added_day=")[1][:10] for f in read.inputFiles()} == {"2024-03-01", "2024-03-03"}
    for table in (plain, summed):
        table.insert_absent(mixed, ["ord"], days[4] + HOUR)
        table.cleanup(timedelta(days=2), days[4])
    rows = lambda t: sorted(tuple(r) for r in t.read().collect())
    assert rows(plain) == rows(summed)
    # Forgotten days are forgotten by the summaries too.
    assert summed.days_to_compare(batch(spark, (1, "x", "u5"))) == []
    # A table that was made without them is summarised when it is opened with them.
    path = scratch_path(spark, "late")
    late = StoreTable(spark, f"store_{uuid4().hex}", STORED_LINK, path)
    late.insert_absent(batch(spark, (1, "t", "old")), ["ord"], days[0])
    late = StoreTable(spark, late.name, STORED_LINK, path, summaries=True)
    assert late.days_to_compare(batch(spark, (1, "t", "old"))) == ["2024-03-01"]
    assert late.days_to_compare(batch(spark, (1, "t", "other"))) == []
    for table in (plain, summed, late):
        spark.sql(f"DROP TABLE {table.name}")
