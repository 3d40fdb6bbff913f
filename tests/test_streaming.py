import os
import random
import time
from datetime import datetime, timedelta
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from linkloom.operators.schedule import attempt_state
from linkloom.operators.window_dedup import drop_window_duplicates
from linkloom.schemas import STORED_LINK
from linkloom.sinks import StoreTable
from linkloom.streaming import (
    read_latest,
    stream_attempt_state,
    stream_first_seen,
    stream_into_store,
    stream_window_dedup,
    stream_window_dedup_table,
    write_updates,
)
from linkloom.workspace import scratch_path

SCHEMA = "ord long, ts timestamp, host string, title string, url string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    data = []
    for i in range(600):
        host = f"h{rng.randint(0, 3)}"
        data.append((i, start + timedelta(minutes=i), host, f"t{i}", f"http://{host}/{rng.randint(0, 20)}"))
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def folder(rows, tmp_path_factory):
    """The rows as three files, oldest first: three micro-batches."""
    path = tmp_path_factory.mktemp("stream")
    now = time.time()
    for part in range(3):
        file = path / f"{part}.json"
        chunk = rows.where((F.col("ord") >= part * 200) & (F.col("ord") < part * 200 + 200))
        file.write_text("\n".join(chunk.toJSON().collect()))
        os.utime(file, (now - 100 + part * 10,) * 2)
    return str(path)


@pytest.fixture
def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)


def to_table(spark, df):
    path = scratch_path(spark, "rows")
    query = (
        df.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def test_window_dedup_equals_batch(spark, rows, stream):
    want = drop_window_duplicates(rows, 6, ["ord"], ["host"])
    got = to_table(spark, stream_window_dedup(stream, 6, ["ord"], ["host"]))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


@pytest.mark.parametrize("partition_by", [["host"], []])
def test_window_dedup_table_equals_batch(spark, rows, stream, partition_by):
    want = drop_window_duplicates(rows, 6, ["ord"], partition_by)
    path, checkpoint = scratch_path(spark, "dedup"), scratch_path(spark, "checkpoint")
    for _ in range(2):
        stream_window_dedup_table(
            stream, path, 6, ["ord"], partition_by, checkpoint, max_sequence_rows=45
        ).awaitTermination()
    got = spark.read.schema(rows.schema).parquet(f"{path}/rows").drop("batch")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_attempt_state_equals_batch(spark, rows, stream):
    path = scratch_path(spark, "attempts")
    log = stream.select("url", "ts")
    write_updates(stream_attempt_state(log), path, scratch_path(spark, "checkpoint")).awaitTermination()
    got = read_latest(spark, path, ["url"])
    want = attempt_state(rows.select("url", "ts"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_store_equals_batch_and_survives_a_restart(spark, rows, stream):
    table = StoreTable(spark, f"s_{uuid4().hex}", STORED_LINK, scratch_path(spark, "store"))
    checkpoint = scratch_path(spark, "checkpoint")
    links = stream.select("ord", "title", "url")

    def clock(batch_id):
        return datetime(2024, 2, 1) + timedelta(hours=batch_id)

    for _ in range(2):
        stream_into_store(links, table, ["ord"], checkpoint, clock).awaitTermination()
    # All batches once more, as after a lost checkpoint.
    other = scratch_path(spark, "checkpoint")
    stream_into_store(links, table, ["ord"], other, clock).awaitTermination()
    firsts = {}
    for row in rows.orderBy("ord").collect():
        firsts.setdefault(row.url, (row.title, clock(row.ord // 200)))
    assert {r.url: (r.title, r.added) for r in table.read().collect()} == firsts
    assert table.read().count() == len(firsts)


def test_first_seen(spark, rows, stream):
    distinct = rows.select("url").distinct().count()
    got = to_table(spark, stream_first_seen(stream.select("ts", "url"), "ts", "1 day"))
    assert got.count() == distinct
    # With a short memory some URLs come back.
    assert to_table(spark, stream_first_seen(stream.select("ts", "url"), "ts", "10 minutes")).count() > distinct
