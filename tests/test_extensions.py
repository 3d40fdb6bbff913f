"""Sources, scanners and sinks of one's own, through Spark's extension points."""

import os
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from linkloom.plans import follow_scans
from linkloom.sinks import publish_feed
from linkloom.sources import feed_items, register_scanner, register_source, scan_pages
from linkloom.workspace import scratch_path

# The scanners below travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = datetime(2024, 5, 1, 12)


@pytest.fixture
def resources(spark, tmp_path):
    def keys(options):
        return sorted(f for f in os.listdir(options["path"]) if f.endswith(".txt"))

    def get(key, options):
        if "missing" in key:
            yield key, 404, None, None
        else:
            with open(os.path.join(options["path"], key), "rb") as file:
                yield key, 200, "text/plain", file.read()

    register_source(spark, "test_files", keys, get)
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(f"body {i}")
    (tmp_path / "5-missing.txt").write_text("")
    return tmp_path


def test_source_as_a_table(spark, resources):
    df = spark.read.format("test_files").option("keysPerPartition", 2).load(str(resources))
    assert df.rdd.getNumPartitions() == 3
    got = {r.url: (r.status, r.body) for r in df.collect()}
    assert got["3.txt"] == (200, b"body 3")
    assert got["5-missing.txt"] == (404, None)
    empty = resources / "none"
    empty.mkdir()
    assert spark.read.format("test_files").load(str(empty)).count() == 0


def test_stream_goes_on_from_its_offset(spark, resources):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")

    def run():
        df = spark.readStream.format("test_files").load(str(resources)).withColumn("n", F.length("body"))
        writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.url for r in spark.read.parquet(out).collect())

    first = run()
    assert len(first) == 6
    for i in (6, 7):
        (resources / f"{i}.txt").write_text("later")
    assert run() == sorted([*first, "6.txt", "7.txt"])
    assert run() == sorted([*first, "6.txt", "7.txt"])


def _scanner(url, body):
    for word in body.split():
        yield ("follow" if word.startswith("p") else "link"), word.upper(), word


def test_scanner_in_sql(spark):
    rows = [(1, "a", "x p2"), (2, "b", ""), (3, "c", None), (4, "d", "y")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    register_scanner(spark, "words_of_page", _scanner)
    got = spark.sql("SELECT * FROM words_of_page(TABLE({p})) WHERE kind = 'link'", p=pages)
    want = scan_pages(pages, _scanner).select(*got.columns).where("kind = 'link'")
    assert got.schema["page_id"].dataType == pages.schema["page_id"].dataType
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    renamed = pages.select(F.col("page_id").alias("k"), F.col("url").alias("u"), F.col("html").alias("b"))
    again = spark.sql("SELECT k FROM words_of_page(TABLE({p}), 'k', 'u', 'b') WHERE pos = 1", p=renamed)
    assert [r.k for r in again.collect()] == [1]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM words_of_page(TABLE({p}))", p=renamed).collect()


def test_feed_is_published_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "feeds" / "links.xml")
    items = spark.createDataFrame(
        [(f"t{i} <&>", f"http://h/{i:03}", NOW) for i in range(200)], "title string, url string, pub_date timestamp"
    ).repartition(7)
    publish_feed(items, path, NOW)

    def read():
        document = spark.createDataFrame([(open(path, encoding="utf-8").read(),)], "document string")
        found, failures = feed_items(document, NOW)
        assert failures.isEmpty()
        return [(r.pos, r.title, r.url) for r in found.orderBy("pos").collect()]

    assert read() == [(i, f"t{i} <&>", f"http://h/{i:03}") for i in range(200)]
    # A task that fails leaves the old document, and nothing beside it.
    bad = items.withColumn("title", F.when(F.col("url") == "http://h/150", F.raise_error(F.lit("broken"))).otherwise("new"))
    with pytest.raises(Exception, match="broken"):
        publish_feed(bad, path, NOW)
    assert len(read()) == 200 and read()[0][1] == "t0 <&>"
    assert os.listdir(tmp_path / "feeds") == ["links.xml"]
    publish_feed(items.limit(0), path, NOW)
    assert read() == []
    assert os.listdir(tmp_path / "feeds") == ["links.xml"]


def _follower(url, body):
    for word in body.split():
        yield "follow", "", word
    yield "item", f"at {url}", url


def test_follow_scans(spark):
    """Cycles, repeats, a missing page, a null target, and pages nobody asks for."""
    pages = [("a", "b c b"), ("b", "a d gone"), ("c", "c"), ("d", "e"), ("e", ""), ("z", "a")]
    table = spark.createDataFrame(pages, "url string, html string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,), ("nowhere",)], "url string")
    found = follow_scans(seeds, table, _follower, buckets=3)
    assert {(r.url, r.depth) for r in found.visited.collect()} == {
        ("a", 0), ("nowhere", 0), ("b", 1), ("c", 1), ("d", 2), ("gone", 2), ("e", 3),
    }
    assert sorted(r.url for r in found.missing.collect()) == ["gone", "nowhere"]
    items = found.emissions.where("kind = 'item'")
    assert {(r.src, r.depth) for r in items.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    assert items.count() == 5
    empty = follow_scans(seeds.limit(0), table, _follower)
    assert empty.visited.isEmpty() and empty.missing.isEmpty()


def test_levels_do_not_move_what_is_known(spark):
    """The anti-join with the visited URLs and the join with the pages shuffle the new level alone."""
    pages = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(30)], "url string, html string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = follow_scans(pages.select("url").limit(1), pages, _follower, buckets=3)
        assert found.visited.count() == 31
        plan = found.missing._jdf.queryExecution().executedPlan().toString()
        # Both sides are bucketed tables: no row of either moves.
        assert "Exchange" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
