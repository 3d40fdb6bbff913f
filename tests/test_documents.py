"""Whole jobs from documents and payloads, with failures and broken-off batches."""

from datetime import datetime, timedelta
from uuid import uuid4

import pytest

from linkloom.operators.link_filters import filename_as_title
from linkloom.plans import collect_documents
from linkloom.schemas import FETCH_RESULT, SCANNED, STORED_ITEM, STORED_LINK
from linkloom.sinks import StoreTable
from linkloom.streaming import store_sinks, stream_documents_to_links
from linkloom.workspace import scratch_path

NOW = datetime(2024, 5, 1)


def rss(*items):
    body = "".join(f"<item><title>{t}</title><link>{u}</link></item>" for t, u in items)
    return f'<?xml version="1.0"?><rss version="2.0"><channel>{body}</channel></rss>'


def fetched(spark, *rows):
    return spark.createDataFrame(
        [(u, s, "text/html; charset=utf-8", None if b is None else bytearray(b.encode())) for u, s, b in rows], FETCH_RESULT
    )


FEEDS = [
    ("f1", 200, rss(("one", "p1"), ("two", "p2"))),
    ("f2", 200, "<html></html>"),
    ("f3", 500, None),
    ("f4", 200, rss(("four", "p4"), ("again", "p1"), ("gone", "p9"))),
    ("f5", 200, "<rss><channel>"),
]
PAGES = [
    ("p1", 200, '<a href="/one.html">x</a><a href="/both">y</a>'),
    ("p2", 200, '<a href="/two">x</a>http://text.example/two <a href="/both">z</a>'),
    ("p4", 404, None),
    ("p5", 200, '<a href="/never">x</a>'),
]


def test_one_run(spark):
    stored_items = spark.createDataFrame([("two", "p2", NOW, NOW - timedelta(hours=1))], STORED_ITEM)
    stored_links = spark.createDataFrame([("", "/both", NOW - timedelta(hours=2))], STORED_LINK)
    wanted = spark.createDataFrame([(f"f{i}",) for i in range(1, 7)], "url string")
    run = collect_documents(
        wanted, fetched(spark, *FEEDS), fetched(spark, *PAGES), stored_items, stored_links, [], [filename_as_title], NOW
    )
    assert sorted((r.title, r.url) for r in run.items.collect()) == [("four", "p4"), ("gone", "p9"), ("one", "p1")]
    assert [(r.title, r.url) for r in run.links.collect()] == [("one.html", "/one.html")]
    assert sorted(map(tuple, run.failures.collect())) == [
        ("f2", "scan", "not a feed"), ("f3", "fetch", "status 500"), ("f5", "scan", "malformed document"),
        ("f6", "fetch", "not fetched"), ("p4", "fetch", "status 404"), ("p9", "fetch", "not fetched"),
    ]
    feed = run.feed(stored_links, NOW + timedelta(hours=1))
    assert [(r.title, r.url) for r in feed.collect()] == [("", "/both"), ("one.html", "/one.html")]


class Jobs:
    def __init__(self, spark):
        self.spark, run = spark, uuid4().hex
        self.items, self.links, self.scanned = [
            StoreTable(spark, f"docs_{kind}_{run}", schema, scratch_path(spark, kind))
            for kind, schema in (("items", STORED_ITEM), ("links", STORED_LINK), ("scanned", SCANNED))
        ]
        self.path, self.checkpoint = scratch_path(spark, "job"), scratch_path(spark, "checkpoint")
        self.source = scratch_path(spark, "fetched")
        for i, rows in enumerate((FEEDS[:2], FEEDS[2:4], FEEDS[4:])):
            fetched(spark, *rows).coalesce(1).write.mode("append").parquet(f"{self.source}/at={i}")

    def run(self, sinks):
        feeds = (
            self.spark.readStream.schema(FETCH_RESULT).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(self.source)
        )
        late = lambda batch: fetched(self.spark, *(PAGES if batch else PAGES[:1]))
        stream_documents_to_links(
            feeds, late, self.items, self.links, self.scanned, [], [filename_as_title], sinks, self.path,
            self.checkpoint, clock=lambda batch: NOW + timedelta(minutes=batch),
        ).awaitTermination()

    def sinks(self):
        return store_sinks(self.links, self.scanned, self.items, f"{self.path}/failures")

    def state(self):
        failures = self.spark.read.parquet(f"{self.path}/failures").select("batch", "url", "stage", "reason")
        rows = lambda df: sorted(tuple(r) for r in df.collect())
        return [rows(t.read()) for t in (self.items, self.links, self.scanned)] + [rows(failures)]


def test_batches_equal_a_run_that_broke_off_between_sinks(spark):
    whole = Jobs(spark)
    whole.run(whole.sinks())
    items, links, scanned, failures = whole.state()
    assert [r[1] for r in items] == ["p4", "p9", "p1", "p2"]
    assert sorted(r[1] for r in links) == ["/both", "/one.html", "/two", "http://text.example/two"]
    # The second page came with the second batch only.
    assert sorted((r[0], r[1]) for r in scanned) == [("p1", NOW), ("p2", NOW + timedelta(minutes=1))]
    assert sorted({r[1:] for r in failures}) == [
        ("f2", "scan", "not a feed"), ("f3", "fetch", "status 500"), ("f5", "scan", "malformed document"),
        ("p4", "fetch", "status 404"),
    ]

    broken = Jobs(spark)
    for fails in ("links", "scanned", "items", "failures"):
        sinks = broken.sinks()

        def failing(rows, as_of, batch, own=sinks[fails]):
            own(rows, as_of, batch)  # the sink has its rows, but is not marked
            raise RuntimeError("killed")

        sinks[fails] = failing
        with pytest.raises(Exception, match="killed"):
            broken.run(sinks)
    counted = {}
    sinks = {
        name: (lambda rows, as_of, batch, own=own, name=name: (counted.setdefault(name, []).append(batch), own(rows, as_of, batch)))
        for name, own in broken.sinks().items()
    }
    broken.run(sinks)
    assert broken.state() == whole.state()
    # Sinks that had taken the first batch are left alone.
    assert counted == {"links": [1, 2], "scanned": [1, 2], "items": [1, 2], "failures": [0, 1, 2]}
