import json
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException

from linkloom.operators.link_filters import apply_chain
from linkloom.plans import (
    PipelineSpec,
    SpecError,
    collect_links,
    due_feeds,
    item_chain,
    link_chain,
    parse_duration,
)
from linkloom.plans.spec import feed_table
from linkloom.schemas import STORED_ITEM, STORED_LINK

RAW = {
    "fetchInterval": "1h5m",
    "cleanupInterval": "10m",
    "port": 1,
    "feeds": [
        {"type": "rss", "url": "http://a/feed"},
        {"type": "rss", "url": "http://b/feed", "fetchInterval": "1h30m"},
    ],
    "itemFilters": [{"type": "title", "titles": ["Film", "Série"]}],
    "linkFilters": [
        {"type": "domain", "domains": ["h.com", "ul.to"]},
        {"type": "duplicates", "size": 2},
        {"type": "expanduploadedlinks"},
        {"type": "regex", "exprs": [r".*\.mkv$"]},
        {"type": "filenameastitle", "trimExt": True},
    ],
}


@pytest.mark.parametrize(
    "text, minutes",
    [("1h5m", 65), ("90s", 1.5), ("1.5h", 90), ("0", 0), ("-2m", -2), ("1h0m0s", 60), ("500ms", 1 / 120)],
)
def test_durations(text, minutes):
    assert parse_duration(text) == timedelta(minutes=minutes)


@pytest.mark.parametrize("text", ["", "5", "1x", "h", "1h 5m"])
def test_bad_durations(text):
    with pytest.raises(SpecError):
        parse_duration(text)


def test_defaults():
    spec = PipelineSpec.from_dict({})
    assert spec.fetch_interval == timedelta(minutes=65)
    assert spec.output_max_age == timedelta(hours=6)
    assert spec.cleanup_interval == timedelta(hours=1)
    assert spec.cleanup_max_age == timedelta(hours=24)
    assert spec.max_attempts == 7
    assert spec.item_filters == spec.link_filters == spec.feeds == ()


def test_values_and_feeds(spark):
    spec = PipelineSpec.from_dict(RAW)
    assert spec.cleanup_interval == timedelta(minutes=10)
    assert spec.extra == {"port": 1}
    rows = [tuple(r) for r in feed_table(spark, spec).collect()]
    assert rows == [
        ("rss", "http://a/feed", timedelta(minutes=65)),
        ("rss", "http://b/feed", timedelta(minutes=90)),
    ]


def test_due_feeds(spark):
    now = datetime(2024, 3, 1)
    log = spark.createDataFrame(
        [("http://a/feed", now - timedelta(minutes=70)), ("http://b/feed", now - timedelta(minutes=70))],
        "url string, ts timestamp",
    )
    spec = PipelineSpec.from_dict(RAW)
    assert [r.url for r in due_feeds(spark, spec, log, now).collect()] == ["http://a/feed"]
    later = due_feeds(spark, spec, log, now + timedelta(minutes=20))
    assert sorted(r.url for r in later.collect()) == ["http://a/feed", "http://b/feed"]


@pytest.mark.parametrize(
    "raw",
    [
        {"feeds": [{"type": "gopher", "url": "u"}]},
        {"itemFilters": [{"type": "domain"}]},
        {"linkFilters": [{"type": "title"}]},
        {"linkFilters": [{}]},
    ],
)
def test_unknown_types_are_errors(raw):
    with pytest.raises(SpecError):
        PipelineSpec.from_dict(raw)


def test_files(tmp_path):
    path = tmp_path / "spec.json"
    path.write_text(json.dumps(RAW))
    assert PipelineSpec.from_file(str(path)) == PipelineSpec.from_dict(RAW)
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "spec.yml"
    path.write_text(yaml.safe_dump(RAW))
    assert PipelineSpec.from_file(str(path)) == PipelineSpec.from_dict(RAW)


def test_link_chain_in_order(spark):
    links = spark.createDataFrame(
        [
            (0, "t", "http://h.com/a.mkv"),
            (1, "t", "http://other.com/x.mkv"),
            (2, "t", "http://h.com/a.mkv"),
            (3, "t", "http://ul.to/id"),
            (4, "t", "http://h.com/b.html"),
            (5, "t", "http://h.com/a.mkv"),
        ],
        "ord int, title string, url string",
    )
    lookups = spark.createDataFrame(
        [("http://ul.to/file/id/status", "c.mkv\n1 KB")], "status_url string, body string"
    )
    steps = link_chain(PipelineSpec.from_dict(RAW), ["ord"], lookups=lookups)
    got = sorted(tuple(r) for r in apply_chain(links, steps).collect())
    # Row 5 is accepted: the memory of two holds the short link and b.html by then.
    assert got == [
        (0, "a", "http://h.com/a.mkv"),
        (3, "c", "http://ul.to/file/id/c.mkv"),
        (5, "a", "http://h.com/a.mkv"),
    ]


def test_chain_errors(spark):
    with pytest.raises(SpecError):
        link_chain(PipelineSpec.from_dict(RAW), ["ord"])
    spec = PipelineSpec.from_dict({"linkFilters": [{"type": "regex", "exprs": ["("]}]})
    links = spark.createDataFrame([("t", "u")], "title string, url string")
    with pytest.raises(PySparkException):
        apply_chain(links, link_chain(spec, []))


def test_duplicates_default_window():
    spec = PipelineSpec.from_dict({"linkFilters": [{"type": "duplicates", "size": 0}]})
    assert link_chain(spec, ["ord"])[0].keywords["size"] == 100


@pytest.mark.parametrize("method", ["parser", "native"])
def test_collect_links(spark, method):
    now = datetime(2024, 3, 1)
    items = spark.createDataFrame(
        [(0, "A film", "http://p/0", now), (1, "News", "http://p/1", now), (2, "Film 2", "http://p/2", now),
         (3, "Film 3", "http://p/3", now)],
        "page_id int, title string, url string, pub_date timestamp",
    )
    pages = spark.createDataFrame(
        [
            (0, "http://p/0", '<a href="http://h.com/1.mkv">x</a> http://h.com/2.mkv'),
            (1, "http://p/1", '<a href="http://h.com/3.mkv">x</a>'),
            (2, "http://p/2", '<a href="http://h.com/2.mkv">x</a><a href="http://h.com/4.mkv">y</a>'),
        ],
        "page_id int, url string, html string",
    )
    spec = PipelineSpec.from_dict({**RAW, "linkFilters": RAW["linkFilters"][:1]})
    collected = collect_links(
        items, pages,
        spark.createDataFrame([("old", "http://p/3", now, now)], STORED_ITEM),
        spark.createDataFrame([("old", "http://h.com/4.mkv", now)], STORED_LINK),
        item_chain(spec), link_chain(spec, []), now, method=method,
    )
    assert sorted(r.url for r in collected.items.collect()) == ["http://p/0", "http://p/2"]
    assert sorted(tuple(r) for r in collected.links.collect()) == [
        ("http://h.com/2.mkv", "http://h.com/2.mkv", now), ("x", "http://h.com/1.mkv", now),
    ]


def test_a_page_that_comes_after_its_item(spark):
    now = datetime(2024, 3, 1)
    spec = PipelineSpec.from_dict({**RAW, "linkFilters": RAW["linkFilters"][:1]})
    items = spark.createDataFrame([(0, "A film", "http://p/0", now)], "page_id int, title string, url string, pub_date timestamp")
    page = spark.createDataFrame([(0, "http://p/0", '<a href="http://h.com/1.mkv">x</a>')], "page_id int, url string, html string")
    none, later = "url string, added timestamp", now + timedelta(hours=5)

    def collect(items, pages, store, scanned, as_of):
        links = spark.createDataFrame([], STORED_LINK)
        return collect_links(items, pages, store, links, item_chain(spec), link_chain(spec, []), as_of, scanned=scanned)

    first = collect(items, page.limit(0), spark.createDataFrame([], STORED_ITEM), spark.createDataFrame([], none), now)
    assert first.items.count() == 1 and first.links.isEmpty() and first.scanned.isEmpty()
    store = spark.createDataFrame(first.items.collect(), STORED_ITEM)
    second = collect(items, page, store, spark.createDataFrame([], none), later)
    assert second.items.isEmpty()
    assert [r.url for r in second.links.collect()] == ["http://h.com/1.mkv"]
    assert [r.url for r in second.scanned.collect()] == ["http://p/0"]
    third = collect(items, page, store, spark.createDataFrame(second.scanned.collect(), none), later)
    assert third.links.isEmpty() and third.scanned.isEmpty()
    too_late = collect(items, page, store, spark.createDataFrame([], none), now + timedelta(days=2))
    assert too_late.scanned.isEmpty()
