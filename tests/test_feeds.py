import glob
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom.sinks import output_feed, write_feed
from linkloom.sources import feed_items, feed_kind, read_feed_files, union_feeds
from linkloom.workspace import scratch_path

NOW = datetime(2024, 3, 1, 12)

# What an item holds, and what comes of it: title, address, date of its own.
CASES = [
    (
        "<x:title>no</x:title><title>Fish &amp; <![CDATA[<chips>]]></title><link>/a?b&amp;c</link>"
        "<pubDate>Tue, 05 Mar 2019 10:20:30 +0100</pubDate>",
        "Fish & <chips>", "/a?b&c", datetime(2019, 3, 5, 9, 20, 30),
    ),
    ("<link>http://blanks.test/</link><title>\n Zweiter \u00dc\t</title>", "Zweiter \u00dc", "http://blanks.test/", NOW),
    ("<pubDate>soon</pubDate><link>http://untitled.test</link><x:link>no</x:link>", "", "http://untitled.test", NOW),
]


def rss_document(*items):
    return f"\n<?xml version='1.0'?><rss xmlns:x='urn:x'><channel>{''.join(f'<item>{i}</item>' for i in items)}</channel></rss>"


RSS = rss_document(*[body for body, *_ in CASES])
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
 xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel rdf:about="x"><title>c</title></channel>
<item rdf:about="q"><title>r</title><link>http://r</link><dc:date>2020-01-02T03:04:05Z</dc:date></item>
</rdf:RDF>"""
ATOM = """<?xml version="1.0"?><!-- c --><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
<entry><title type="html">one</title><link rel="self" href="http://s"/><link href="http://1"/>
<updated>2003-12-13T18:30:02Z</updated></entry>
<entry><title>two</title><link rel="alternate" href="http://2"/></entry>
<entry><title>three</title><link rel="edit" href="http://3"/></entry></feed>"""


def documents(spark, *docs):
    return spark.createDataFrame(list(enumerate(docs)), "feed int, document string")


def parsed(spark, *docs, **options):
    return feed_items(documents(spark, *docs), NOW, keys=["feed"], **options)


def rows(items):
    return [(r.feed, r.pos, r.title, r.url) for r in items.orderBy("feed", "pos").collect()]


def test_rss(spark):
    items, failures = parsed(spark, RSS)
    assert rows(items) == [(0, i, title, url) for i, (_, title, url, _) in enumerate(CASES)]
    assert {r.pub_date for r in items.collect()} == {NOW}
    assert failures.isEmpty()


def test_feed_dates(spark):
    items, _ = parsed(spark, RSS, RDF, ATOM, pub_date="feed")
    dates = [r.pub_date for r in items.orderBy("feed", "pos").collect()]
    assert dates == [
        *[date for *_, date in CASES],
        datetime(2020, 1, 2, 3, 4, 5),
        datetime(2003, 12, 13, 18, 30, 2), NOW, NOW,
    ]
    with pytest.raises(ValueError):
        parsed(spark, RSS, pub_date="other")


def test_rdf_and_atom(spark):
    items, failures = parsed(spark, RDF, ATOM, "<rss><channel><title>t</title></channel></rss>")
    assert rows(items) == [
        (0, 0, "r", "http://r"),
        (1, 0, "one", "http://1"), (1, 1, "two", "http://2"), (1, 2, "three", ""),
    ]
    assert failures.isEmpty()


def test_failures_do_not_stop_others(spark):
    items, failures = parsed(spark, "<html></html>", "", "no xml", RSS[:-30], None, RDF)
    assert rows(items) == [(5, 0, "r", "http://r")]
    assert {r.feed: r.reason for r in failures.collect()} == {
        0: "not a feed", 1: "not a feed", 2: "malformed document", 3: "malformed document",
        4: "not a feed",
    }


def test_feed_kind(spark):
    docs = documents(spark, RSS, RDF, ATOM, "<a:feed xmlns:a='x'/>", "<html/>", "<!DOCTYPE rss [\n]>\n<RSS/>")
    kinds = docs.orderBy("feed").select(feed_kind(F.col("document"))).collect()
    assert [r[0] for r in kinds] == ["rss", "rdf", "atom", "atom", None, "rss"]


def test_feed_files_and_fan_in(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS.strip(), encoding="utf-8")
    (tmp_path / "b.xml").write_text(RDF, encoding="utf-8")
    docs = union_feeds([
        ("rss", read_feed_files(spark, str(tmp_path / "a.xml"))),
        ("rss", read_feed_files(spark, str(tmp_path / "b.xml"))),
    ])
    items, _ = feed_items(docs, NOW, keys=["feed"])
    counts = {r.feed[-5:]: r["count"] for r in items.groupBy("feed").count().collect()}
    assert counts == {"a.xml": 3, "b.xml": 1}
    with pytest.raises(ValueError):
        union_feeds([("gopher", docs)])
    with pytest.raises(ValueError):
        union_feeds([])


LINKS = [
    ("b & <i>", "http://example.org/?a=1&b=2", NOW - timedelta(hours=1)),
    ("a \x07bell \U0001f600", "http://example.com", NOW),
    ("old", "http://example.net", NOW - timedelta(hours=6)),
]


def feed(spark, links):
    df = spark.createDataFrame(links, "title string, url string, added timestamp")
    return output_feed(df, NOW)


def written(spark, links, **options):
    path = scratch_path(spark, "feed")
    write_feed(feed(spark, links).repartition(3), path, NOW, **options)
    parts = sorted(glob.glob(re.sub("^file:", "", path) + "/part-*"))
    return "".join(open(part, encoding="utf-8").read() for part in parts)


def test_written_feed_survives_parsing(spark):
    document = written(spark, LINKS, title="my <feed>")
    assert "<title>my &lt;feed&gt;</title>" in document
    assert document.count("Fri, 01 Mar 2024 12:00:00 +0000") == 3
    items, failures = parsed(spark, document)
    assert rows(items) == [
        (0, 0, "a bell \U0001f600", "http://example.com"),
        (0, 1, "b & <i>", "http://example.org/?a=1&b=2"),
    ]
    assert failures.isEmpty()


def test_empty_feed_is_a_feed(spark):
    items, failures = parsed(spark, written(spark, []))
    assert items.isEmpty() and failures.isEmpty()


def test_prefixed_feeds(spark):
    atom = ATOM.replace("xmlns=", "xmlns:a=").replace("</", "\0").replace("<!", "\1").replace("<?", "\2")
    atom = atom.replace("<", "<a:").replace("\0", "</a:").replace("\1", "<!").replace("\2", "<?")
    rdf = RDF.replace("xmlns=", "xmlns:r.s=")
    for tag in ("channel", "title", "item", "link"):
        rdf = rdf.replace(f"<{tag}", f"<r.s:{tag}").replace(f"</{tag}", f"</r.s:{tag}")
    plain, _ = parsed(spark, ATOM, RDF)
    items, failures = parsed(spark, atom, rdf)
    assert failures.isEmpty()
    assert rows(items) == rows(plain) and len(rows(items)) == 4
