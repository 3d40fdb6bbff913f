import pytest
from pyspark.sql import functions as F

from linkloom.schemas import FETCH_RESULT
from linkloom.sources import decode_bodies, fetch_failures, follow_frontier, items_to_pages


def results(spark, *rows):
    return spark.createDataFrame([(u, s, c, bytearray(b)) for u, s, c, b in rows], FETCH_RESULT)


@pytest.mark.parametrize(
    "content_type, body, text",
    [
        ("text/html; charset=utf-8", "häß€".encode(), "häß€"),
        ("text/html", "häß€".encode(), "häß€"),
        ("", b"h\xe4\xdf", "häß"),
        (None, b"plain", "plain"),
        ("text/html; Charset = 'ISO-8859-1'", b"caf\xe9 \x93q\x94 \x80\x81", "café “q” €\x81"),
        ("text/html; charset=windows-1252", b"\x80", "€"),
        ("text/xml; charset=koi8-r", "привет".encode("koi8-r"), "привет"),
        ("text/html; charset=shift_jis", "日本".encode("shift_jis"), "日本"),
        ("text/html; charset=utf-16le", "aé".encode("utf-16-le"), "aé"),
        ("text/html; charset=koi8-r", b"\xff\xfe" + "aé".encode("utf-16-le"), "aé"),
        ("text/html; charset=koi8-r", b"\xef\xbb\xbf" + "aé".encode(), "aé"),
        ("text/html", '<meta charset="koi8-r">да'.encode("koi8-r"), '<meta charset="koi8-r">да'),
        (
            "text/html",
            '<meta http-equiv=x content="text/html; charset=gbk">中'.encode("gbk"),
            '<meta http-equiv=x content="text/html; charset=gbk">中',
        ),
        ("text/xml", '<?xml version="1.0" encoding="koi8-r"?>да'.encode("koi8-r"),
         '<?xml version="1.0" encoding="koi8-r"?>да'),
        ("text/html; charset=no-such", b"\x80", "€"),
        ("text/html; charset=base64", b"abcd", "abcd"),
        ("text/html; charset=utf-8", b"a\xffb", "a�b"),
        ("text/html; charset=utf-16le", b"a\x00b", "a�"),
    ],
)
def test_decode(spark, content_type, body, text):
    rows = results(spark, ("u", 200, content_type, body))
    assert [tuple(r) for r in decode_bodies(rows).collect()] == [("u", text)]


def test_only_status_200_is_decoded(spark):
    rows = results(spark, ("a", 404, "", b"x"), ("b", 200, "", b""), ("c", 301, "", b"x"))
    assert [tuple(r) for r in decode_bodies(rows).collect()] == [("b", "")]


def urls(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "url string")


def test_items_to_pages(spark):
    pages = spark.createDataFrame([("a", "A"), ("b", "B")], "url string, html string")
    items = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t3", "c")], "title string, url string")
    got = sorted((r.title, r.html) for r in items_to_pages(items, pages).collect())
    assert got == [("t1", "A"), ("t2", "A")]


def test_fetch_failures(spark):
    rows = results(spark, ("ok", 200, "", b""), ("gone", 410, "", b""), ("other", 500, "", b""))
    refused = spark.createDataFrame([("ok", "bad"), ("x", "bad")], "url string, reason string")
    got = fetch_failures(urls(spark, "ok", "ok", "gone", "never"), rows, refused)
    assert sorted(tuple(r) for r in got.collect()) == [
        ("gone", "fetch", "status 410"), ("never", "fetch", "not fetched"), ("ok", "scan", "bad"),
    ]


def test_follow_frontier(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "y")],
        "src string, dst string",
    )
    got = {r.url: r.depth for r in follow_frontier(urls(spark, "a"), edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    got = {r.url: r.depth for r in follow_frontier(urls(spark, "a", "x"), edges).collect()}
    assert got == {"a": 0, "x": 0, "b": 1, "c": 1, "y": 1, "d": 2, "e": 3}


def test_follow_frontier_has_no_depth_limit(spark):
    chain = spark.range(12).selectExpr("cast(id AS string) AS src", "cast(id + 1 AS string) AS dst")
    assert {int(r.url): r.depth for r in follow_frontier(urls(spark, "0"), chain).collect()} == {
        i: i for i in range(13)
    }


def test_declared_charset_late_in_the_head(spark):
    late = b"<html><head><!--" + b"-" * 5_000 + b'--><meta charset="koi8-r"></head><body>' + "д".encode("koi8-r")
    after = b"<html><head></head><body>" + b'<meta charset="koi8-r">' + "é".encode("cp1252")
    got = {r.url: r.text for r in decode_bodies(results(spark, ("a", 200, "", late), ("b", 200, "", after))).collect()}
    assert got["a"].endswith("д") and got["b"].endswith("é")


def test_payloads_reach_python_in_batches_of_bounded_bytes(spark):
    """A batch is bounded by its bytes, not by its rows alone; decoding gives the same in any batch."""
    import pyarrow as pa

    from workload.views import Tables

    Tables(spark, "unused")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    body = F.encode(F.repeat(F.concat(F.lit("é"), F.col("id") % 10), 5_000), "UTF-16LE")
    rows = spark.range(0, 900, 1, 1).select(
        F.col("id").cast("string").alias("url"), F.lit(200).alias("status"),
        F.lit("text/html; charset=utf-16le").alias("content_type"), body.alias("body"),
    )
    assert rows.select("body").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 5_000_000
    got = decode_bodies(rows).where(F.col("text") == F.repeat(F.concat(F.lit("é"), F.col("url").cast("int") % 10), 5_000))
    assert got.count() == 900
