import time

import pytest
from pyspark.sql import functions as F

from linkloom.functions import base_name, parse_url, trim_ext, trim_space

# url -> (scheme, host, path), or None where it is no URL
CASES = {
    "http://example.com/a": ("http", "example.com", "/a"),
    "feed://example.com/a": ("feed", "example.com", "/a"),
    "example.com/a": ("", "", "example.com/a"),
    "http:////example.com?/a": ("http", "", "//example.com"),
    "": ("", "", ""),
    "http://example.com": ("http", "example.com", ""),
    "HTTP://User:pw@Ex.com:80/a%20b+c.txt?x#y": ("http", "Ex.com", "/a b+c.txt"),
    "http://my_host.com:80/x": ("http", "my_host.com", "/x"),
    "http://[::1]:8/x": ("http", "::1", "/x"),
    "//h/p": ("", "h", "/p"),
    "///x": ("", "", "///x"),
    "/%zz": None,
    "http://h/%zz": None,
    "http://h/a#%zz": None,
    "http://h/a?%zz": ("http", "h", "/a"),
    ":x": None,
    "a:b": ("a", "", ""),
    "1a:b": None,
    "a_b://x": None,
    "x/a:b": ("", "", "x/a:b"),
    "http://h:80x/": None,
    "http://h:/": ("http", "h", "/"),
    "http://a:b:80/": ("http", "a:b", "/"),
    "http://a:b:8c/": None,
    "http://ex ample.com/": None,
    "http://h/a b": ("http", "h", "/a b"),
    "http://h/\x01": None,
    "http://h/a#\x01": ("http", "h", "/a"),
    "mailto:x@y.z": ("mailto", "", ""),
    "http:/x": ("http", "", "/x"),
    "http://u@v@h/p": ("http", "h", "/p"),
    "http://u v@h/p": None,
    "http://%41/": None,
    "http://é.com/ü": ("http", "é.com", "/ü"),
    "http://[::1/x": None,
    "http://[::1]x/": None,
    "?q": ("", "", ""),
    "http://?q": ("http", "", ""),
    "http://h?q=/a:b": ("http", "h", ""),
    "a?b:c": ("", "", "a"),
    "http://h\\x/": None,
}


def test_parse_url(spark):
    rows = spark.createDataFrame([(u,) for u in CASES], "url string")
    parts = parse_url(F.col("url"))
    got = rows.select("url", *[c.alias(n) for n, c in parts._asdict().items()]).collect()
    assert {r.url: (r.scheme, r.host, r.path) if r.ok else None for r in got} == CASES


@pytest.mark.parametrize(
    "hostile",
    [
        "http://" + "a@" * 100_000 + "h/" + "%41" * 50_000,
        "http://" + "a:" * 100_000 + "b/",
        "http://[" + "]" * 100_000 + "/",
        "x" * 300_000,
    ],
)
def test_hostile_urls_cost_linear_time(spark, hostile):
    parts = parse_url(trim_space(F.col("url")))
    began = time.time()
    spark.createDataFrame([(hostile,)], "url string").select(*parts).collect()
    assert time.time() - began < 20


def test_base_name_and_trim_ext(spark):
    names = {
        "/d/file.ext": ("file.ext", "file"),
        ".bashrc": (".bashrc", ""),
        "a.tar.gz": ("a.tar.gz", "a.tar"),
        "x/a.": ("a.", "a"),
        "plain": ("plain", "plain"),
        "/d/": ("", ""),
        "/a.b\n": ("a.b\n", "a"),
    }
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    name = base_name(F.col("p"))
    got = {r.p: (r.n, r.s) for r in rows.select("p", name.alias("n"), trim_ext(name).alias("s")).collect()}
    assert got == names
