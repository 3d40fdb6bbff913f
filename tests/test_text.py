from datetime import datetime

from pyspark.sql import functions as F

from linkloom.functions import first_line, is_blank, rfc1123, sanitize_title, title_or_href, trim_space


def apply(spark, function, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_sanitize_title(spark):
    cases = {
        "": "",
        "  \t ": "",
        " -- b !": "b",
        "Some   Show (1999)": "some show 1999",
        "@handle": "handle",
        "a&b": "a b",
        "MiXeD CaSe": "mixed case",
        "Ünïcödé – straße": "ünïcödé straße",
        "٣ digits": "٣ digits",
        "İstanbul": "istanbul",
        "ΟΔΟΣ": "οδοσ",
    }
    assert apply(spark, sanitize_title, *cases) == list(cases.values())


def test_trim_space_is_unicode_aware(spark):
    assert apply(spark, trim_space, "\u00a0\u2003 x y \x85\n", "x", "", "\x0b\t", "a\u200b") == [
        "x y", "x", "", "", "a\u200b",
    ]


def test_is_blank(spark):
    assert apply(spark, is_blank, "", " \u3000", "x", None) == [True, True, False, True]


def test_first_line_keeps_carriage_return(spark):
    assert apply(spark, first_line, "a\r\nb", "a", "", "\nb") == ["a\r", "a", "", ""]


def test_title_or_href(spark):
    rows = spark.createDataFrame([(" t ", "u"), (" ", "u"), ("", "u")], "t string, u string")
    got = rows.select(title_or_href(F.col("t"), F.col("u"))).collect()
    assert [r[0] for r in got] == [" t ", "u", "u"]


def test_rfc1123(spark):
    row = spark.range(1).select(rfc1123(F.lit(datetime(2023, 3, 5, 4, 6, 7)))).first()
    assert row[0] == "Sun, 05 Mar 2023 04:06:07 +0000"
