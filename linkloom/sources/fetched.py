"""Fetched payloads: decoding, resolving items to pages, failures, follow URLs."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.schemas import FETCH_RESULT
from linkloom.workspace import scratch_path, stage

OK = 200

# The code page that stands for all "Latin-1" labels on the web.  Its upper
# control range differs from ISO-8859-1; undefined bytes keep their value.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
_LATIN_LABELS = (
    "ascii", "us-ascii", "iso-8859-1", "iso8859-1", "latin1", "l1", "windows-1252", "cp1252",
    "x-cp1252",
)
_UTF8_LABELS = ("utf-8", "utf8", "unicode-1-1-utf-8")

_CHARSET = r"""(?i)charset\s*=\s*["']?\s*([^\s"';>]+)"""
# Where a document's own declaration must stand before.
_HEAD_END = r"(?i)</head|<body"


def read_fetch_results(spark: SparkSession, path: str) -> DataFrame:
    """Crawled payloads ``(url, status, content_type, body)`` kept as parquet."""
    return spark.read.schema(FETCH_RESULT).parquet(path)


def _charset(content_type: Column, body: Column) -> Column:
    """Byte-order mark, then the header, then the document's own declaration."""
    mark = F.hex(F.substring(body, 1, 3))
    latin = F.decode(body, "ISO-8859-1")
    end = F.regexp_instr(latin, F.lit(_HEAD_END))
    head = F.when(end > 0, F.substring(latin, F.lit(1), end - 1)).otherwise(latin)
    text = body.cast("string")
    declared = F.lower(
        F.coalesce(
            F.nullif(F.regexp_extract(F.coalesce(content_type, F.lit("")), _CHARSET, 1), F.lit("")),
            F.nullif(
                F.regexp_extract(
                    head,
                    r"""(?i)(?:<meta[^>]*charset|<\?xml[^>]*encoding)\s*=\s*["']?\s*([^\s"';>/?]+)""",
                    1,
                ),
                F.lit(""),
            ),
        )
    )
    guess = F.when(F.is_valid_utf8(text), "utf-8").otherwise("windows-1252")
    return (
        F.when(mark == "EFBBBF", "utf-8")
        .when(mark.startswith("FEFF"), "utf-16be")
        .when(mark.startswith("FFFE"), "utf-16le")
        .otherwise(F.coalesce(declared, guess))
    )


@F.arrow_udf(T.StringType())
def _decode_other(bodies: pa.Array, labels: pa.Array) -> pa.Array:
    def decode(body: bytes, label: str) -> str:
        try:
            text = body.decode(label, "replace")
        except (LookupError, ValueError):
            text = body.decode("cp1252", "replace")
        return text.removeprefix("\ufeff")

    # One body at a time: a batch of them is not held a second time.
    pairs = ((body.as_py(), label.as_py()) for body, label in zip(bodies, labels))
    return pa.array((None if body is None else decode(body, label) for body, label in pairs), pa.string())


def decode_bodies(
    results: DataFrame,
    keys: Sequence[str] = ("url",),
    body: str = "body",
    text: str = "text",
) -> DataFrame:
    """Successful payloads as text.

    UTF-8 and the Latin family are decoded by column expressions.  Only bodies
    in another charset are handed to Python; the others cross over as NULL.
    """
    label = F.col("__charset")
    raw = F.col(body)
    utf8 = label.isin(*_UTF8_LABELS)
    latin = label.isin(*_LATIN_LABELS)
    native = (
        F.when(utf8, F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"^\uFEFF", ""))
        .when(latin, F.translate(F.decode(raw, "ISO-8859-1"), _C1, _CP1252))
    )
    other = ~(utf8 | latin)
    return (
        results.where(F.col("status") == OK)
        .withColumn("__charset", _charset(F.col("content_type"), raw))
        .withColumn("__other", _decode_other(F.when(other, raw), F.when(other, label)))
        .select(*keys, F.coalesce(native, F.col("__other")).alias(text))
    )


def items_to_pages(items: DataFrame, pages: DataFrame, on: str = "url") -> DataFrame:
    """Resolve each item to the page fetched for its URL.

    No size is assumed for either side: Spark broadcasts a side whose statistics
    allow it and splits a hot URL through its skew join otherwise.
    """
    return items.join(pages, on, "inner")


def fetch_failures(
    wanted: DataFrame,
    results: DataFrame,
    unparsable: DataFrame | None = None,
) -> DataFrame:
    """Why wanted URLs gave nothing: ``(url, stage, reason)``.

    ``unparsable`` lists ``(url, reason)`` of documents a scanner refused.
    """
    urls = wanted.select("url").distinct()
    missing = urls.join(results, "url", "left_anti").select(
        "url", F.lit("fetch").alias("stage"), F.lit("not fetched").alias("reason")
    )
    refused = (
        results.where((F.col("status") != OK) | F.col("status").isNull())
        .join(urls, "url", "left_semi")
        .select(
            "url",
            F.lit("fetch").alias("stage"),
            F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("unknown")))
            .alias("reason"),
        )
    )
    failures = missing.unionByName(refused)
    if unparsable is not None:
        failures = failures.unionByName(
            unparsable.join(urls, "url", "left_semi").select(
                "url", F.lit("scan").alias("stage"), "reason"
            )
        )
    return failures


def follow_frontier(seeds: DataFrame, follows: DataFrame) -> DataFrame:
    """Breadth-first expansion: ``(url, depth)`` of all URLs that can be reached.

    ``seeds`` has ``url``; ``follows`` has ``src`` and ``dst``.  A URL is expanded
    once, at its smallest depth.  Each level is written as one partition of a table,
    so the plan of every level stays the same size, and the loop ends at the first
    empty level.  A level's rows are counted as they are written.
    """
    spark = follows.sparkSession
    edges = stage(follows.select("src", "dst").where("src <> dst").distinct(), "follow-edges")
    root = scratch_path(spark, "follow-levels")

    def write(level: DataFrame, depth: int) -> int:
        rows = Observation()
        level.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/depth={depth}")
        return rows.get["n"]

    depth, found = 0, write(seeds.select("url").distinct(), 0)
    while found:
        last = spark.read.schema("url string").parquet(f"{root}/depth={depth}")
        known = spark.read.schema("url string, depth int").parquet(root)
        step = (
            edges.join(last.select(F.col("url").alias("src")), "src")
            .select(F.col("dst").alias("url"))
            .distinct()
            .join(known.select("url"), "url", "left_anti")
        )
        depth += 1
        found = write(step, depth)
    return spark.read.schema("url string, depth int").parquet(root)
