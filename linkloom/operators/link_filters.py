"""Filters on links.  Each keeps all columns and may change ``title`` or ``url``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from linkloom.functions.text import first_line, trim_space
from linkloom.functions.urls import base_name, parse_url, trim_ext
from linkloom.workspace import local_rows

# Hosts whose short file links can be expanded.
SHORT_LINK_HOSTS = ("ul.to", "uploaded.net")

Step = Callable[[DataFrame], DataFrame]


def apply_chain(rows: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Run the steps in order; no steps leave the rows as they are."""
    return reduce(DataFrame.transform, steps, rows)


def filter_domains(links: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Keep links whose host is one of ``domains``: exact, in any case, any port."""
    wanted = sorted({domain.strip().lower() for domain in domains})
    if not wanted:
        return links.where(F.lit(False))
    parts = parse_url(F.col("url"))
    # The host first: it decides most rows, and is the cheaper test.
    return links.where(F.lower(parts.host).isin(*wanted) & parts.ok)


def filter_domains_by_table(links: DataFrame, domains: DataFrame) -> DataFrame:
    """:func:`filter_domains` with the domains in a table, column ``domain``."""
    wanted = domains.select(F.lower(trim_space(F.col("domain"))).alias("__host")).distinct()
    parts = parse_url(F.col("url"))
    return (
        links.withColumn("__host", F.when(parts.ok, F.lower(parts.host)))
        .join(wanted, "__host", "left_semi")
        .drop("__host")
    )


def _any_of(conditions: Sequence[Column]) -> Column:
    """A balanced tree of alternatives: its depth grows with the logarithm of their number."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return _any_of(conditions[:half]) | _any_of(conditions[half:])


def _search_form(expression: str) -> str:
    """The expression without a leading ``.*``, which decides nothing in a search."""
    return re.sub(r"^(?:\.\*\??)+(?![*+?{])", "", expression)


# Expressions that both engines read alike and that need no backtracking to speak of: letters, escaped
# signs, plain classes, alternatives in groups, and no repetition but a few "?".
_SIMPLE = re.compile(
    r"""\^?(?:(?:[\w /:,;=&%@~!<>"'\-]|\\[^\w\s]|\.|\[\^?(?:[\w/:,;=%@~.][\w/:,;=%@~.\-]*)\])\??|\((?:\?:)?|\)(?![?*+{])|\|)*\$?"""
)
_MOST_OPTIONAL = 4
#: Expressions that one compiled pattern joins at most.
_JOINED = 200


def _native_form(expression: str) -> str | None:
    """The expression for generated code, or None if it belongs to the linear-time engine.

    ``(?d)`` makes a dot match all but a line feed; the end is the end of the text.
    """
    form = _search_form(expression)
    if not _SIMPLE.fullmatch(form) or form.count("?") - form.count("(?:") > _MOST_OPTIONAL:
        return None
    try:
        re.compile(form)
    except re.error:
        return None
    # An anchor inside an alternative belongs to it alone.
    if "|" in form and (form.startswith("^") or form.endswith("$")):
        return None
    end = form.endswith("$") and not form.endswith("\\$")
    return "(?d)" + (form[:-1] + r"\z" if end else form)


def _linear_patterns(expressions: Sequence[str]) -> list[str]:
    """Alternatives of the expressions, in as few patterns as the engine compiles."""
    joined = "|".join(f"(?:{e})" for e in expressions)
    try:
        pc.match_substring_regex(pa.array([""]), joined)
        return [joined]
    except pa.ArrowInvalid:
        if len(expressions) == 1:
            raise
        half = len(expressions) // 2
        return _linear_patterns(expressions[:half]) + _linear_patterns(expressions[half:])


def _matches_linear(patterns: Sequence[str]):
    """A column function: does any pattern match?  Whole Arrow batches, linear in the text."""

    @F.arrow_udf(T.BooleanType())
    def matches(text: pa.Array) -> pa.Array:
        found = None
        for pattern in patterns:
            own = pc.match_substring_regex(text, pattern)
            found = own if found is None else pc.or_(found, own)
        return found

    return matches


def filter_url_regex(links: DataFrame, expressions: Sequence[str]) -> DataFrame:
    """Keep links whose trimmed URL contains a match of any expression.

    Expressions are RE2's, and take time linear in the URL.  Simple ones, such as
    ``.*\\.mp4$``, run in generated code; all others cross to the RE2 engine in Arrow
    batches, joined into one pattern.  A bad expression fails here, not in a running task.
    """
    if not expressions:
        return links.where(F.lit(False))
    for expression in expressions:
        try:
            pc.match_substring_regex(pa.array([""]), expression)
        except pa.ArrowInvalid as error:
            raise PySparkValueError(f"bad expression {expression!r}: {error}") from None
    url = trim_space(F.col("url"))
    native = [form for e in expressions if (form := _native_form(e)) is not None]
    other = [e for e in expressions if _native_form(e) is None]
    conditions = [url.rlike(form) for form in native]
    for i in range(0, len(other), _JOINED):
        conditions.append(_matches_linear(_linear_patterns(other[i : i + _JOINED]))(url))
    return links.where(_any_of(conditions))


def filename_as_title(links: DataFrame, trim_extension: bool = False) -> DataFrame:
    """Title becomes the file name of the URL, where there is one.  Drops nothing."""
    parts = parse_url(trim_space(F.col("url")))
    name = base_name(parts.path)
    has_name = parts.ok & (name != "") & (name != ".")
    new_title = trim_ext(name) if trim_extension else name
    return links.withColumn("title", F.when(has_name, new_title).otherwise(F.col("title")))


def expand_short_links(
    links: DataFrame,
    lookups: DataFrame,
    hosts: Sequence[str] = SHORT_LINK_HOSTS,
) -> DataFrame:
    """Put the file name into short file links, by a table ``(status_url, body)``.

    The first line of ``body`` is the name.  A short link without a name is
    dropped, and so is a URL that cannot be parsed; all others pass as they are.
    Rows that need no lookup get a join key of their own, so that they spread
    evenly if Spark has to shuffle for the join.
    """
    parts = parse_url(trim_space(F.col("url")))
    segments = F.split(F.btrim(parts.path, F.lit("/")), "/")
    file_id = F.when(F.size(segments) == 1, F.get(segments, 0)).when(
        (F.size(segments) == 2) & (F.get(segments, 0) == "file"), F.get(segments, 1)
    )
    base = F.concat(parts.scheme, F.lit("://"), parts.host, F.lit("/file/"), file_id, F.lit("/"))
    marked = (
        links.where(parts.ok)
        .withColumn("__base", F.when(parts.host.isin(*hosts), base))
        .withColumn(
            "__status",
            F.coalesce(
                F.concat("__base", F.lit("status")),
                F.concat(F.lit("-"), F.xxhash64("url").cast("string")),
            ),
        )
    )
    names = lookups.groupBy(F.col("status_url").alias("__status")).agg(
        F.min(first_line(F.col("body"))).alias("__name")
    )
    looked_up = marked.join(names, "__status", "left")
    return (
        looked_up.where(F.col("__base").isNull() | (F.col("__name") != ""))
        .withColumn("url", F.coalesce(F.concat("__base", "__name"), F.col("url")))
        .select(*links.columns)
    )


def flat_map_rows(
    rows: DataFrame,
    function: Callable[[dict], Iterable[dict]],
    schema: T.StructType | None = None,
) -> DataFrame:
    """A custom filter written row by row: return no, one or several rows.

    Prefer a ``DataFrame -> DataFrame`` function built from column expressions;
    this is for logic that has none.  Rows cross to Python in Arrow batches.
    """
    if schema is None:
        schema = rows.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [result for row in batch.to_pylist() for result in function(row)]
            if results:
                yield pa.RecordBatch.from_pylist(results, schema=arrow)

    return rows.mapInArrow(run, schema)


def filter_catalog(spark, item_filters: Sequence[dict], link_filters: Sequence[dict]) -> DataFrame:
    """The configured filters as a table ``(stage, seq, type, value)``, one row per value."""
    rows = []
    for stage, filters in (("item", item_filters), ("link", link_filters)):
        for seq, config in enumerate(filters):
            values = [
                str(value)
                for key, entry in config.items()
                if key != "type"
                for value in (entry if isinstance(entry, (list, tuple)) else [entry])
            ]
            rows += [(stage, seq, config["type"], value) for value in values or [""]]
    fields = [T.StructField(name, T.StringType()) for name in ("stage", "seq", "type", "value")]
    fields[1] = T.StructField("seq", T.IntegerType())
    return local_rows(spark, T.StructType(fields), rows)


def describe_filters(catalog: DataFrame) -> DataFrame:
    """One line of text per title rule: ``ITEM_TITLE:<title>``."""
    return catalog.where((F.col("stage") == "item") & (F.col("type") == "title")).select(
        "seq", F.format_string("ITEM_TITLE:%s\n", "value").alias("line")
    )
