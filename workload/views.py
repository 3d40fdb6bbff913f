"""Inputs derived from the given tables.

``VIEWS`` holds SQL that both Spark and DuckDB run as it stands; ``{name}`` stands
for a table or another view.  Spark binds DataFrames, DuckDB gets sub-queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.workspace import BATCH_BYTES, scratch_path

VIEWS = {
    # Feed entries: one per page.
    "v_items": """
        SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url,
               TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' MINUTE AS pub_date
        FROM {pages}""",
    # Page sources that mention their own address in running text.
    "v_text": """
        SELECT page_id, url, concat(html, ' ', url, ' (', url, ')') AS html FROM {pages}""",
    # Pages with references, values without quotes and ends that are left out.
    "v_loose_pages": """
        SELECT page_id, url, concat('<table><tr><td><a href=/p', page_id, '>caf&eacute; &#233;<td><a href=''/q',
               page_id, '?a=1&amp;b=2''>two &amp; a half</a></table>', html) AS html FROM {pages}""",
    # Pages with absolute addresses: bare values, references, quotes in text, left-over tags, text in a table.
    "v_loose_urls": """
        SELECT page_id, url, concat('<div><a href=http://e.com/u', page_id, '>plain</a><a href="http://e.com/caf&eacute;',
               page_id, '?a=1&#38;b=2">ref</a> said "http://q.com/', page_id, '"! and http://r.com/', page_id,
               '</nope>x<!-- http://c.com/', page_id, ' --><script>var a="http://s.com/', page_id,
               '";</script><table>http://f.com/', page_id, '<tr><td>http://t.com/', page_id, '</table></div>', html) AS html
        FROM {pages}""",
    # Links as they arrive: few URLs per host, many repeats.
    "v_stream": """
        SELECT event_id AS ord, ts, concat('h', user_id % 20) AS host,
               concat('http://h', user_id % 20, '.example.com/', event_type, '/', user_id % 7)
                   AS url,
               concat(event_type, ' ', event_id) AS title
        FROM {events}""",
    # Links as they arrive: many URLs, some repeats.
    "v_visits": """
        SELECT event_id AS ord, ts,
               concat('http://h', user_id % 20, '.example.com/', event_type, '/', user_id, '/',
                      hour(ts)) AS url,
               concat(event_type, ' ', event_id) AS title
        FROM {events}""",
    # Fetch attempts.
    "v_attempts": """
        SELECT concat('http://h', user_id, '.example.com/', event_type, '/', day(ts) % 4) AS url,
               ts
        FROM {events}""",
    # Short links, media files and pages in one stream.
    "v_mixed": """
        SELECT event_id AS ord, event_type AS title,
               CASE user_id % 4
                   WHEN 0 THEN concat('http://ul.to/f', user_id)
                   WHEN 1 THEN concat(' http://uploaded.net/file/f', user_id, '/')
                   WHEN 2 THEN concat('http://h', user_id % 20, '.example.com:80/', event_type,
                                      '/clip', user_id, '.mkv')
                   ELSE concat('http://h', user_id % 20, '.example.com/', event_type, '/',
                               user_id, '.html?x=1')
               END AS url
        FROM {events}""",
    # What the status addresses of short links answered: a name, no name, or another address.
    "v_lookups": """
        SELECT DISTINCT
               concat(CASE user_id % 4 WHEN 0 THEN 'http://ul.to' ELSE 'http://uploaded.net' END,
                      CASE user_id % 3 WHEN 0 THEN '/gone/f' ELSE '/file/f' END,
                      user_id, '/status') AS status_url,
               CASE user_id % 3 WHEN 1 THEN concat('movie', user_id, '.mkv', chr(10), '198 KB')
                                ELSE concat('', chr(10), '0 KB') END AS body
        FROM {events}""",
    # Well-formed and malformed addresses.
    "v_urls": """
        SELECT page_id, CASE page_id % 14
                   WHEN 0 THEN url
                   WHEN 1 THEN concat(':', url)
                   WHEN 2 THEN concat(url, '%zz')
                   WHEN 3 THEN replace(url, '://', '://user:pw@')
                   WHEN 4 THEN replace(url, 'example', 'exam ple')
                   WHEN 5 THEN replace(url, '.com/', '.com:8080/')
                   WHEN 6 THEN replace(replace(url, '.com/', '.com:80x/'), '.org/', '.org:80x/')
                   WHEN 7 THEN concat(url, '/a%20b+c.tar.gz')
                   WHEN 8 THEN concat('12:', page_id, '/x')
                   WHEN 9 THEN concat('mailto:someone', page_id, '@example.com')
                   WHEN 10 THEN concat('//h', page_id, '.example.com/p')
                   WHEN 11 THEN concat('/only/path/', page_id, '.html')
                   WHEN 12 THEN concat('http://[::1]:8/x', page_id)
                   ELSE concat(url, '#frag%4')
               END AS url
        FROM {pages}""",
    # Follow addresses: each page leads to two further ones, if they exist.
    "v_follow": """
        SELECT a.url AS src, b.url AS dst
        FROM {pages} a JOIN {pages} b ON b.page_id = a.page_id * 2 + 1
        UNION ALL
        SELECT a.url AS src, b.url AS dst
        FROM {pages} a JOIN {pages} b ON b.page_id = a.page_id * 2 + 2""",
    # Pages that ask for others: the next two, the one they were asked for by, some that do not exist.
    "v_asking": """
        SELECT p.page_id, p.url, concat(
                   coalesce('<a rel=next href="' || a.url || '">a</a>', ''),
                   coalesce('<a rel="next" href="' || b.url || '">b</a>', ''),
                   coalesce('<a href="' || c.url || '" rel=next>c</a>', ''),
                   CASE WHEN p.page_id % 7 = 0 THEN concat('<a rel=next href="http://no.such/', p.page_id % 5, '">d</a>')
                        ELSE '' END, p.html) AS html
        FROM {pages} p LEFT JOIN {pages} a ON a.page_id = 2 * p.page_id + 1
        LEFT JOIN {pages} b ON b.page_id = 2 * p.page_id + 2
        LEFT JOIN {pages} c ON p.page_id > 0 AND c.page_id = (p.page_id - 1 - (p.page_id - 1) % 2) / 2""",
    # Title rules: the first two words of each document.
    "v_rules": """
        SELECT page_id AS doc_id, title FROM {v_items}""",
    # Ten title rules for each document: two of its words.
    "v_many_rules": """
        SELECT title FROM (
            SELECT concat(split_part(text, ' ', k), ' ', split_part(text, ' ', k + 3)) AS title,
                   split_part(text, ' ', k) AS a, split_part(text, ' ', k + 3) AS b
            FROM {documents} CROSS JOIN (SELECT CAST(page_id + 1 AS INT) AS k FROM {pages} WHERE page_id < 10) AS n) AS w
        WHERE lower(a) <> upper(a) AND lower(b) <> upper(b)""",
    # Titles of pages, which all hold a rule, among names of parts.
    "v_titles": """
        SELECT page_id, title, url FROM {v_items}
        UNION ALL SELECT -p_partkey, p_name, concat('/part/', p_partkey) FROM {part}""",
    # Links stored before the second week of the stream.
    "v_link_store": """
        SELECT title, url, ts AS added FROM (
            SELECT title, url, ts, row_number() OVER (PARTITION BY url ORDER BY ord) AS rn
            FROM {v_visits} WHERE ts < TIMESTAMP '2024-01-08 00:00:00') AS x
        WHERE rn = 1""",
    # Links that arrive from then on.
    "v_link_batch": """
        SELECT ord, ts, title, url FROM {v_visits} WHERE ts >= TIMESTAMP '2024-01-08 00:00:00'""",
}

_NAME = re.compile(r"\{(\w+)\}")


def oracle(sql: str) -> str:
    """``sql`` with every view written out as a sub-query, for DuckDB."""

    def inline(match: re.Match) -> str:
        name = match.group(1)
        return f"({oracle(VIEWS[name])}\n)" if name in VIEWS else name

    return _NAME.sub(inline, sql)


class Tables:
    """The given tables and the views over them, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set(*BATCH_BYTES)
        self.spark = spark
        self.sf_dir = sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # Parquet timestamps without a zone; all of them are UTC.
        for field in df.schema:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
        return df

    def sql(self, text: str) -> DataFrame:
        names = set(_NAME.findall(text))
        return self.spark.sql(text, **{name: self[name] for name in names})

    def stream(self, name: str) -> DataFrame:
        """A given table as a stream of files."""
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        df = (
            self.spark.readStream.schema(schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(self.sf_dir)
        )
        for field in schema:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
        return df

    def arriving(self, name: str, key: str, parts: int = 3) -> DataFrame:
        """A given table as a stream of ``parts`` files by ranges of ``key``, one in each micro-batch."""
        return self.files_of(self[name], key, parts)

    def files_of(self, table: DataFrame, key: str, parts: int = 3, then: list[DataFrame] = ()) -> DataFrame:
        """Any rows as a stream of ``parts`` files by ranges of ``key``, then one file for each of ``then``."""
        path = scratch_path(self.spark, "arriving")
        low, high = table.agg(F.min(key), F.max(key)).first()
        step = (high - low) // parts + 1
        cuts = [
            table.where((F.col(key) >= low + part * step) & (F.col(key) < low + (part + 1) * step))
            for part in range(parts)
        ]
        for rows in [*cuts, *then]:
            rows.coalesce(1).write.mode("append").parquet(path)
        return self.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
