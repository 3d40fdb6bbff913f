"""Page scanners as table functions, for use from SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

from linkloom.sources.pages import EMISSION_KINDS, Scanner


def register_scanner(spark: SparkSession, name: str, scanner: Scanner) -> None:
    """Make a scanner a table function: ``SELECT * FROM name(TABLE(pages), 'page_id', 'url', 'html')``.

    The arguments after the table name its key, address and body columns (those in the example unless
    given).  The result has the key with its own type, then ``pos, kind, title, url`` as of
    :func:`~linkloom.sources.pages.scan_pages`.  Rows are partitioned by the key, so a page whose
    body comes in several rows is read by one task.
    """

    class Scan:
        def __init__(self) -> None:
            self.pos = 0
            self.key = None

        @staticmethod
        def analyze(
            pages: AnalyzeArgument,
            key: AnalyzeArgument | None = None,
            address: AnalyzeArgument | None = None,
            body: AnalyzeArgument | None = None,
        ) -> AnalyzeResult:
            if not pages.isTable:
                raise ValueError(f"{name} needs a table: {name}(TABLE(pages))")
            wanted = [a.value if a is not None else d for a, d in zip((key, address, body), ("page_id", "url", "html"))]
            for column in wanted:
                if column not in pages.dataType.fieldNames():
                    raise ValueError(f"{name}: the table has no column {column}")
            schema = T.StructType(
                [pages.dataType[wanted[0]]]
                + [
                    T.StructField("pos", T.IntegerType()),
                    T.StructField("kind", T.StringType()),
                    T.StructField("title", T.StringType()),
                    T.StructField("url", T.StringType()),
                ]
            )
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(wanted[0])])

        def eval(self, page, key="page_id", address="url", body="html") -> Iterator[tuple]:
            own = page[key]
            if own != self.key:
                self.key, self.pos = own, 0
            for kind, title, target in scanner(page[address], page[body] or ""):
                if kind not in EMISSION_KINDS:
                    raise ValueError(f"unknown emission kind: {kind}")
                yield own, self.pos, kind, title, target
                self.pos += 1

    spark.udtf.register(name, udtf(Scan))
