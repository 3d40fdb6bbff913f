"""The output feed as a data source writer: one document, put in place as a whole."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from uuid import uuid4

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from linkloom.sinks.feed import feed_frame, feed_item_xml

FORMAT = "linkloom_feed"


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    path: str


class _FeedWriter(DataSourceWriter):
    """Parts beside the document, then one file that takes its place."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        if not overwrite:
            raise ValueError("a feed is published as a whole: use mode('overwrite')")
        self.path, self.head, self.tail = options["path"].removeprefix("file://"), options["head"], options["tail"]
        self.parts = f"{self.path}.parts-{uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        context = TaskContext.get()
        os.makedirs(self.parts, exist_ok=True)
        # Attempts of one task write to files of their own; the one that succeeds is named in its message.
        path = os.path.join(self.parts, f"{context.partitionId()}-{context.taskAttemptId()}")
        with open(path, "w", encoding="utf-8", newline="\n") as file:
            for row in iterator:
                file.write(row[0] + "\n")
        return _Part(context.partitionId(), path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Join the parts in order, a block at a time, and move the document to its place."""
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        new = f"{self.path}.new-{uuid4().hex}"
        with open(new, "wb") as document:
            document.write(self.head.encode() + b"\n")
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                with open(part.path, "rb") as file:
                    shutil.copyfileobj(file, document, 1 << 20)
            document.write(self.tail.encode() + b"\n")
            document.flush()
            os.fsync(document.fileno())
        os.replace(new, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class FeedDocument(DataSource):
    """``df.write.format("linkloom_feed")``: rows of item text between ``head`` and ``tail``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FeedWriter({key.lower(): value for key, value in dict(self.options).items()}, overwrite)


def publish_feed(
    items: DataFrame,
    path: str,
    as_of: datetime,
    title: str = "links",
    description: str = "recent links",
) -> None:
    """Write the feed to the file ``path`` in URL order: readers see the old document or the new one.

    Tasks write their parts beside it; the driver joins them block by block and renames.  A run
    that fails leaves the old document and nothing else.  ``path`` is in a folder that the driver
    and all executors share.
    """
    spark: SparkSession = items.sparkSession
    spark.dataSource.register(FeedDocument)
    head, tail = feed_frame(spark, title, description, as_of)
    (
        items.orderBy("url")
        .select(feed_item_xml().alias("value"))
        .write.format(FORMAT)
        .mode("overwrite")
        .options(path=path, head=head, tail=tail)
        .save()
    )
