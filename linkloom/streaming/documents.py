"""Feed documents as they are fetched, to stored links, with several sinks for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators.link_filters import Step
from linkloom.operators.stores import CLEANUP_MAX_AGE
from linkloom.plans.documents import collect_documents
from linkloom.sinks.tables import StoreTable

Sink = Callable[[DataFrame, datetime, int], None]

_COMMIT = "batch long, step string"


class BatchCommits:
    """Which steps of which micro-batch are done: a small table beside the results."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._append([])

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").parquet(self.path)

    def done(self, batch_id: int) -> set[str]:
        rows = self.spark.read.schema(_COMMIT).parquet(self.path).where(f"batch = {batch_id}")
        return {r["step"] for r in rows.collect()}

    def mark(self, batch_id: int, step: str) -> None:
        self._append([(batch_id, step)])


def store_sinks(
    link_store: StoreTable, scanned_store: StoreTable, item_store: StoreTable, failures: str
) -> dict[str, Sink]:
    """The sinks of a run in their order: links, then the pages they are from, items, failures.

    What breaks off in between is found to be new again.  Failures of a batch are a folder of
    ``failures``, written anew when the batch is.
    """
    return {
        "links": lambda rows, as_of, _: link_store.insert_absent(rows, ["title"], as_of),
        "scanned": lambda rows, as_of, _: scanned_store.insert_absent(rows, ["url"], as_of),
        "items": lambda rows, as_of, _: item_store.insert_absent(rows, ["title"], as_of),
        "failures": lambda rows, _, batch: rows.write.mode("overwrite").parquet(f"{failures}/batch={batch}"),
    }


def stream_documents_to_links(
    fetched_feeds: DataFrame,
    fetched_pages: DataFrame | Callable[[int], DataFrame],
    item_store: StoreTable,
    link_store: StoreTable,
    scanned_store: StoreTable,
    item_steps: Sequence[Step],
    link_steps: Sequence[Step],
    sinks: Mapping[str, Sink],
    path: str,
    checkpoint: str,
    clock: Callable[[int], datetime],
    max_age: timedelta = CLEANUP_MAX_AGE,
    available_now: bool = True,
    processing_time: str = "1 minute",
) -> StreamingQuery:
    """A stream of fetched feed documents into several sinks, each of them once per micro-batch.

    ``fetched_pages`` are the page payloads at hand, or a function of the batch number.  Pages
    of items whose payload comes later are scanned by a later batch.

    What a micro-batch found is written below ``path`` before any sink is touched, and each sink
    is marked when it has taken its part.  A batch that is run again after a failure takes the
    written parts, since the stores they were made from have moved, and leaves marked sinks alone.
    ``sinks`` takes ``links``, ``scanned``, ``items``, ``failures`` or some of them, in the order given,
    see :func:`store_sinks`.
    """
    spark = fetched_feeds.sparkSession
    commits = BatchCommits(spark, f"{path}/commits")

    def run(batch: DataFrame, batch_id: int) -> None:
        as_of = clock(batch_id)
        parts = f"{path}/parts/batch={batch_id}"
        done = commits.done(batch_id)
        if "parts" not in done:
            found = collect_documents(
                batch.select("url"),
                batch,
                fetched_pages(batch_id) if callable(fetched_pages) else fetched_pages,
                item_store.read(),
                link_store.read(),
                item_steps,
                link_steps,
                as_of,
                scanned=scanned_store.read(),
                max_age=max_age,
                report_missing_pages=False,
            )
            for name in sinks:
                getattr(found, name).write.mode("overwrite").parquet(f"{parts}/{name}")
            commits.mark(batch_id, "parts")
        for name, sink in sinks.items():
            if name not in done:
                sink(spark.read.parquet(f"{parts}/{name}"), as_of, batch_id)
                commits.mark(batch_id, name)

    writer = fetched_feeds.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=processing_time).start()
