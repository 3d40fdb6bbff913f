"""Endless ingest: keyed state, insert-if-absent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkloom.operators.link_filters import Step
from linkloom.operators.schedule import attempt_state
from linkloom.operators.stores import CLEANUP_MAX_AGE
from linkloom.operators.window_dedup import MAX_SEQUENCE_ROWS, Memory, continue_window_dedup
from linkloom.plans.collect import collect_links
from linkloom.sinks.tables import StoreTable
from linkloom.workspace import stage


def stream_attempt_state(log: DataFrame) -> DataFrame:
    """Running attempt state; write it in update mode, see :func:`write_updates`."""
    return attempt_state(log)


def stream_first_seen(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    """First row per URL, forgotten once the watermark passes ``ts + delay``.

    The state store drops old URLs by itself.  Expiry follows the watermark and
    moves between micro-batches only, so its instant differs from that of
    :func:`~linkloom.operators.first_wins.first_seen_ttl`, which follows the clock.
    """
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url"])


def stream_window_dedup(
    rows: DataFrame, size: int, order_by: Sequence[str], partition_by: Sequence[str]
) -> DataFrame:
    """Sliding-window duplicate filter with the memory in the state store.

    State per sequence is at most ``size`` URLs.  Rows of one trigger are put in
    order within their sequence, so a trigger must be bounded at the source
    (``maxFilesPerTrigger`` and the like), and sequences must arrive in order
    from one trigger to the next.  This form is for many sequences; where one of
    them may hold much of a trigger, use :func:`stream_window_dedup_table`.
    """
    size = max(size, 1)
    columns = rows.columns
    order = list(order_by)

    def fold(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        memory = Memory(size, state.get[0] if state.exists else ())
        batch = pd.concat(list(batches)).sort_values(order, kind="stable")
        kept = batch[[memory.admit(url) for url in batch["url"]]]
        state.update((list(memory.queue),))
        yield kept[columns]

    return rows.groupBy(*partition_by).applyInPandasWithState(
        fold,
        outputStructType=rows.schema,
        stateStructType="urls array<string>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def stream_window_dedup_table(
    rows: DataFrame,
    path: str,
    size: int,
    order_by: Sequence[str],
    partition_by: Sequence[str],
    checkpoint: str,
    max_sequence_rows: int = MAX_SEQUENCE_ROWS,
    available_now: bool = True,
) -> StreamingQuery:
    """Sliding-window duplicate filter for few but long sequences.

    Each micro-batch runs the batch operator, which cuts a long sequence over many
    tasks, and goes on from the memories the batch before left.  Accepted rows go to
    ``path/rows/batch=N``.  A batch that is run again reads the same memories and
    overwrites its own output.
    """
    spark = rows.sparkSession

    def fold(batch: DataFrame, batch_id: int) -> None:
        before = None
        if batch_id > 0:
            before = spark.read.parquet(f"{path}/memory/batch={batch_id - 1}")
        accepted, memories = continue_window_dedup(
            batch, before, size, order_by, partition_by, max_sequence_rows
        )
        accepted.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        memories.write.mode("overwrite").parquet(f"{path}/memory/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_into_store(
    links: DataFrame,
    store: StoreTable,
    order: Sequence[str],
    checkpoint: str,
    clock: Callable[[int], datetime],
    steps: Sequence[Callable[[DataFrame], DataFrame]] = (),
    available_now: bool = True,
    processing_time: str = "1 minute",
) -> StreamingQuery:
    """Feed a stream into an insert-if-absent store.

    Each micro-batch runs ``steps`` and inserts what the store lacks, stamped
    ``clock(batch_id)``.  A batch that is run again after a failure inserts
    nothing twice, since its URLs are found in the store.
    """

    def insert(batch: DataFrame, batch_id: int) -> None:
        for step in steps:
            batch = step(batch)
        store.insert_absent(batch, order, clock(batch_id))

    writer = links.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=processing_time).start()


def write_updates(
    updates: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write the changed rows of each micro-batch below ``path``, once per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = (
        updates.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last written row of each key."""
    rows = spark.read.parquet(path)
    rest = [column for column in rows.columns if column not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*")


def stream_collect_links(
    items: DataFrame,
    pages: DataFrame | Callable[[int], DataFrame],
    item_store: StoreTable,
    link_store: StoreTable,
    item_steps: Sequence[Step],
    link_steps: Sequence[Step],
    item_order: Sequence[str],
    checkpoint: str,
    clock: Callable[[int], datetime],
    available_now: bool = True,
    processing_time: str = "1 minute",
    scanned_store: StoreTable | None = None,
    max_age: timedelta = CLEANUP_MAX_AGE,
) -> StreamingQuery:
    """Items as they arrive, through both filter chains, into both stores.

    ``pages`` is a table, or a function of the batch number that gives the pages at
    hand then.  With ``scanned_store`` (columns ``url, added``) each batch also scans the
    pages of earlier items younger than ``max_age`` that have come since.

    Links are stored first, then the pages they come from, then the items: if a batch
    breaks off in between, the rest counts as new when it is run again.  What a batch
    found is written once, and inserted from there.
    """

    def collect(batch: DataFrame, batch_id: int) -> None:
        as_of = clock(batch_id)
        scanned = scanned_store.read() if scanned_store is not None else None
        collected = collect_links(
            batch, pages(batch_id) if callable(pages) else pages, item_store.read(), link_store.read(),
            item_steps, link_steps, as_of, item_order, scanned=scanned, max_age=max_age,
        )
        parts = [(link_store, collected.links, "title"), (item_store, collected.items, "title")]
        if scanned_store is not None:
            parts.insert(1, (scanned_store, collected.scanned, "url"))
        # All parts before any insert: the stores they were made from must not move.
        parts = [(store, stage(rows, "collected"), order) for store, rows, order in parts]
        for store, rows, order in parts:
            store.insert_absent(rows, [order], as_of)

    writer = items.writeStream.foreachBatch(collect).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=processing_time).start()
