"""Sliding-window duplicate filter.

The filter remembers the last ``size`` URLs it *accepted*.  A row whose URL is
remembered is dropped, and does not refresh it; any other row is accepted and
pushes out the oldest.  Whether a row is accepted thus depends on all decisions
before it in its sequence.

Sequences (``partition_by``, such as a feed or a host) are independent.  One task
reads a sequence in order and keeps ``size`` URLs in memory, never the rows.

A sequence too long for one task is cut into consecutive chunks, which are folded
in parallel from an assumed memory:

1.  Each chunk is folded from an empty memory.  That gives its memory at the end,
    and the distinct URLs it holds if these are few.
2.  A relay walks the chunks' summaries in order and hands each chunk the memory
    its predecessor ends with.  The end of a chunk is known if it was folded from
    that very memory before, or if its distinct URLs decide it; otherwise the
    relay goes on with the last result as a guess and marks the chunk.
3.  Marked chunks are folded again from the memory they were handed.  Steps 2 and 3
    repeat until nothing is marked.

Then every chunk has been handed the true memory, by induction from the first.
Each round settles at least one more chunk, and a chunk that sees ``size`` new URLs
forgets what came before it, so that two rounds are usual.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.workspace import stage

# Longer sequences are cut into chunks of about this many rows.
MAX_SEQUENCE_ROWS = 1_000_000

# A row with a place is not a row of the input but an entry of the memory to start from.
_SEQ, _CHUNK, _PLACE = "__seq", "__chunk", "__place"
_URLS = pa.list_(pa.string())
_RUNS = f"{_SEQ} string, {_CHUNK} long, start array<string>, end array<string>, urls array<string>"
_HANDED = f"{_SEQ} string, {_CHUNK} long, start array<string>, known boolean"


class Memory:
    """The last ``size`` accepted URLs, oldest first."""

    def __init__(self, size: int, urls: Iterable[str] = ()) -> None:
        self.size = size
        self.queue = deque(urls)
        self.known = set(self.queue)
        self.evicted: str | None = None

    def admit(self, url: str) -> bool:
        self.evicted = None
        if url in self.known:
            return False
        self.queue.append(url)
        self.known.add(url)
        if len(self.queue) > self.size:
            self.evicted = self.queue.popleft()
            self.known.discard(self.evicted)
        return True


def _values(column: pa.Array) -> list:
    """Python values, by way of numpy: several times faster than to_pylist()."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _fold(rows: DataFrame, order: Sequence[str], size: int, starts: DataFrame | None, ends: bool):
    """Fold every (sequence, chunk) in order, from its row in ``starts`` or from nothing.

    Gives the accepted rows, or with ``ends`` one summary row per chunk.  The sort
    spills to disk; the task holds one batch and one memory.
    """
    keyed = rows.withColumn(_PLACE, F.lit(None).cast("int"))
    if starts is not None:
        keyed = keyed.unionByName(
            starts.select(_SEQ, _CHUNK, F.posexplode("start").alias(_PLACE, "url")),
            allowMissingColumns=True,
        )
    # The memory comes before the rows of its chunk.
    ordered = keyed.repartition(_SEQ, _CHUNK).sortWithinPartitions(
        _SEQ, _CHUNK, F.col(_PLACE).isNull(), _PLACE, *order
    )

    def decide(batches: Iterator[pa.RecordBatch], summaries: list | None):
        current, memory, start, urls = None, Memory(size), [], {}
        for batch in batches:
            accepted = []
            for seq, chunk, url, given in zip(
                _values(batch.column(_SEQ)),
                _values(batch.column(_CHUNK)),
                _values(batch.column("url")),
                _values(batch.column(_PLACE).is_valid()),
            ):
                if (seq, chunk) != current:
                    if summaries is not None and current is not None:
                        summaries.append((*current, start, list(memory.queue), urls))
                    current, memory, start, urls = (seq, chunk), Memory(size), [], {}
                if given:
                    memory.admit(url)
                    start.append(url)
                    accepted.append(False)
                    continue
                accepted.append(memory.admit(url))
                if summaries is not None and urls is not None and url not in urls:
                    urls[url] = None
                    if len(urls) > size:
                        urls = None
            yield batch, accepted
        if summaries is not None and current is not None:
            summaries.append((*current, start, list(memory.queue), urls))

    if ends:

        def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: list = []

            def flush() -> pa.RecordBatch:
                seq, chunk, start, end, urls = zip(*done)
                done.clear()
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(seq, pa.string()),
                        pa.array(chunk, pa.int64()),
                        pa.array(start, _URLS),
                        pa.array(end, _URLS),
                        pa.array([None if u is None else list(u) for u in urls], _URLS),
                    ],
                    names=[_SEQ, _CHUNK, "start", "end", "urls"],
                )

            for _ in decide(batches, done):
                if done:
                    yield flush()
            if done:
                yield flush()

        narrow = ordered.select(_SEQ, _CHUNK, "url", _PLACE)
        return narrow.mapInArrow(summarise, _RUNS)

    schema = T.StructType([f for f in ordered.schema if f.name != _PLACE])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, accepted in decide(batches, None):
            kept = batch.filter(pa.array(accepted, pa.bool_()))
            if kept.num_rows:
                yield kept.select(schema.names)

    return ordered.mapInArrow(keep, schema)


def _after(memory: list[str], urls: list[str] | None, size: int) -> list[str] | None:
    """The memory after a chunk, if its distinct URLs in first-seen order decide it.

    They do unless one is pushed out after its first row: it might come again.
    """
    if urls is None:
        return None
    trial, passed = Memory(size, memory), set()
    for url in urls:
        trial.admit(url)
        passed.add(url)
        if trial.evicted in passed:
            return None
    return list(trial.queue)


def _relay(runs: DataFrame, size: int) -> DataFrame:
    """Hand each chunk the memory at its start, from the summaries in chunk order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, memory = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[_SEQ] != current:
                    # The start of a sequence's first chunk is given, never guessed.
                    current, memory = row[_SEQ], row["runs"][0]["start"]
                tried = {tuple(run["start"]): run["end"] for run in row["runs"]}
                end = tried.get(tuple(memory))
                if end is None:
                    end = _after(memory, row["urls"], size)
                out.append((current, row[_CHUNK], memory, end is not None))
                memory = end if end is not None else row["runs"][-1]["end"]
            seq, chunk, start, known = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seq, pa.string()),
                    pa.array(chunk, pa.int64()),
                    pa.array(start, _URLS),
                    pa.array(known, pa.bool_()),
                ],
                names=[_SEQ, _CHUNK, "start", "known"],
            )

    by_chunk = runs.groupBy(_SEQ, _CHUNK).agg(
        F.array_sort(F.collect_list(F.struct("round", "start", "end"))).alias("runs"),
        F.min("urls").alias("urls"),
    )
    ordered = by_chunk.repartition(_SEQ).sortWithinPartitions(_SEQ, _CHUNK)
    return ordered.mapInArrow(walk, _HANDED)


def _settle(rows: DataFrame, order: Sequence[str], size: int, starts: DataFrame | None) -> DataFrame:
    """The true memory at the start of each chunk of long sequences."""

    def run(part: DataFrame, given: DataFrame | None, number: int) -> DataFrame:
        folded = _fold(part, order, size, given, ends=True)
        return stage(folded.withColumn("round", F.lit(number)), "dedup-runs")

    number = 0
    first = None
    if starts is not None:
        heads = rows.groupBy(_SEQ).agg(F.min(_CHUNK).alias(_CHUNK))
        first = starts.select(_SEQ, "start").join(heads, _SEQ)
    runs = run(rows, first, number)
    while True:
        handed = stage(_relay(runs, size), "dedup-starts")
        open_chunks = handed.where(~F.col("known")).drop("known")
        if open_chunks.isEmpty():
            return handed.drop("known")
        number += 1
        again = rows.join(open_chunks.select(_SEQ, _CHUNK), [_SEQ, _CHUNK], "left_semi")
        runs = runs.unionByName(run(again, open_chunks, number))


def _sequence_key(partition_by: Sequence[str]) -> Column:
    return F.to_json(F.struct(*partition_by)) if partition_by else F.lit("")


def prepare(
    rows: DataFrame,
    size: int,
    order_by: Sequence[str],
    partition_by: Sequence[str],
    max_sequence_rows: int,
    starts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Rows keyed by (sequence, chunk), and the memory each chunk starts from."""
    # Counting, cutting and folding must see the same rows, and see them cheaply.
    keyed = stage(rows.withColumn(_SEQ, _sequence_key(partition_by)), "dedup-input")
    # The long sequences stay a table: their number grows with the rows.
    long = stage(
        keyed.groupBy(_SEQ).agg(F.count("*").alias("n")).where(F.col("n") > max_sequence_rows), "dedup-long"
    )
    total = long.agg(F.sum("n")).first()[0]
    whole = F.lit(0).cast("bigint")
    if starts is not None:
        starts = starts.withColumn(_CHUNK, whole)
    if not total:
        return keyed.withColumn(_CHUNK, whole), starts

    names = long.select(_SEQ)
    cut = stage(
        keyed.join(names, _SEQ, "left_semi")
        .repartitionByRange(-(-total // max_sequence_rows), _SEQ, *order_by)
        .withColumn(_CHUNK, F.spark_partition_id().cast("bigint")),
        "dedup-chunks",
    )
    long_starts = starts.join(names, _SEQ, "left_semi") if starts is not None else None
    settled = _settle(cut, order_by, size, long_starts)
    short = keyed.join(names, _SEQ, "left_anti").withColumn(_CHUNK, whole)
    if starts is not None:
        rest = starts.join(names, _SEQ, "left_anti")
        settled = settled.unionByName(rest.select(settled.columns))
    return short.unionByName(cut.select(short.columns)), settled


def drop_window_duplicates(
    rows: DataFrame,
    size: int,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    max_sequence_rows: int = MAX_SEQUENCE_ROWS,
) -> DataFrame:
    """Drop rows whose ``url`` is among the last ``size`` accepted of their sequence.

    ``order_by`` must order the rows of a sequence totally.  Without
    ``partition_by`` all rows are one sequence.  A ``size`` below 1 counts as 1.
    The input is written to the scratch folder once, when this is called.
    """
    size = max(size, 1)
    keyed, starts = prepare(rows, size, order_by, partition_by, max_sequence_rows)
    return _fold(keyed, order_by, size, starts, ends=False).select(*rows.columns)


def continue_window_dedup(
    rows: DataFrame,
    memories: DataFrame | None,
    size: int,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    max_sequence_rows: int = MAX_SEQUENCE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """:func:`drop_window_duplicates` for rows that follow earlier ones.

    ``memories`` is what the call for the earlier rows returned as its second
    result, ``None`` for the first call.  Returns the accepted rows and the memories
    of all sequences, seen now or before.
    """
    size = max(size, 1)
    if memories is not None:
        here = rows.select(_sequence_key(partition_by).alias(_SEQ)).distinct()
        current = memories.join(here, _SEQ, "left_semi")
    else:
        current = None
    keyed, starts = prepare(rows, size, order_by, partition_by, max_sequence_rows, current)
    accepted = _fold(keyed, order_by, size, starts, ends=False).select(*rows.columns)
    ends = stage(
        _fold(keyed, order_by, size, starts, ends=True)
        .groupBy(_SEQ)
        .agg(F.max_by("end", _CHUNK).alias("start")),
        "dedup-ends",
    )
    if memories is not None:
        ends = ends.unionByName(memories.join(ends.select(_SEQ), _SEQ, "left_anti"))
    return accepted, ends
