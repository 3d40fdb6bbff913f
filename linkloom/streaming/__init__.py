"""Structured Streaming forms of the stateful operators."""

from linkloom.streaming.documents import BatchCommits, store_sinks, stream_documents_to_links
from linkloom.streaming.ingest import (
    read_latest,
    stream_attempt_state,
    stream_collect_links,
    stream_first_seen,
    stream_into_store,
    stream_window_dedup,
    stream_window_dedup_table,
    write_updates,
)
from linkloom.streaming.timers import (
    fibonacci_waits,
    periodic_waits,
    remembered_urls,
    stream_due_urls,
    stream_first_seen_exact,
    timed_state,
)

__all__ = [
    "BatchCommits",
    "fibonacci_waits",
    "periodic_waits",
    "read_latest",
    "remembered_urls",
    "store_sinks",
    "stream_attempt_state",
    "stream_collect_links",
    "stream_documents_to_links",
    "stream_due_urls",
    "stream_first_seen",
    "stream_first_seen_exact",
    "stream_into_store",
    "stream_window_dedup",
    "stream_window_dedup_table",
    "timed_state",
    "write_updates",
]
