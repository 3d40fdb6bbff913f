"""Sources of one's own: resources by key, read as a table or as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: The keys at hand, oldest first; later calls give the same keys and may give more.
ListKeys = Callable[[dict[str, str]], Sequence[str]]
#: The fetch results ``(url, status, content_type, body)`` behind one key.
GetResource = Callable[[str, dict[str, str]], Iterable[tuple]]

_SCHEMA = "url string, status int, content_type string, body binary"


class _Keys(InputPartition):
    def __init__(self, keys: list[str]) -> None:
        super().__init__(tuple(keys))
        self.keys = keys


def _dealt(keys: Sequence[str], options: dict[str, str]) -> list[InputPartition]:
    size = max(1, int(options.get("keysperpartition", "16")))
    return [_Keys(list(keys[i : i + size])) for i in range(0, len(keys), size)]


def register_source(spark: SparkSession, name: str, list_keys: ListKeys, get: GetResource) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read these resources.

    ``list_keys(options)`` runs on the driver and gives names only; ``get(key, options)`` runs
    in the tasks, one partition for each ``keysPerPartition`` keys (16), and yields fetch results.
    A resource that cannot be had is a row with its status, not an error.

    As a stream, an offset is the number of keys read.  A micro-batch takes the keys that have come
    since the last one; a query that starts again from its checkpoint goes on behind the last
    offset it has finished.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]) -> None:
            self.options = options

        def partitions(self) -> list[InputPartition]:
            return _dealt(list_keys(self.options), self.options)

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for key in partition.keys if partition is not None else ():
                yield from get(key, self.options)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]) -> None:
            self.options = options

        def initialOffset(self) -> dict:
            return {"keys": 0}

        def latestOffset(self) -> dict:
            return {"keys": len(list_keys(self.options))}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return _dealt(list_keys(self.options)[start["keys"] : end["keys"]], self.options)

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for key in partition.keys:
                yield from get(key, self.options)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return _SCHEMA

        def _options(self) -> dict[str, str]:
            return {key.lower(): value for key, value in dict(self.options).items()}

        def reader(self, schema) -> DataSourceReader:
            return Reader(self._options())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(self._options())

    spark.dataSource.register(Source)


def row_groups(options: dict[str, str]) -> list[str]:
    """Keys of a folder's parquet files that Python can open, one for each row group."""
    from pathlib import Path

    import pyarrow.parquet as pq

    root = Path(options["path"])
    files = [root] if root.is_file() else sorted(root.glob("*.parquet"))
    return [json.dumps([str(f), i]) for f in files for i in range(pq.ParquetFile(f).num_row_groups)]


def row_group_pages(key: str, options: dict[str, str]) -> Iterator[tuple]:
    """The pages ``(url, html)`` of one row group as successful fetch results."""
    import pyarrow.parquet as pq

    path, group = json.loads(key)
    for batch in pq.ParquetFile(path).iter_batches(row_groups=[group], columns=["url", "html"]):
        for url, html in zip(*(c.to_pylist() for c in batch.columns)):
            yield url, 200, "text/html; charset=utf-8", (html or "").encode()
