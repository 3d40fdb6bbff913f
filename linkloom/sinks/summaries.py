"""Which days of a store may hold a URL: Bloom filters per day, as a table."""

from __future__ import annotations

from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "added_day"
#: Parts of each filter; every part is made and asked in a task of its own.
_SEGMENTS = 64
_BITS_PER_URL, _PROBES = 32, 12


def _hashed(urls: DataFrame) -> DataFrame:
    """``segment, h``: two independent hashes of each URL."""
    return urls.select(
        F.pmod(F.xxhash64("url"), F.lit(_SEGMENTS)).cast("int").alias("segment"),
        F.xxhash64(F.lit("summary"), "url").alias("h"),
    )


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each URL: an arithmetic progression from its hash."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        places = h[:, None] + step[:, None] * np.arange(1, _PROBES + 1, dtype=np.uint64)
    return (places & np.uint64(bits - 1)).astype(np.int64)


def _bits(table: pa.Table) -> pa.Table:
    hashes = np.unique(table["h"].to_numpy())
    size = 1 << max(10, int(len(hashes) * _BITS_PER_URL - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_places(hashes, size).ravel()] = True
    return pa.table({"segment": table["segment"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


class DaySummaries:
    """Bloom filters of the URLs of each day: a table with a row for each insert and segment.

    A filter has at least 32 bits for each URL of its insert, so fewer than one URL in a
    million is taken for one that is there.  Segments are cut by the URL's hash: a task
    holds a 64th of the hashes of an insert or a batch, and a 64th of the days' filters.
    """

    def __init__(self, spark: SparkSession, name: str, path: str) -> None:
        self.spark, self.name = spark, name
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (segment INT, bits BINARY, {DAY} DATE) USING parquet"
            f" PARTITIONED BY ({DAY}) LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, urls: DataFrame, day: date) -> None:
        """Note the URLs of an insert.  Do so before it: a summary may know too much, never too little."""
        filters = _hashed(urls).groupBy("segment").applyInArrow(_bits, "segment int, bits binary")
        filters.withColumn(DAY, F.lit(day)).write.insertInto(self.name)

    def may_hold(self, batch: DataFrame) -> list[date]:
        """The days that may hold a URL of the batch; the days a store keeps bound them."""

        def ask(hashes: pa.Table, filters: pa.Table) -> pa.Table:
            hit = set()
            if hashes.num_rows:
                own = hashes["h"].to_numpy()
                for bits, day in zip(filters["bits"], filters[DAY]):
                    if day not in hit:
                        packed = np.frombuffer(bits.as_py(), np.uint8)
                        places = _places(own, 8 * len(packed))
                        there = packed[places >> 3] >> (7 - (places & 7)) & 1
                        if there.all(axis=1).any():
                            hit.add(day)
            return pa.table({DAY: pa.array([d.as_py() for d in hit], pa.date32())})

        hashes = _hashed(batch).distinct()
        found = hashes.groupBy("segment").cogroup(self.read().groupBy("segment")).applyInArrow(ask, f"{DAY} date")
        return sorted(r[DAY] for r in found.distinct().collect())

    def drop(self, day: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({DAY} = DATE '{day}')")
