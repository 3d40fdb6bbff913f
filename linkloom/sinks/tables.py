"""Item and link stores as catalog tables partitioned by the day of ``added``."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.operators.stores import new_rows, recent, retain
from linkloom.sinks.summaries import DAY, DaySummaries
from linkloom.workspace import stage

_DAY = DAY


class StoreTable:
    """A store behind a table name.

    The day partition serves age reads and cleanup: both touch only the days they
    need.  An insert is repeatable: URLs that are stored already are skipped, so a
    batch that is run again after a failure adds nothing twice.

    With ``buckets`` a new table is also bucketed by URL: an insert then compares a
    batch with the store without moving the store.

    With ``summaries`` the table keeps Bloom filters of each day's URLs beside it (below
    ``path``, which it then needs): an insert reads only the days that may hold a URL of the
    batch.  A table that exists is summarised when it is first opened so.
    """

    def __init__(
        self,
        spark: SparkSession,
        name: str,
        schema: T.StructType,
        path: str | None = None,
        buckets: int | None = None,
        summaries: bool = False,
    ) -> None:
        self.spark = spark
        self.name = name
        self.columns = schema.fieldNames()
        self.buckets = buckets
        if summaries and not path:
            raise ValueError("a store with summaries needs a path")
        self.summaries = DaySummaries(spark, f"{name}_summaries", f"{path}-summaries") if summaries else None
        existed = spark.catalog.tableExists(name)
        if not existed:
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            location = f" LOCATION '{path}'" if path else ""
            clustering = f" CLUSTERED BY (url) INTO {buckets} BUCKETS" if buckets else ""
            spark.sql(
                f"CREATE TABLE {name} ({fields}, {_DAY} DATE) USING parquet"
                f" PARTITIONED BY ({_DAY}){clustering}{location}"
            )

        if existed and summaries and self.summaries.read().isEmpty():
            for day in self._days():
                self.summaries.add(self.read_days([day]).select("url"), date.fromisoformat(day))

    def _table(self) -> DataFrame:
        # Other sessions write too: a stream inserts through a session of its own.
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        return self._table().select(*self.columns)

    def _days(self) -> list[str]:
        return [r["partition"].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]

    def days_to_compare(self, batch: DataFrame) -> list[str]:
        """The days an insert of ``batch`` has to read."""
        days = self._days()
        if self.summaries is None:
            return days
        known = {r[0].isoformat() for r in self.summaries.read().select(_DAY).distinct().collect()}
        hit = {day.isoformat() for day in self.summaries.may_hold(batch.select("url"))}
        return [day for day in days if day in hit or day not in known]

    def read_days(self, days: Sequence[str]) -> DataFrame:
        return self._table().where(F.col(_DAY).cast("string").isin(*days)).select(*self.columns)

    def insert_absent(self, batch: DataFrame, order: Sequence[str], as_of: datetime) -> None:
        store = self.read() if self.summaries is None else self.read_days(self.days_to_compare(batch))
        fresh = new_rows(batch, store, order).withColumn("added", F.lit(as_of))
        if self.summaries is not None:
            fresh = stage(fresh, "fresh")
            self.summaries.add(fresh.select("url"), as_of.date())
        if self.buckets:
            # One file per bucket, not one per bucket and task.
            fresh = fresh.repartition(self.buckets, "url")
        fresh.select(*self.columns, F.lit(as_of.date()).alias(_DAY)).write.insertInto(self.name)

    def recent(self, max_age: timedelta, as_of: datetime) -> DataFrame:
        first_day = (as_of - max_age).date()
        table = self._table().where(F.col(_DAY) >= F.lit(first_day))
        return recent(table, max_age, as_of).select(*self.columns)

    def cleanup(self, max_age: timedelta, as_of: datetime) -> None:
        """Drop the days before the cutoff, rewrite the day of the cutoff."""
        cutoff = as_of - max_age
        for day in self._days():
            if day < cutoff.date().isoformat():
                self.spark.sql(
                    f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({_DAY} = DATE '{day}')"
                )
                if self.summaries is not None:
                    self.summaries.drop(day)
        boundary = self._table().where(F.col(_DAY) == F.lit(cutoff.date()))
        # Staged, since a partition cannot be overwritten while it is being read.
        kept = stage(retain(boundary, max_age, as_of).select(*self.columns), "cleanup")
        day = f"PARTITION ({_DAY} = DATE '{cutoff.date().isoformat()}')"
        if kept.isEmpty():
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {day}")
        else:
            self.spark.sql(
                f"INSERT OVERWRITE TABLE {self.name} {day} SELECT * FROM {{kept}}", kept=kept
            )
