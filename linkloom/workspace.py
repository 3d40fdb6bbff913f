"""Sessions and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Bytes of a batch that goes to a Python worker.  A batch of pages is held several times over, as
#: source, as text and as what was found, and each core of an executor has up to two workers.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("linkloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config(*BATCH_BYTES)
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder the cluster names for checkpoints.

    Only a local session may fall back to a folder of its own, which goes when the
    driver ends: on a cluster the executors would each see a different one.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="linkloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set(CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/linkloom/{label}-{uuid.uuid4().hex}"


def local_rows(spark: SparkSession, schema: T.StructType, rows: list[tuple] = ()) -> DataFrame:
    """A few rows as a local relation: Catalyst sees them, and no job is needed for them."""
    names = schema.fieldNames()
    arrow = to_arrow_schema(schema)
    table = pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=arrow)
    return spark.createDataFrame(table, schema)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return the written table.

    The result no longer depends on the plan behind ``df``: it survives lost
    executors, is read with column pruning, and gives every later job the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
