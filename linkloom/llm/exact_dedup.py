"""Exact dedup by a content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.workspace import stage

from .common import text_of

#: Characters that do not count for equality.
BLANKS = " \t\n\x0b\f\r"


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    sample_rows: int = 100_000,
    hot_rows: int = 100,
    salts: int = 256,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, n_chars``.

    Texts are equal when they are identical without :data:`BLANKS`.  The row with most
    code points stays, then the smallest id.

    Rows are range-partitioned by splitters that Spark samples (the first characters of
    the normalised text, then its hash), sorted externally by the whole normalised text,
    and compared in full with their neighbours by the window's group boundaries.  A text
    that makes up over ``hot_rows`` of ``sample_rows`` sampled rows, and so there are
    ``sample_rows / hot_rows`` at most, is cut into ``salts`` pieces that are sorted
    apart; only the pieces' heads meet again, by SHA-256.  The sample decides where to
    cut, never what is equal.

    Null and empty texts are equal to each other.  Null ids come last among ties.  Of
    repeated rows exactly one stays.  Other columns are not looked at; an empty table
    gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(text_of(text_col)).cast("long").alias("n_chars"),
        F.translate(text_of(text_col), BLANKS, "").alias("norm"),
    ).withColumn("print", F.xxhash64("norm"))

    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    hot = [
        r[0]
        for r in rows.sample(share, 7)
        .groupBy("print")
        .count()
        .filter(F.col("count") >= hot_rows)
        .orderBy(F.desc("count"))
        .limit(2 * sample_rows // hot_rows)
        .select("print")
        .collect()
    ]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    rows = rows.withColumn(
        "salt", F.when(F.col("print").isin(hot), salt).otherwise(F.lit(-1)) if hot else F.lit(-1)
    ).withColumn("head", F.substring("norm", 1, 24))
    best_first = [F.desc("n_chars"), F.asc_nulls_last("doc_id")]
    equal = W.partitionBy("head", "print", "salt", "norm").orderBy(*best_first)
    whole = equal.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sorted_rows = stage(
        rows.repartitionByRange("head", "print", "salt").select(
            "doc_id",
            "n_chars",
            "salt",
            F.sha2("norm", 256).alias("text_sha256"),
            F.row_number().over(equal).alias("place"),
            F.first("doc_id").over(whole).alias("keep_id"),
            F.count(F.lit(1)).over(whole).alias("group_size"),
        ),
        "content-sort",
    )
    if not hot:
        return sorted_rows.select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("place") == 1).alias("kept"),
            "text_sha256",
            "n_chars",
        )
    lead = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id")
    pieces = (
        sorted_rows.filter("salt >= 0 AND place = 1")
        .groupBy(F.col("text_sha256").alias("hot_sha"))
        .agg(F.min(lead).alias("lead"), F.sum("group_size").alias("size"))
    )
    joined = sorted_rows.join(F.broadcast(pieces), F.col("text_sha256") == F.col("hot_sha"), "left")
    is_hot = F.col("hot_sha").isNotNull()
    is_lead = (-F.col("n_chars")).eqNullSafe(F.col("lead.n")) & F.col("doc_id").eqNullSafe(
        F.col("lead.doc_id")
    )
    return joined.select(
        "doc_id",
        F.when(is_hot, F.col("lead.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(is_hot, F.col("size")).otherwise(F.col("group_size")).alias("group_size"),
        ((F.col("place") == 1) & (~is_hot | is_lead)).alias("kept"),
        "text_sha256",
        "n_chars",
    )
