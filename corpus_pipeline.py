"""A corpus pipeline: toxic documents out, repeated lines out, near duplicates out, mixed, tokenised.

``STAGES`` are ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import sys
from pathlib import Path

_ROOT = str(Path(__file__).resolve().parent)
if _ROOT not in sys.path:
    sys.path.insert(0, _ROOT)

from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import Window as W  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import linkloom  # noqa: E402
from linkloom.llm import toxicity as tox  # noqa: E402
from linkloom.llm.bpe import decode, encode  # noqa: E402
from linkloom.llm.jaccard_join import jaccard_join  # noqa: E402
from linkloom.llm.line_dedup import line_dedup  # noqa: E402
from linkloom.llm.mixing import mix_sources  # noqa: E402
from linkloom.llm.queries import table, tokenizer_path  # noqa: E402
from linkloom.workspace import stage  # noqa: E402

cloudpickle.register_pickle_by_value(linkloom)

_NO_ID = 2**63 - 1


def _key(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that repeated rows share: the id (null as the largest) and a hash of the text."""
    return docs.withColumns(
        {
            "__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)),
            "__twin": F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts toxic go; all others stay as they are."""
    return tox.without_toxic(docs, tox.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals to within two edits go; every document stays.

    ``n_chars`` follows a text that changed.  Null texts stay null.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = line_dedup(docs.withColumn("__none", F.col("text").isNull()), keep=(*rest, "__none"))
    changed = F.col("n_dropped") > 0
    return done.withColumns(
        {
            "text": F.when(~F.col("__none"), F.col("text")),
            "n_chars": F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")),
        }
    ).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8 the row of smallest id stays.

    Rows are told apart by id and text, a null id as the largest; of rows equal in both one
    stays.  Documents without words link with nothing and stay.
    """
    keyed = _key(docs).withColumn("__key", F.xxhash64("__doc", "__twin"))
    groups = jaccard_join(keyed, id_col="__key", words=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("__key"), "component_id").distinct()
    # Without the texts: the first row of each group.
    names = ["__key", "__doc", "__twin"]
    first = (
        keyed.select(*names)
        .distinct()
        .join(groups, "__key")
        .groupBy("component_id")
        .agg(F.min(F.struct("__doc", "__twin", "__key")).alias("first"))
        .select("first.*")
    )
    equal = W.partitionBy(*names).orderBy("__key")
    kept = keyed.join(first, names, "left_semi").withColumn("__n", F.row_number().over(equal))
    return kept.filter("__n = 1").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: sorted within files, and by the files' names.

    Spark deals files to tasks by their size; whoever needs the order sorts by
    ``_metadata.file_name, _metadata.row_index``.
    """
    keyed = _key(docs)
    places = (
        mix_sources(keyed, keep=("__doc", "__twin"))
        .groupBy("__doc", "__twin")
        .agg(F.min("position").alias("__position"))
    )
    return (
        keyed.join(places, ["__doc", "__twin"])
        .repartitionByRange("__position")
        .sortWithinPartitions("__position")
        .select(*docs.columns)
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text``: token ids in the order of ``docs`` and the text they decode to."""
    path = tokenizer_path()
    return decode(encode(docs, path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text"
    )


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("mixing", mixing),
    ("bpe", tokens),
]

#: Nearest neighbours, edit joins and tokenizers are beyond SQL; the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
