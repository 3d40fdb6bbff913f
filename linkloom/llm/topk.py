"""Exact top-k search by inner product: columnar branch-and-bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.workspace import stage

#: Sums of products stay exact in doubles below this.
_EXACT = 2.0**53
#: Sums up to here fit a long, whatever a double's rounding.
_LONG = 2.0**63 * (1 - 1e-9)


def usable(vector: str) -> Column:
    """True for a vector without nulls, NaN and infinities that is not null itself."""
    return F.coalesce(
        F.forall(
            F.col(vector),
            lambda x: x.isNotNull()
            & ~F.isnan(x.cast("double"))
            & (F.abs(x.cast("double")) < F.lit(float("inf"))),
        ),
        F.lit(False),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as columns of a float matrix; short vectors end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((width, len(sizes)))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = places < width
    out[places[fits], rows[fits]] = flat[fits]
    return out


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """The same as long integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((width, len(sizes)), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = places < width
    out[places[fits], rows[fits]] = flat[fits]
    return out


def _remaining(columns: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Euclidean mass from each cut to the end, one row per cut."""
    squares = np.cumsum((columns**2)[::-1], axis=0)[::-1]
    return np.sqrt(np.array([squares[c] for c in cuts[:-1]])) if cuts[:-1] else columns[:0]


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    *,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    query_block: int = 16_384,
    dim_block: int = 16,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest inner products.

    Vectors are integer arrays.  Queries are sent to the tasks in blocks of about
    ``query_block`` rows, so a broadcast is bounded whatever the number of queries.  A
    task lays each batch of candidates out by dimension, adds ``dim_block`` dimensions
    at a time, and drops candidates whose partial sum plus the product of the remaining
    masses (Cauchy-Schwarz) is below the query's k-th score so far; survivors are
    compacted before the next block.  Ties go to the smaller id.  Each task returns
    ``k`` rows per query, which one window ranks.

    A shorter vector counts as if zeros followed.  Rows with a null id take no part.
    Candidates with the query's id are its own and left out; repeated candidates each
    hold a place.  An empty table gives an empty result.  Sums from 2**53 on are added up
    as integers; one that does not fit a long ends the query.
    """
    spark = queries.sparkSession
    columns = [F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")]
    queries = queries.select(*columns).filter("vec_id IS NOT NULL").distinct()
    candidates = candidates.select(*columns).filter("vec_id IS NOT NULL")
    total = queries.count()
    blocks = max(1, -(-total // query_block))
    own_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    schema = "slot int, query_id long, vec_id long, score long"
    parts = []
    for block in range(blocks):
        rows = queries.filter(own_block == block).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        ids = rows["vec_id"].to_numpy()
        vectors = rows["vector"].combine_chunks()
        width = int(np.diff(vectors.offsets.to_numpy()).max(initial=0))
        # Single precision would round; doubles hold every integer below 2**53.
        sent = spark.sparkContext.broadcast((ids, _matrix(vectors, width), vectors))

        def search(batches, sent=sent, width=width):
            ids, matrix, vectors = sent.value
            asked = None
            cuts = [*range(0, width, dim_block), width]
            query_mass = _remaining(matrix, cuts)
            best_score = [np.zeros(0, np.int64)] * len(ids)
            best_id = [np.zeros(0, np.int64)] * len(ids)
            largest = np.abs(matrix).max(initial=0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy(zero_copy_only=False)
                dims = _matrix(batch.column(1), width)
                # Doubles would round such sums: the survivors of the bounds are added up as integers.
                whole = None
                if largest * np.abs(dims).max(initial=0) * max(width, 1) >= _EXACT:
                    whole = _integers(batch.column(1), width)
                    if asked is None:
                        asked = _integers(vectors, width)
                mass = _remaining(dims, cuts)
                for q in range(len(ids)):
                    alive = np.flatnonzero(own != ids[q])
                    floor = best_score[q].min() if len(best_score[q]) == k else -np.inf
                    if floor == -np.inf and len(alive) > 4 * k:
                        # A first bound: the full products of a few candidates.
                        few = np.sort(matrix[:, q] @ dims[:, alive[: 64 * k]])
                        floor = few[-k] - 1e-6 * (1 + abs(few[-k]))
                    sums = np.zeros(len(alive))
                    for b in range(len(cuts) - 1):
                        bound = sums + query_mass[b, q] * mass[b, alive]
                        stays = bound >= floor - 1e-6 * (1 + np.abs(bound))
                        if not stays.all():
                            alive, sums = alive[stays], sums[stays]
                        if not len(alive):
                            break
                        part = slice(cuts[b], cuts[b + 1])
                        sums = sums + matrix[part, q] @ dims[part][:, alive]
                    stays = sums >= floor - (0 if whole is None else 1e-6 * (1 + np.abs(sums)))
                    alive, sums = alive[stays], sums[stays]
                    if whole is None:
                        exact = np.rint(sums).astype(np.int64)
                    elif np.abs(sums).max(initial=0) < _LONG:
                        exact = asked[:, q] @ whole[:, alive]
                    else:
                        raise OverflowError("an inner product does not fit a long")
                    score = np.append(best_score[q], exact)
                    found = np.append(best_id[q], own[alive])
                    order = np.lexsort((found, -score))[:k]
                    best_score[q], best_id[q] = score[order], found[order]
            counts = [len(s) for s in best_score]
            if sum(counts):
                slot = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slot),
                        pa.array(ids[slot]),
                        pa.array(np.concatenate(best_id)),
                        pa.array(np.concatenate(best_score)),
                    ],
                    ["slot", "query_id", "vec_id", "score"],
                )

        found = candidates.mapInArrow(search, schema)
        parts.append(found if blocks == 1 else stage(found, "top-k"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query_id", "slot").orderBy(F.desc("score"), "vec_id")
    result = None
    for part in parts:
        ranked = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        result = ranked if result is None else result.unionAll(ranked)
    return result.select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Usable vectors with each component as ``floor(256 * x)``: ``vec_id, vector``."""
    return embeddings.filter(usable(vector_col)).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(F.col(vector_col), lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector"),
    )
