"""Mixing sources to target weights by proportionate-fair scheduling of blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from heapq import heappop, heappush
from itertools import groupby, islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.workspace import stage


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Blocks per source in ``period`` slots: largest remainders, one at least."""
    total = sum(weights.values())
    exact = {s: Fraction(w) / Fraction(total) * (period - len(weights)) for s, w in weights.items()}
    shares = {s: 1 + int(x) for s, x in exact.items()}
    rest = period - sum(shares.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:rest]:
        shares[s] += 1
    return shares


def pfair_slots(shares: dict[str, int]) -> list[str]:
    """The source of each slot of one period, which has ``sum(shares)`` slots, by :func:`schedule`."""
    return [s for s, _ in schedule(shares, shares)]


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """The source and the number of the block of each slot, until all blocks have their place.

    In the ideal, sources are served at once and without pause, by their exact weights,
    and a source whose blocks are served leaves its share to the others.  At virtual time
    ``v`` a source of weight ``w`` and ``n`` blocks has had ``min(w * v, n)``, and the sum
    of that over all sources is the slot.  Block ``k`` is released at the slot in which
    the ideal begins it, and due at the end of the slot in which the ideal is through.
    Each slot goes to the released block that is due first; among equal ones to the
    source of larger weight, then of smaller name.  The ideal keeps all these times, so
    unit blocks can, and the earliest deadline first does: no block is late, and after
    any slot every source is less than one block from the ideal, however long the run.

    Arithmetic is on whole numbers, so nothing drifts.  It holds a block per source.
    Sources of weight 0 come when the others are through, in equal shares.
    """
    exact = {s: Fraction(weights[s]) for s, n in blocks.items() if n > 0 and weights[s] > 0}
    scale = lcm(*(w.denominator for w in exact.values()))
    names = sorted(exact, key=lambda s: (-exact[s], s))
    weight = [int(exact[s] * scale) for s in names]
    count = [blocks[s] for s in names]
    # The ideal in pieces: until ends[i], the slot is gone[i] + rate[i] * v.
    ends, gone, rate = [], [0], [sum(weight)]
    for end, own in groupby(
        sorted((Fraction(n, w), i) for i, (n, w) in enumerate(zip(count, weight))), key=lambda x: x[0]
    ):
        left = [i for _, i in own]
        ends.append(end)
        gone.append(gone[-1] + sum(count[i] for i in left))
        rate.append(rate[-1] - sum(weight[i] for i in left))
    piece = [0] * len(names)

    def ideal(i: int, k: int) -> tuple[int, int]:
        """The slot at which source ``i`` has had ``k`` blocks, times its weight, and the weight."""
        w, at = weight[i], piece[i]
        if k * ends[at].denominator > ends[at].numerator * w:
            at = piece[i] = bisect_left(ends, Fraction(k, w))
        return gone[at] * w + rate[at] * k, w

    waiting = [(0, i, 0) for i in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    for slot in range(sum(count)):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heappop(waiting)
            through, w = ideal(i, k + 1)
            heappush(ready, (-(-through // w), i, k))
        due, i, k = heappop(ready)
        if due <= slot:
            raise AssertionError("a block is late")
        yield names[i], k
        if k + 1 < count[i]:
            through, w = ideal(i, k + 1)
            heappush(waiting, (through // w, i, k + 1))
    if last := {s: n for s, n in blocks.items() if n > 0 and s not in exact}:
        yield from schedule(last, dict.fromkeys(last, 1.0))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    *,
    alpha: float = 0.5,
    block_rows: int = 16,
    period: int = 1_000,
    seed: int = 17,
    buckets: int = 1_024,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, source, position, slot, block``: every row of ``docs`` with its place in the mix.

    ``keep`` names columns of ``docs`` to pass on.

    The rows of a source are shuffled by a hash and cut into blocks of ``block_rows``
    (its last block may be shorter).  Blocks follow each other by
    :func:`schedule`, so that after any number of slots each source has had its share by
    the exact weights to within one block, until a source is used up; then the others
    share its slots.  ``weights`` are by source, sources without one count as the
    smallest given; by default a source of ``n`` rows weighs ``n ** alpha``.  One task
    works the schedule out, a row per block, and holds one block per source; rows meet
    it by a join on source and block.  ``period`` has no effect: nothing is rounded to it.

    Rows are numbered within their source by hash bucket (a count of each bucket, a
    running sum over the buckets, a rank within one), so a source with a third of all
    rows is spread over many tasks.

    A null source is a source of its own.  Null ids and repeated rows are placed like
    any other; which of two repeated rows comes first does not show.  Other columns are
    not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), id_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("own"),
        order.alias("h"),
        F.pmod(F.shiftright(order, 20), F.lit(buckets)).cast("int").alias("bucket"),
        *keep,
    )
    within = W.partitionBy("own", "bucket").orderBy("h", "doc_id")
    ranked = stage(rows.withColumn("rank", F.row_number().over(within) - 1), "mix-ranks")
    # One row per source and bucket; running sums by source over at most `buckets` rows.
    sums = W.partitionBy("own").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = (
        ranked.groupBy("own", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(sums), F.lit(0)))
    )
    sizes = {r["own"]: r["n"] for r in before.groupBy("own").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return rows.select("doc_id", "source", *keep, *[F.lit(0).cast("long").alias(c) for c in ("position", "slot", "block")])
    if weights is None:
        own_weights = {s: float(n) ** alpha for s, n in sizes.items()}
    else:
        least = min(weights.values(), default=1.0)
        own_weights = {s: float(weights.get(s[1:] if s != "n" else None, least)) for s in sizes}
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}

    def run(batches):
        if not any([batch.num_rows for batch in batches]):
            return
        slots = enumerate(schedule(blocks, own_weights))
        while part := list(islice(slots, 65_536)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s for _, (s, _) in part], pa.string()),
                    pa.array([k for _, (_, k) in part], pa.int64()),
                    pa.array([slot for slot, _ in part], pa.int64()),
                ],
                ["own", "block", "slot"],
            )

    planned = stage(
        spark.range(0, 1, 1, 1).mapInArrow(run, "own string, block long, slot long"), "mix-schedule"
    )
    numbered = ranked.join(before.drop("n"), ["own", "bucket"]).withColumn("place", F.col("before") + F.col("rank"))
    placed = (
        numbered.withColumn("block", F.floor(F.col("place") / block_rows))
        .join(planned, ["own", "block"])
        .select("doc_id", "source", "slot", "block", (F.col("place") % block_rows).alias("within"), *keep)
    )
    return placed.select(
        "doc_id", "source", *keep, (F.col("slot") * block_rows + F.col("within")).alias("position"), "slot", "block"
    )
