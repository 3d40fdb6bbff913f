"""Conversation structure repair: cheapest edits, ties settled by prefix-doubling path ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.workspace import stage

from .common import lean

_BLANKS = " \t\n\x0b\x0c\r"
#: What a conversation may be at: nothing yet, after the system turn, after a user's, after an assistant's.
_STATES = 4
#: The state that an inserted or reroled turn leads to.
_NEXT = np.array([2, 2, 3, 2])
#: The state that a kept turn leads to, by state and role (s, u, a, other); -1 where it cannot stay.
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Cost of ending in each state: two inserts, one, or none.
_END = [0, 4, 2, 0]
_FAR = 1 << 40
#: Edits by number in the order of their letters; 0 is the end of the audit.
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
_DELETE, _INSERT, _KEEP, _REROLE = 1, 2, 3, 4
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def damage(
    rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"
) -> DataFrame:
    """The given rows with the faults that each row's checksum asks for; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    return (
        rows.select(
            F.col(conv_col), F.col(turn_col), space(role_col).alias("role"), space(text_col).alias("text"),
            kind.alias("kind"),
        )
        .filter("kind <> 0")
        .select(
            F.col(conv_col).alias("conv_id"),
            F.col(turn_col).alias("turn"),
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "")
            .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def _key(conv: Column) -> Column:
    """A conversation's id as text, which a null has too."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("null"))


# Costs and paths of many chunks at once.  A chunk is a stretch of a conversation's rows; its
# nodes are its places (before each row, and behind the last) times the states.


class _Chunks:
    """Rows of several chunks, one after the other, with the cheapest costs from each node."""

    def __init__(self, codes: list[np.ndarray], final: np.ndarray, ends: np.ndarray):
        self.sizes = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint8)
        self.role, self.fault = (flat & 3).astype(np.int64), flat >> 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.final, self.ends = final, ends

    def _step(self, row: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Costs before the given rows from those behind them: ``(..., 4)`` arrays of all chunks."""
        cut = self.fault[row] == TRUNCATED
        stays = (self.fault[row] == 0) | cut
        shape = (len(row),) + (1,) * (after.ndim - 2)
        extra = np.where(stays, cut, _FAR).reshape(shape)
        base = after + 3
        for s in range(_STATES):
            to = _KEPT[s][self.role[row]]
            kept = np.take_along_axis(after, np.maximum(to, 0).reshape(shape + (1,)), -1)[..., 0]
            kept = np.where((to < 0).reshape(shape), _FAR, kept + extra)
            reroled = after[..., _NEXT[s]] + 2 + extra
            base[..., s] = np.minimum(np.minimum(base[..., s], kept), reroled)
        once = base[..., _NEXT] + 2
        twice = base[..., _NEXT[_NEXT]] + 4
        return np.minimum(np.minimum(base, once), np.minimum(twice, _FAR))

    def _backward(self, after: np.ndarray, keep: list | None) -> np.ndarray:
        """Costs before the first row of each chunk; ``keep`` gets those before every row."""
        order = np.argsort(-self.sizes, kind="stable")
        sizes = self.sizes[order]
        out = after.copy()
        # Rows are taken from the last to the first, for all chunks that have one left.
        for back in range(1, int(sizes.max(initial=0)) + 1):
            own = order[: np.searchsorted(-sizes, -back, side="right")]
            row = self.starts[own] + self.sizes[own] - back
            out[own] = self._step(row, out[own])
            if keep is not None:
                keep.append((row, out[own]))
        return out

    def matrices(self) -> np.ndarray:
        """Cheapest costs through each chunk, from state to state: ``(chunks, 4, 4)``."""
        unit = np.full((_STATES, _STATES), _FAR, np.int64)
        np.fill_diagonal(unit, 0)
        after = np.broadcast_to(unit, (len(self.sizes), _STATES, _STATES)).copy()
        return self._backward(after, None).transpose(0, 2, 1)

    def paths(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Edit numbers of each node's least cheapest continuation, its doubled pointers, and costs.

        Nodes of a chunk are numbered place by place.  Its exits point at themselves.
        """
        kept: list = []
        self._backward(self.ends, kept)
        places = self.sizes + 1
        first = np.cumsum(places) - places
        total = int(places.sum())
        cost = np.zeros((total, _STATES), np.int64)
        chunk_of_row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place_of_row = np.arange(len(chunk_of_row)) + chunk_of_row
        for row, own in kept:
            cost[place_of_row[row]] = own
        last = first + self.sizes
        cost[last] = self.ends
        # Letters of optimal arcs and where they lead; the least letter first.
        node = np.arange(total * _STATES).reshape(total, _STATES)
        ranks, targets = [], []

        def arcs(letter: int, good: np.ndarray, to: np.ndarray) -> None:
            ranks.append(np.where(good, letter, 9).ravel())
            targets.append(np.where(good, to, node).ravel())

        cut = self.fault == TRUNCATED
        stays = (self.fault == 0) | cut
        here, there = cost[place_of_row], cost[place_of_row + 1]
        state = np.arange(_STATES)

        def spread(value: np.ndarray, fill) -> np.ndarray:
            out = np.full((total, _STATES), fill, value.dtype)
            out[place_of_row] = value
            return out

        base = (place_of_row[:, None] + 1) * _STATES
        arcs(_DELETE, spread(here == there + 3, False), spread(base + state, 0))
        inner = np.ones(total, bool)
        inner[last[~self.final]] = False
        arcs(_INSERT, (cost == cost[:, _NEXT] + 2) & inner[:, None], node[:, :1] + _NEXT)
        to = _KEPT.T[self.role]
        kept_cost = np.take_along_axis(there, np.maximum(to, 0), 1) + cut[:, None]
        arcs(_KEEP, spread((to >= 0) & stays[:, None] & (here == kept_cost), False), spread(base + to, 0))
        reroled = there[:, _NEXT] + 2 + cut[:, None]
        arcs(_REROLE, spread(stays[:, None] & (here == reroled), False), spread(base + _NEXT, 0))
        edit = np.min(ranks, axis=0)
        best = np.take_along_axis(np.array(targets), np.argmin(ranks, axis=0)[None], 0)[0]
        # Ranks of the least audits of 1, 2, 4, ... letters; a rank and the rank behind it give the next.
        pointers = [best]
        rank = np.where(edit == 9, 0, edit)
        while True:
            far = pointers[-1][pointers[-1]]
            if (far == pointers[-1]).all():
                break
            pair = rank * (int(rank.max()) + 1) + rank[pointers[-1]]
            rank = np.unique(pair, return_inverse=True)[1]
            pointers.append(far)
        # The arc whose letter and rest come first, by the ranks of whole audits.
        # The letters of a node's arcs differ, so these are the arcs that the pointers follow.
        choice = np.array([r * (len(rank) + 1) + rank[t] for r, t in zip(ranks, targets)])
        edit = np.take_along_axis(np.array(ranks), np.argmin(choice, axis=0)[None], 0)[0]
        return np.where(edit == 9, 0, edit), pointers, cost

    def exits(self) -> np.ndarray:
        """The state behind each chunk on the least path, by the state before it."""
        _, pointers, _ = self.paths()
        first = (np.cumsum(self.sizes + 1) - self.sizes - 1) * _STATES
        return pointers[-1][first[:, None] + np.arange(_STATES)] % _STATES

    def audits(self, entry: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each chunk: cost, edit numbers, the row of each edit, and the state behind it."""
        edit, pointers, cost = self.paths()
        places = self.sizes + 1
        first = np.cumsum(places) - places
        start = first * _STATES + entry
        # The node after j edits, by the doubled pointers of the bits of j; a chunk has at
        # most three edits for each place.
        most = 3 * places
        owner = np.repeat(np.arange(len(places)), most)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most)
        node = start[owner]
        for bit, pointer in enumerate(pointers):
            take = (step >> bit) & 1 == 1
            node[take] = pointer[node[take]]
        beyond = step >> len(pointers) > 0
        node[beyond] = pointers[-1][pointers[-1][node[beyond]]]
        letter = edit[node]
        after = pointers[0][node] % _STATES
        row = node // _STATES - first[owner]
        ends = np.cumsum(most)
        for i, (low, high) in enumerate(zip((ends - most).tolist(), ends.tolist())):
            n = int(np.count_nonzero(letter[low:high]))
            part = slice(low, low + n)
            yield int(cost[first[i], entry[i]]), letter[part], row[part], after[part]


_CHUNK = (
    "conv string, part int, seq int, edge boolean, codes binary, rows binary, blank long, duplicate long, "
    "truncated long, illegal long, low long, high long, turns long, first_turn long, last_turn long, "
    "first_role int, last_role int, matrix array<long>"
)


def _illegal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether two neighbouring roles are none of su, ua and au (s, u, a, other are 0 to 3)."""
    return ~(((before == 0) & (after == 1)) | ((before == 1) & (after == 2)) | ((before == 2) & (after == 1)))


def _cut(chunk_rows: int):
    """Rows of a sorted partition as chunks of at most ``chunk_rows``."""
    names = [f.split(" ")[0] for f in _CHUNK.split(", ")]
    types = [
        {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64()}.get(
            f.split(" ")[1], pa.list_(pa.int64())
        )
        for f in _CHUNK.split(", ")
    ]

    def batch_of(chunks: list[tuple]) -> pa.RecordBatch:
        own = [c for c in chunks if c[3]]
        held = _Chunks(
            [np.frombuffer(c[4], np.uint8) for c in own], np.zeros(len(own), bool), np.zeros((len(own), _STATES), np.int64)
        )
        matrices = iter(held.matrices().reshape(len(own), -1).tolist()) if own else iter(())
        rows = [c + (next(matrices) if c[3] else None,) for c in chunks]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)

    def described(conv, part, seq, edge, pieces) -> tuple:
        codes, turns, known, rows = (np.concatenate(x) for x in zip(*pieces))
        role, fault = codes & 3, codes >> 2
        counts = np.bincount(fault, minlength=4).tolist()
        own = turns[known]
        return (
            conv, part, seq, edge, codes.tobytes(), rows.tobytes(), *counts[1:4],
            int(_illegal(role[:-1], role[1:]).sum()),
            int(own[0]) if len(own) else None,
            int(own[-1]) if len(own) else None,
            int((own[1:] != own[:-1]).sum()) + 1 if len(own) else 0,
            int(turns[0]) if known[0] else None,
            int(turns[-1]) if known[-1] else None,
            int(role[0]), int(role[-1]),
        )

    def run(batches):
        conv, part, seq, first = None, 0, 0, True
        pieces: list = []
        size = 0
        out: list[tuple] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            convs = batch.column(0)
            part = batch.column(5)[0].as_py()
            turns = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            codes = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8) | (
                batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint8) << 2
            )
            rows = batch.column(4).to_numpy(zero_copy_only=False)
            values = convs.dictionary_encode()
            numbers = values.indices.to_numpy(zero_copy_only=False)
            starts = np.append(0, np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist()
            for begin, end in zip(starts, [*starts[1:], len(numbers)]):
                name = values.dictionary[int(numbers[begin])].as_py()
                if name != conv:
                    if size:
                        out.append(described(conv, part, seq, first or seq > 0, pieces))
                        held += size
                    first = conv is None
                    conv, seq, pieces, size = name, 0, [], 0
                while begin < end:
                    stop = min(end, begin + chunk_rows - size)
                    pieces.append((codes[begin:stop], turns[begin:stop], known[begin:stop], rows[begin:stop]))
                    size += stop - begin
                    begin = stop
                    if size == chunk_rows:
                        out.append(described(conv, part, seq, True, pieces))
                        held += size
                        seq, pieces, size = seq + 1, [], 0
                if held >= 100_000:
                    yield batch_of(out)
                    out, held = [], 0
        if size:
            out.append(described(conv, part, seq, True, pieces))
        if out:
            yield batch_of(out)

    return lean(run)


def _product(a: str, b: str) -> Column:
    """The cheapest costs through two matrices, one after the other."""
    at = lambda m, i, j: F.col(m)[i * _STATES + j]
    cells = range(_STATES)
    return F.array(
        *[F.least(*[at(a, i, x) + at(b, x, j) for x in cells], F.lit(_FAR)) for i in cells for j in cells]
    )


def _scan(table: DataFrame, longest: int, combine, back: bool, label: str) -> DataFrame:
    """``conv, idx, value`` with the values of all chunks from a chunk's end on (or up to it) combined.

    Each round looks twice as far, so rounds grow with the logarithm of a conversation's
    chunks, and every chunk is a row of its own in each join.
    """
    step = 1
    while step < longest:
        far = table.select(
            "conv", (F.col("idx") + F.lit(-step if back else step)).alias("idx"), F.col("value").alias("other")
        )
        table = stage(
            table.join(far, ["conv", "idx"], "left").select(
                "conv",
                "idx",
                F.when(F.col("other").isNull(), F.col("value")).otherwise(combine("value", "other")).alias("value"),
            ),
            label,
        )
        step *= 2
    return table


def _chunk_arrays(batch: pa.RecordBatch) -> tuple[_Chunks, np.ndarray]:
    """Chunks from columns ``codes, ends, final, entry``, and the states they are entered in."""
    codes = [np.frombuffer(c, np.uint8) for c in batch.column(0).to_pylist()]
    ends = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, _STATES)
    final = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
    return _Chunks(codes, final, ends), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of codes."""
    for batch in batches:
        sizes = np.cumsum([len(c) for c in batch.column(column).to_pylist()])
        begin = 0
        while begin < batch.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + most)))
            yield batch.slice(begin, end - begin)
            begin = end


def repair(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    *,
    chunk_rows: int = 65_536,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cheapest edits that make every conversation alternate, as three tables.

    * ``conv, gaps, blank, duplicate, truncated, illegal, cost``: a row per conversation;
    * ``conv, part, seq, audit``: the letters of its edits, in pieces in that order;
    * ``conv, part, seq, pos, edit, role, text``: every edit with the turn it leaves
      (nulls for a deleted one).

    ``conv`` is the id as text after an equals sign, or ``null``.  Rows go by turn, nulls
    first, equal turns by role and the MD5 of the text, so equal rows are neighbours.
    Null roles and texts count as one space.

    Spark sorts all rows by range, so a conversation with any share of the rows is spread
    over partitions.  Partitions are cut into chunks.  A conversation inside one chunk is
    repaired there.  For the others, the costs through each chunk from state to state are
    combined over 1, 2, 4, ... chunks by joins, which gives each chunk the costs behind it; the
    exits of its least paths are combined likewise, which gives the state it is entered in.

    Inside chunks, costs are filled backwards; nodes with optimal arcs are ranked by audits
    of 1, 2, 4, ... letters, and the least path is read off the doubled pointers.  An
    empty table gives empty tables.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = stage(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            _key(F.col(conv_col)).alias("conv"),
            F.col(turn_col).cast("long").alias("turn"),
            space(role_col).alias("role"),
            space(text_col).alias("text"),
            F.unhex(F.md5(space(text_col).cast("binary"))).alias("digest"),
        ),
        "turns",
    )
    trimmed = F.rtrim("text", F.lit(_BLANKS))
    first_of = (
        rows.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "row")).alias("first")).select("first.row")
    ).withColumn("new", F.lit(True))
    letter = F.substring("role", 1, 1)
    light = rows.select(
        "row",
        "conv",
        "turn",
        "role",
        "digest",
        F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3).alias("code"),
        (trimmed == "").alias("blank"),
        F.substring(trimmed, -1, 1).isin(".", "!", "?").alias("whole"),
    ).join(first_of, "row", "left")
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("new").isNull(), DUPLICATE)
        .when(~F.col("whole"), TRUNCATED)
        .otherwise(0)
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    chunks = stage(
        light.select("conv", "turn", "code", fault.alias("fault"), "row", "role", "digest")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv", "turn", "code", "fault", "row", F.spark_partition_id().alias("part"))
        .mapInArrow(_cut(chunk_rows), _CHUNK),
        "chunks",
    )

    # Conversations at a partition's border or of several chunks.
    in_order = W.partitionBy("conv").orderBy("part", "seq")
    whole = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edges = stage(
        chunks.filter("edge").select(
            "conv",
            "part",
            "seq",
            F.row_number().over(in_order).alias("idx"),
            F.count("*").over(whole).alias("n"),
            F.col("matrix").alias("value"),
            F.lag("last_turn").over(in_order).alias("turn_before"),
            F.lag("last_role").over(in_order).alias("role_before"),
            "codes",
        ),
        "edges",
    )
    longest = edges.agg(F.max("n")).first()[0] or 0
    behind = _scan(edges.select("conv", "idx", "value"), longest, _product, True, "costs").select(
        "conv", (F.col("idx") - 1).alias("idx"), F.col("value").alias("after")
    )
    end = F.array(*[F.lit(x).cast("long") for x in _END])
    through = F.array(
        *[
            F.least(*[F.col("after")[s * _STATES + x] + F.lit(_END[x]) for x in range(_STATES)])
            for s in range(_STATES)
        ]
    )
    edges = edges.join(behind, ["conv", "idx"], "left").select(
        "conv", "part", "seq", "idx", "turn_before", "role_before", "codes",
        F.when(F.col("after").isNull(), end).otherwise(through).alias("ends"),
        F.col("after").isNull().alias("final"),
    )

    def exits(batches):
        for batch in _pieces(batches, 2):
            own, _ = _chunk_arrays(batch.select([2, 3, 4, 5]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own.exits().tolist(), pa.list_(pa.int32()))],
                ["conv", "idx", "value"],
            )

    maps = stage(
        edges.select("conv", "idx", "codes", "ends", "final", F.lit(0).alias("entry")).mapInArrow(
            lean(exits), "conv string, idx int, value array<int>"
        ),
        "exits",
    )
    follow = lambda value, other: F.array(*[F.col(value)[F.col(other)[s]] for s in range(_STATES)])
    entries = _scan(maps, longest, follow, False, "entries").select(
        "conv", (F.col("idx") + 1).alias("idx"), F.col("value")[0].alias("entry")
    )
    known = edges.drop("codes").join(entries, ["conv", "idx"], "left").drop("idx")
    inside = F.col("final").isNull()
    chunks = chunks.join(known, ["conv", "part", "seq"], "left") if longest else chunks.selectExpr(
        "*", "CAST(NULL AS boolean) final", "CAST(NULL AS array<bigint>) ends", "CAST(NULL AS int) entry",
        "CAST(NULL AS bigint) turn_before", "CAST(NULL AS int) role_before",
    )
    repaired = stage(
        chunks.select(
            "conv", "part", "seq",
            F.coalesce("role_before", F.lit(-1)).alias("role_before"), "first_role",
            "codes",
            F.when(inside, end).otherwise(F.col("ends")).alias("ends"),
            F.coalesce("final", F.lit(True)).alias("final"),
            F.coalesce("entry", F.lit(0)).alias("entry"),
            "rows",
            (inside | F.col("entry").isNull()).alias("head"),
        ).mapInArrow(_edited(), _EDITED),
        "edits",
    )
    seam = F.when(
        F.col("role_before").isNotNull()
        & ~(
            ((F.col("role_before") == 0) & (F.col("first_role") == 1))
            | ((F.col("role_before") == 1) & (F.col("first_role") == 2))
            | ((F.col("role_before") == 2) & (F.col("first_role") == 1))
        ),
        1,
    ).otherwise(0)
    same_turn = F.coalesce((F.col("turn_before") == F.col("first_turn")).cast("int"), F.lit(0))
    costs = repaired.groupBy("conv").agg(F.sum("cost").alias("cost"))
    report = (
        chunks.groupBy("conv")
        .agg(
            F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - same_turn), F.lit(0)).alias("gaps"),
            F.sum("blank").alias("blank"),
            F.sum("duplicate").alias("duplicate"),
            F.sum("truncated").alias("truncated"),
            F.sum(F.col("illegal") + seam).alias("illegal"),
        )
        .join(costs, "conv")
    )
    audits = repaired.select("conv", "part", "seq", "audit")
    edit = F.explode(F.arrays_zip("row", "pos", "edit", "state")).alias("e")
    edits = repaired.select("conv", "part", "seq", edit).select(
        "conv", "part", "seq", "e.pos", F.chr(F.col("e.edit")).alias("edit"), "e.state", "e.row"
    )
    named = F.when(F.col("state") == 2, "user").otherwise("assistant")
    place = ["conv", "part", "seq", "pos", "edit"]
    # Inserted and deleted turns have no text to look up.
    stay = edits.filter("edit IN ('K', 'R')").join(rows.select("row", "role", "text"), "row")
    turns = stay.select(*place, F.when(F.col("edit") == "R", named).otherwise(F.col("role")).alias("role"), "text")
    inserted = F.col("edit") == "I"
    turns = turns.unionAll(
        edits.filter("edit IN ('I', 'D')").select(
            *place, F.when(inserted, named).alias("role"), F.when(inserted, "").alias("text")
        )
    )
    return report, audits, turns


_EDITED = (
    "conv string, part int, seq int, cost long, audit string, row array<long>, pos array<int>, "
    "edit array<int>, state array<int>"
)


def _edited():
    """Each chunk's edits; its cost where it begins a conversation."""
    names = [f.split(" ")[0] for f in _EDITED.split(", ")]

    def run(batches):
        for batch in _pieces(batches, 5):
            chunks, entry = _chunk_arrays(batch.select([5, 6, 7, 8]))
            heads = batch.column(10).to_pylist()
            out: list[tuple] = []
            for i, (cost, letter, row, after) in enumerate(chunks.audits(entry)):
                ids = np.append(np.frombuffer(batch.column(9)[i].as_py(), np.int64), 0)
                own = np.where(letter == _INSERT, -1, ids[row])
                codes = _LETTERS[letter]
                out.append((cost if heads[i] else 0, codes.tobytes().decode(), own, codes, after))
            cost, audit, row, code, after = zip(*out)
            offsets = np.cumsum([0, *map(len, row)]).astype(np.int32)
            pos = np.concatenate([np.arange(len(r), dtype=np.int32) for r in row])
            lists = [np.concatenate(row), pos, np.concatenate(code).astype(np.int32), np.concatenate(after).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.select([0, 1, 2]).columns,
                    pa.array(cost, pa.int64()),
                    pa.array(audit),
                    *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists),
                ],
                names,
            )

    return lean(run)


def transcript_digests(turns: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``: the SHA-256 of each conversation's ``role:text`` lines.

    Spark sorts the lines, on disk where they are many; a task passes them through the
    hash one by one and holds a batch of them at most.  SHA-256 is a chain, so the lines of a
    conversation meet in one task, however many.
    """

    def run(batches):
        name = digest = None
        for batch in batches:
            convs, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done = []
            for conv, line in zip(convs, lines):
                if conv != name:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = conv, hashlib.sha256(line.encode("utf-8", "surrogatepass"))
                else:
                    digest.update(b"\n" + line.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["conv", "repaired_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    lines = turns.filter("edit <> 'D'").select("conv", "part", "seq", "pos", F.concat_ws(":", "role", "text").alias("line"))
    return (
        lines.repartition("conv")
        .sortWithinPartitions("conv", "part", "seq", "pos")
        .select("conv", "line")
        .mapInArrow(lean(run), "conv string, repaired_sha256 string")
    )


def conversation_reports(
    original: DataFrame, damaged: DataFrame, conv_col: str = "conv_id", *, chunk_rows: int = 65_536
) -> DataFrame:
    """A row for every id in ``original`` with the faults and the repair of its rows in ``damaged``.

    Ids without rows, a null id among them, have zeros, no audit and the digest of an empty text.
    """
    report, audits, turns = repair(damaged, chunk_rows=chunk_rows)
    pieces = F.sort_array(F.collect_list(F.struct("part", "seq", "audit")))
    joined = audits.groupBy("conv").agg(F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    ids = original.select(F.col(conv_col).alias("conv_id"), _key(F.col(conv_col)).alias("conv")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        ids.join(report, "conv", "left")
        .join(joined, "conv", "left")
        .join(transcript_digests(turns), "conv", "left")
        .select(
            "conv_id",
            *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )
    )
