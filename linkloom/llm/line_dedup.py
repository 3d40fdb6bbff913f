"""Near-duplicate lines: a segment-partition edit join with bit-parallel verification.

Two lines within ``edits`` edits: cut the shorter one into ``edits + 1`` segments, and
one of them stands unchanged in the longer one, shifted by no more than the edits allow.
So each line is indexed by its segments and probed by the few substrings that could be
a segment of a line of nearly its length.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.workspace import stage

from .common import U64, by_block, joined, lean, lean_group, mix, packed, release, runs, slices, with_row_key

_FIRST = pa.schema(
    [("grp", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("key", "line", "doc", "twin", "pos")]]
)
#: Pairs of one signature that are formed at once.
_CROWD = 64
_ROWS = "grp int, kind int, key binary, line binary, doc binary, twin binary, pos binary"


def edit_distance_within(a: str, b: str, limit: int) -> bool:
    """Whether ``a`` and ``b`` are at most ``limit`` edits apart.

    Bit-parallel: a column of the distance matrix is two bit vectors (up and down
    steps); only a band of ``2 * limit + 1`` cells around the diagonal is kept, in a
    window that moves down one cell with each symbol.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return False
    # Common ends cost nothing and shorten the rest.
    begin = 0
    while begin < len(a) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < len(a) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a:
        return len(b) <= limit
    width = 2 * limit + 1
    mask = (1 << width) - 1
    places: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    # state[e]: diagonals reached with at most e edits, as bits; bit d is row j + d - limit.
    reached = [1 << limit]
    for _ in range(limit):
        r = reached[-1]
        reached.append(r | ((r << 1) & mask))
    for j, c in enumerate(b):
        low = j - limit
        match = 0
        own = places.get(c, ())
        for i in own[bisect_left(own, low) : bisect_left(own, low + width)]:
            match |= 1 << (i - low)
        before, reached = reached, []
        for e in range(limit + 1):
            now = before[e] & match
            if e:
                # substituted, or a symbol of b put in: the band has moved down by one
                now |= before[e - 1] | (before[e - 1] >> 1)
                # with fewer edits, or a symbol of a left out
                now |= reached[e - 1] | ((reached[e - 1] << 1) & mask)
            rows = len(a) - (j + 1) + limit
            if rows < width:
                now &= (1 << max(rows + 1, 0)) - 1
            reached.append(now)
        if not reached[-1]:
            return False
    bit = len(a) - len(b) + limit
    return 0 <= bit < width and bool(reached[-1] >> bit & 1)


def eligible(line: str, least: int) -> bool:
    """Lines of fewer code points than ``least`` are never compared or dropped."""
    return len(line) >= least


def line_key(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def _cuts(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and size of each segment: nearly equal, the longer ones last."""
    base, extra = length // (edits + 1), length % (edits + 1)
    out, start = [], np.zeros_like(length)
    for i in range(edits + 1):
        size = base + (i > edits - extra)
        out.append((start, size))
        start = start + size
    return out


def _signatures(lines: list[str], keys: np.ndarray, edits: int):
    """Index and probe signatures of lines: kind (0 index, 1 probe), signature, line key.

    Substrings are hashed from running sums over all code points of all lines.
    """
    sizes = np.array([len(t) for t in lines], np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    offsets = np.cumsum(sizes) - sizes
    base = pow(0xD6E8FEB86659FD93, 1, 2**64)

    def powers(b: int, n: int) -> np.ndarray:
        out = np.full(n, U64(b))
        out[:1] = 1
        return np.multiply.accumulate(out)

    up, down = powers(base, len(points) + 1), powers(pow(base, -1, 2**64), len(points) + 1)
    sums = np.concatenate([[U64(0)], np.cumsum(mix(points, 41) * up[:-1])])

    def signature(who, start, size, length, segment):
        at = offsets[who] + start
        h = (sums[at + size] - sums[at]) * down[at]
        return mix(mix(h, 42) ^ (length.astype(U64) * U64(edits + 1) + U64(segment)), 43)

    everyone = np.arange(len(lines))
    out = []
    for segment, (start, size) in enumerate(_cuts(sizes, edits)):
        out.append((0, signature(everyone, start, size, sizes, segment), keys))
    for less in range(edits + 1):
        length = sizes - less
        who = everyone[length > edits]
        for segment, (start, size) in enumerate(_cuts(length[who], edits)):
            # A segment i (from 0) can be shifted by i edits before it, and by what the
            # edits after it must make up for; both bounds hold at once.
            low, high = max(-segment, less - (edits - segment)), min(segment, less + (edits - segment))
            for shift in range(low, high + 1):
                at = start + shift
                fits = (at >= 0) & (at + size <= sizes[who])
                w = who[fits]
                out.append((1, signature(w, at[fits], size[fits], length[w], segment), keys[w]))
    return out


def _lines(texts: list[str], least: int):
    """Number of the text, place, and line of each line that counts."""
    for number, text in enumerate(texts):
        for place, line in enumerate(text.split("\n")):
            if eligible(line, least):
                yield number, place, line


def _spread(groups: int, least: int, edits: int):
    """Documents to first places of lines, and to signatures, packed by group."""

    def run(batches):
        for batch in batches:
            for begin, end in slices(batch.column(2), 3_000_000):
                part = batch.slice(begin, end - begin)
                doc, twin = part.column(0).to_numpy(), part.column(1).to_numpy()
                first: dict[str, tuple] = {}
                for number, place, line in _lines(part.column(2).to_pylist(), least):
                    mine = (int(doc[number]), int(twin[number]), place)
                    if line not in first or mine < first[line]:
                        first[line] = mine
                if not first:
                    continue
                lines = list(first)
                keys = np.array([line_key(t) for t in lines], U64)
                places = np.array(list(first.values()), np.int64)
                rows = [
                    (g, 2, b"", k, d, t, p)
                    for g, (k, d, t, p) in by_block(
                        (mix(keys, 51) % U64(groups)).astype(np.int32), [keys, *places.T]
                    )
                ]
                signatures = _signatures(lines, keys, edits)
                for kind in (0, 1):
                    sig = np.concatenate([s for k, s, _ in signatures if k == kind])
                    own = np.concatenate([o for k, _, o in signatures if k == kind])
                    rows += [
                        (g, kind, s, o, b"", b"", b"")
                        for g, (s, o) in by_block((sig % U64(groups)).astype(np.int32), [sig, own])
                    ]
                yield from packed(_FIRST, rows, 64)

    return lean(run)


def _meet(edits: int):
    """A group to first places of its lines, and candidate pairs of different lines."""
    schema = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("line", "other", "doc", "twin", "pos")]])

    def batch(kind, *columns):
        n = len(columns[0])
        columns = [*columns, *[np.zeros(n, np.int64)] * (5 - len(columns))]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *[pa.array(c.astype(np.int64)) for c in columns]], schema=schema
        )

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        places = table.filter(pa.array(kind == 2))
        line, doc, twin, pos = (
            joined(places["line"], U64),
            *[joined(places[c], np.int64) for c in ("doc", "twin", "pos")],
        )
        order = np.lexsort((pos, twin, doc, line))
        line, doc, twin, pos = line[order], doc[order], twin[order], pos[order]
        starts, _ = runs(line)
        out = [batch(2, line.view(np.int64)[starts], line.view(np.int64)[starts], doc[starts], twin[starts], pos[starts])]
        sides = []
        for k in (0, 1):
            rows = table.filter(pa.array(kind == k))
            both = np.unique(
                np.stack([joined(rows["key"], U64), joined(rows["line"], U64)], axis=1).view("u8,u8").ravel()
            )
            sides.append((both["f0"].copy(), both["f1"].copy()))
        (index, indexed), (probe, probing) = sides
        low, high = np.searchsorted(index, probe, "left"), np.searchsorted(index, probe, "right")
        counts = high - low
        # Of a signature with many pairs only the members go on, to be met one by one.
        starts, times = runs(probe)
        crowded = np.repeat(counts[starts] * times > _CROWD, times) if len(starts) else counts > 0
        if crowded.any():
            signs = np.unique(probe[crowded])
            members = np.isin(index, signs)
            rows = np.stack(
                [np.append(probing[crowded], indexed[members]), np.append(probe[crowded], index[members])], axis=1
            )
            rows = np.unique(rows.view("u8,u8").ravel())
            out.append(batch(3, rows["f0"].copy().view(np.int64), rows["f1"].copy().view(np.int64)))
            probing, low, counts = probing[~crowded], low[~crowded], counts[~crowded]
        probe = probing
        ends = np.unique(np.append(np.searchsorted(np.cumsum(counts), np.arange(1_000_000, counts.sum(), 1_000_000)) + 1, len(probe)))
        for begin, end in zip(np.append(0, ends[:-1]), ends):
            some = slice(begin, end)
            n = counts[some]
            where = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a, b = np.repeat(probing[some], n), indexed[where]
            differ = a != b
            a, b = np.minimum(a[differ], b[differ]), np.maximum(a[differ], b[differ])
            if len(a):
                pairs = np.unique(np.stack([a, b], axis=1).view("u8,u8").ravel())
                out.append(batch(0, pairs["f0"].copy().view(np.int64), pairs["f1"].copy().view(np.int64)))
        return pa.Table.from_batches(out, schema)

    return lean_group(run)


def _texts_of(sent, bits: int, least: int):
    """The lines that may be in a candidate pair, by a bit table; others are passed over."""

    def run(batches):
        table = sent.value
        for batch in batches:
            keys, lines, seen = [], [], set()
            for _, _, line in _lines(batch.column(0).to_pylist(), least):
                key = line_key(line)
                at = key % bits
                if key not in seen and table[at >> 3] >> (at & 7) & 1:
                    seen.add(key)
                    keys.append(key)
                    lines.append(line)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, U64).view(np.int64)), pa.array(lines, pa.string())], ["line", "text"]
            )

    return lean(run)


def _pair_counts(texts: list[str], bins: int = 128) -> np.ndarray:
    """How often each pair of neighbouring code points is in each text, by hash bin."""
    sizes = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inner = owner[1:] == owner[:-1]
    pair = (points[:-1] * 31 + points[1:]) % bins
    flat = np.bincount(owner[1:][inner] * bins + pair[inner], minlength=len(texts) * bins)
    return flat.reshape(len(texts), bins).astype(np.int32)


def _crowd(edits: int):
    """Members of one signature to those with an earlier near line, by pairs of blocks.

    An edit takes at most two pairs of neighbours away and brings two, so lines whose
    counts differ by more than four for each edit need no verification.
    """

    def run(key, table):
        texts = table["text"].to_pylist()
        places = list(zip(*(table[c].to_pylist() for c in ("doc", "twin", "pos"))))
        block, line = table["block"].to_numpy(), table["line"].to_numpy()
        rank = np.empty(len(texts), np.int64)
        rank[sorted(range(len(texts)), key=places.__getitem__)] = np.arange(len(texts))
        counts, sizes = _pair_counts(texts), np.array([len(t) for t in texts])
        across = key[1].as_py() != key[2].as_py()
        late = []
        for i, text in enumerate(texts):
            near = (rank < rank[i]) & (np.abs(sizes - sizes[i]) <= edits)
            if across:
                near &= block != block[i]
            rivals = np.flatnonzero(near)
            rivals = rivals[np.abs(counts[rivals] - counts[i]).sum(axis=1) <= 4 * edits]
            if any(edit_distance_within(text, texts[j], edits) for j in rivals):
                late.append(line[i])
        release()
        return pa.table({"line": pa.array(np.array(late, np.int64))})

    return run


def near_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, edits: int = 2, least: int = 24,
    docs_per_group: int = 4096, bits: int = 2**24, crowd_rows: int = 1024,
) -> DataFrame:
    """``doc, twin, pos``: the places of all lines that stay, of those that count; see :func:`line_dedup`."""
    if least <= edits:
        raise ValueError("lines must be longer than the edits")
    spark = docs.sparkSession
    keyed = with_row_key(docs, id_col, text_col)
    groups = max(8, -(-docs.count() // docs_per_group))
    met = stage(
        keyed.mapInArrow(_spread(groups, least, edits), _ROWS)
        .groupBy("grp")
        .applyInArrow(_meet(edits), "kind int, line long, other long, doc long, twin long, pos long"),
        "line-pairs",
    )
    first = met.filter("kind = 2").select("line", "doc", "twin", "pos")
    pairs = met.filter("kind = 0").select("line", "other").distinct()
    crowds = met.filter("kind = 3").select("line", F.col("other").alias("sign"))

    # The texts of candidates: a bit table of fixed size lets most other lines pass by.
    ends = (
        pairs.select(F.explode(F.array("line", "other")).alias("line")).unionAll(crowds.select("line")).distinct()
    )

    def mark(batches):
        flags = np.zeros(bits, bool)
        for batch in batches:
            flags[(batch.column(0).to_numpy().view(U64) % U64(bits)).astype(np.int64)] = True
        packed_bits = np.packbits(flags, bitorder="little")
        used = np.flatnonzero(packed_bits.reshape(-1, 4096).any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array([packed_bits[i * 4096 : (i + 1) * 4096].tobytes() for i in used])],
                ["piece", "bits"],
            )

    table = np.zeros(bits // 8, np.uint8)
    for piece, part in ends.coalesce(16).mapInArrow(mark, "piece long, bits binary").collect():
        table[piece * 4096 : (piece + 1) * 4096] |= np.frombuffer(part, np.uint8)
    sent = spark.sparkContext.broadcast(table)
    texts = (
        keyed.select("text")
        .mapInArrow(_texts_of(sent, bits, least), "line long, text string")
        .groupBy("line")
        .agg(F.min("text").alias("text"))
        .join(ends, "line", "left_semi")
    )
    texts = stage(texts.join(first, "line"), "line-texts")
    side = lambda name, own: texts.select(
        F.col("line").alias(name), F.struct("doc", "twin", "pos").alias(f"at_{own}"), F.col("text").alias(f"text_{own}")
    )

    def verify(batches):
        for batch in batches:
            good = [edit_distance_within(a, b, edits) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], ["line"])

    # The later line of a verified pair goes.
    later = (
        pairs.join(side("line", "a"), "line")
        .join(side("other", "b"), "other")
        .select(F.when(F.col("at_a") > F.col("at_b"), F.col("line")).otherwise(F.col("other")).alias("late"), "text_a", "text_b")
        .mapInArrow(verify, "line long")
        .distinct()
    )
    # Crowds are cut into blocks; pairs of blocks meet within tasks, which return only
    # the lines that go.
    sizes = crowds.groupBy("sign").agg(F.ceil(F.count(F.lit(1)) / crowd_rows).cast("int").alias("parts"))
    settled = (
        crowds.join(sizes, "sign")
        .join(texts, "line")
        .withColumn("block", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "sign",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block", "line", "doc", "twin", "pos", "text",
        )
        .groupBy("sign", "low", "high")
        .applyInArrow(_crowd(edits), "line long")
    )
    later = later.unionAll(settled).distinct()
    return first.join(later, "line", "left_anti").select("doc", "twin", "pos")


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    edits: int = 2,
    least: int = 24,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Texts without lines that an earlier line equals or nearly equals.

    Returns ``doc_id, text, n_lines, n_dropped`` and the columns ``keep`` of ``docs``, a
    row per row.  A line (between line feeds) of at least ``least`` code points goes if a
    line within ``edits`` edits (insertions, deletions, substitutions of code points; 0
    for equal lines) starts earlier: in a document of smaller id or earlier in the same
    one.  Whether that line itself stays does not matter.  Shorter lines always stay.

    Lines are known by 64-bit hashes; what looks near is verified on the texts.  Equal
    lines meet once per task, so a line with a third of all places costs one row each.

    A text that is null or empty becomes empty.  Null ids come last.  Rows of one id and
    different texts are ordered by a hash of the text; rows equal in both are one
    document, and each gets its result.  An empty table gives an empty result.
    """
    stays = near_lines(docs, id_col, text_col, edits=edits, least=least)
    kept = stays.groupBy(F.col("doc").alias("__doc"), F.col("twin").alias("__twin")).agg(
        F.collect_set("pos").alias("__stays")
    )

    def cut(batches):
        for batch in batches:
            texts, total, dropped = [], [], []
            for text, stay in zip(batch.column("__text").to_pylist(), batch.column("__stays").to_pylist()):
                stay, lines = set(stay or ()), text.split("\n")
                left = [t for i, t in enumerate(lines) if i in stay or not eligible(t, least)]
                texts.append("\n".join(left))
                total.append(len(lines) if text else 0)
                dropped.append(len(lines) - len(left))
            rest = batch.select([n for n in batch.schema.names if n not in ("__text", "__stays")])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                [*rest.schema.names, "text", "n_lines", "n_dropped"],
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        *keep,
        text.alias("__text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("__doc"),
        F.xxhash64(text).alias("__twin"),
    )
    rows = rows.join(kept, ["__doc", "__twin"], "left").drop("__doc", "__twin")
    types = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("__text", "__stays")
    )
    return rows.mapInArrow(lean(cut), f"{types}, text string, n_lines long, n_dropped long")
