"""Removal of byte strings that occur earlier in the collection, by column-wise refinement.

A string of ``length`` bytes that repeats has the same rarest-looking ``gram`` bytes in
it wherever it stands (the smallest hash of all grams inside).  These anchors are a few
hundredths of all positions, and only they are shuffled:

* anchors with the same gram and the same bytes around it (all windows that hold the
  gram) repeat in full: every one but the first is covered as a whole;
* of the rest one anchor for each surrounding is compared with the others of its gram.
  Their surroundings are a collection of short documents which is ordered column by
  column: each round takes one more symbol of every document and updates the ranks of
  the collection, once outwards to the right and once to the left.  Two windows are
  equal when their ranks at the depth of both sides are.

The construction over whole documents would take as many rounds as the longest one has
bytes, each a pass over all data; anchored surroundings take ``length - gram`` rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.workspace import stage

from .common import U64, id_back, lean, mix, runs, slices, with_row_key

_OUTSIDE = 256
_SLAB = 200_000
_GIANT = 1_000_000


def _symbols() -> np.ndarray:
    return mix(np.arange(1, _OUTSIDE + 2, dtype=U64), 11) | U64(1)


def _power(n: int) -> np.uint64:
    return U64(pow(0xD6E8FEB86659FD93, n, 2**64))


def _longer(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of 2n symbols from those of n symbols."""
    out = h[:-n] * _power(n)
    out += h[n:]
    return out


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of each ``width`` values in a row."""
    n = 1
    while 2 * n <= width:
        values = pick(values[:-n], values[n:])
        n *= 2
    return pick(values[: len(values) - (width - n)], values[width - n :]) if width > n else values


def _anchors(sym: np.ndarray, valid: np.ndarray, length: int, gram: int, table: np.ndarray):
    """Positions, gram hashes and surroundings' hashes; ``valid`` marks the starts of windows."""
    margin = length - gram
    by_size = {1: table[sym]}
    n = 1
    while 2 * n <= length + margin:
        by_size[2 * n] = _longer(by_size[n], n)
        n *= 2
    order = mix(by_size[gram]) | U64(1)
    least = _extreme(order, margin + 1, np.minimum)
    least = np.where(valid[: len(least)], least, U64(0))
    pad = np.zeros(margin, U64)
    most = _extreme(np.concatenate([pad, least, pad]), margin + 1, np.maximum)
    at = np.flatnonzero((order[: len(most)] == most[: len(order)]) & (most[: len(order)] > 0))
    around = np.zeros(len(at), U64)
    begin, left = at - margin, length + margin
    for n in sorted(by_size, reverse=True):
        while left >= n:
            around = around * _power(n) + by_size[n][begin]
            begin = begin + n
            left -= n
    return at, by_size[gram][at], mix(around)


def _of_docs(texts: list[bytes], length: int, gram: int, table: np.ndarray):
    """Anchors of several documents at once: document number, position, gram, surroundings."""
    margin = length - gram
    gap = np.full(margin, _OUTSIDE, np.uint16)
    sizes = np.array([len(t) for t in texts])
    parts = [gap]
    for t in texts:
        parts += [np.frombuffer(t, np.uint8), gap]
    sym = np.concatenate(parts)
    starts = margin + np.cumsum(sizes + margin) - (sizes + margin)
    step = np.zeros(len(sym) + 1, np.int32)
    fits = sizes >= length
    np.add.at(step, starts[fits], 1)
    np.add.at(step, (starts + sizes - length + 1)[fits], -1)
    at, grams, around = _anchors(sym, np.cumsum(step) > 0, length, gram, table)
    doc = np.searchsorted(starts, at, "right") - 1
    return doc, at - starts[doc], grams, around


def _of_giant(text: bytes, length: int, gram: int, table: np.ndarray):
    """The same for one very long document, piece by piece."""
    margin, found = length - gram, []
    for begin in range(0, max(len(text) - length + 1, 1), _GIANT):
        last = min(begin + _GIANT, len(text) - length + 1)
        low, high = max(0, begin - margin), min(len(text), last + length + margin)
        edge = [np.full(margin - (begin - low), _OUTSIDE, np.uint16), np.full(2 * length, _OUTSIDE, np.uint16)]
        sym = np.concatenate([edge[0], np.frombuffer(text[low:high], np.uint8), edge[1]])
        valid = np.zeros(len(sym), bool)
        valid[margin : margin + last - begin] = True
        at, grams, around = _anchors(sym, valid, length, gram, table)
        found.append((at - margin + begin, grams, around))
    at, grams, around = map(np.concatenate, zip(*found))
    at, first = np.unique(at, return_index=True)
    return np.zeros(len(at), np.int64), at, grams[first], around[first]


_ANCHOR = "key long, around long, doc long, twin long, pos int, until int"


def _find(length: int, gram: int):
    """Anchors of a batch of documents, each surroundings once; repeats are covered at once."""

    def run(batches):
        table = _symbols()
        for batch in batches:
            docs, twins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for begin, end in slices(batch.column(2), _SLAB):
                texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).slice(begin, end - begin).to_pylist()]
                if not any(len(t) >= length for t in texts):
                    continue
                if len(texts) == 1 and len(texts[0]) > _GIANT:
                    number, *rest = _of_giant(texts[0], length, gram, table)
                else:
                    number, *rest = _of_docs(texts, length, gram, table)
                size = np.array([len(t) for t in texts], np.int32)[number]
                found.append((number + begin, *rest, size))
            if not found:
                continue
            number, pos, key, around, size = map(np.concatenate, zip(*found))
            doc, twin = docs[number], twins[number]
            order = np.lexsort((pos, twin, doc, around, key))
            key, around, doc, twin, pos, size = (x[order] for x in (key, around, doc, twin, pos, size))
            same = lambda *columns: np.append(False, np.all([c[1:] == c[:-1] for c in columns], axis=0))
            # A document that stands here twice is no repeat of itself.
            new = ~same(key, around, doc, twin, pos)
            key, around, doc, twin, pos, size = (x[new] for x in (key, around, doc, twin, pos, size))
            again = same(key, around)
            # Rows that repeat here need no anchor: they go on as what they cover, merged.
            until = np.where(again, np.minimum(pos + length, size), -1).astype(np.int32)
            pos = np.where(again, np.maximum(pos - (length - gram), 0), pos).astype(np.int32)
            keep = np.flatnonzero(~again)
            cover = np.flatnonzero(again)
            cover = cover[np.lexsort((pos[cover], twin[cover], doc[cover]))]
            if len(cover):
                d, t, b, e = doc[cover], twin[cover], pos[cover], until[cover]
                fresh = np.ones(len(cover), bool)
                fresh[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (b[1:] > e[:-1])
                starts = np.flatnonzero(fresh)
                until[cover[starts]] = np.maximum.reduceat(e, starts)
                cover = cover[starts]
                key[cover] = mix(doc[cover].view(U64) + U64(5) * twin[cover].view(U64), 3)
            rows = np.concatenate([keep, cover])
            columns = [key.view(np.int64), around.view(np.int64), doc, twin, pos, until]
            for i in range(0, len(rows), 50_000):
                some = rows[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[some]) for c in columns], ["key", "around", "doc", "twin", "pos", "until"]
                )

    return lean(run)


_ASKED = "key long, doc long, twin long, pos int, hot boolean, before binary, after binary"


def _surroundings(length: int, gram: int):
    """Bytes around each asked anchor; for grams of very many anchors the windows' hashes instead."""
    margin = length - gram
    inverse = pow(0xD6E8FEB86659FD93, -1, 2**64)

    def powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, U64(base))
        out[:1] = 1
        return np.multiply.accumulate(out)

    def run(batches):
        table = _symbols()
        for batch in batches:
            for begin, end in slices(batch.column(2), 4_000_000):
                part = batch.slice(begin, end - begin)
                out = [[] for _ in range(7)]
                for doc, twin, text, asked in zip(*(c.to_pylist() for c in part.columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    hot = np.array([a["pos"] for a in asked if a["hot"]], np.int64)
                    for a in asked:
                        if not a["hot"]:
                            p = a["pos"]
                            row = (a["key"], doc, twin, p, False, data[max(0, p - margin) : p], data[p + gram : p + length])
                            for column, value in zip(out, row):
                                column.append(value)
                    if len(hot):
                        n = len(data)
                        sums = np.concatenate(
                            [[U64(0)], np.cumsum(table[np.frombuffer(data, np.uint8)] * powers(0xD6E8FEB86659FD93, n))]
                        )
                        starts = np.unique((hot[:, None] - np.arange(margin + 1)).ravel())
                        starts = starts[(starts >= 0) & (starts <= n - length)]
                        hashes = mix((sums[starts + length] - sums[starts]) * powers(inverse, n)[starts])
                        for column, values in zip(
                            out,
                            (hashes.view(np.int64).tolist(), [doc] * len(starts), [twin] * len(starts), starts.tolist(), [True] * len(starts), [None] * len(starts), [None] * len(starts)),
                        ):
                            column += values
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, types)],
                    ["key", "doc", "twin", "pos", "hot", "before", "after"],
                )

    return lean(run)


def _side(values: list[bytes], width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Symbols going outwards, one row each, and how many there are."""
    sizes = np.array([len(v) for v in values])
    out = np.full((width, len(values)), _OUTSIDE, np.int64)
    flat = np.frombuffer(b"".join(v[::-1] for v in values) if backwards else b"".join(values), np.uint8)
    row = np.repeat(np.arange(len(values)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
    return out, sizes


def _ranks(group: np.ndarray, columns: np.ndarray) -> list[np.ndarray]:
    """Ranks of the collection after each inserted column; equal rank means equal so far."""
    ranks = [group]
    for column in columns:
        _, rank = np.unique(ranks[-1] * (_OUTSIDE + 1) + column, return_inverse=True)
        ranks.append(rank)
    return ranks


def _refine(length: int, gram: int):
    """Rows sorted by key, then document and position, to what each anchor's windows repeat."""
    margin = length - gram

    def solve(rows: pa.Table) -> pa.RecordBatch:
        names = ["key", "doc", "twin", "pos"]
        new = np.any([np.diff(rows[c].to_numpy(), prepend=-1) != 0 for c in names], axis=0)
        new[0] = True
        rows = rows.filter(pa.array(new))
        key = rows["key"].to_numpy()
        group = np.cumsum(np.append(0, key[1:] != key[:-1]))
        before, has_before = _side(rows["before"].to_pylist(), margin, True)
        after, has_after = _side(rows["after"].to_pylist(), margin, False)
        left, right = _ranks(group, before), _ranks(group, after)
        most = np.full(len(key), -1)
        least = np.full(len(key), margin + 1)
        for back in range(margin + 1):
            fits = np.flatnonzero((has_before >= back) & (has_after >= margin - back))
            if not len(fits):
                continue
            same = left[back][fits] * (len(key) + 1) + right[margin - back][fits]
            _, first, of = np.unique(same, return_index=True, return_inverse=True)
            later = fits[first[of] != np.arange(len(fits))]
            most[later] = back
            least[later] = np.minimum(least[later], back)
        hit = np.flatnonzero(most >= 0)
        pos = rows["pos"].to_numpy()[hit]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows["doc"].to_numpy()[hit]),
                pa.array(rows["twin"].to_numpy()[hit]),
                pa.array((pos - most[hit]).astype(np.int32)),
                pa.array((pos - least[hit] + length).astype(np.int32)),
            ],
            ["doc", "twin", "pos", "until"],
        )

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            key = rows["key"].to_numpy()
            whole = int(runs(key)[0][-1]) if len(key) else 0
            held = rows.slice(whole)
            if whole:
                yield solve(rows.slice(0, whole))
        if held is not None and held.num_rows:
            yield solve(held)

    return lean(run)


def _cut(batches):
    """Texts and their covered intervals, sorted, to what is left."""
    for batch in batches:
        out = [[] for _ in range(6)]
        for doc, twin, text, covered in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode("utf-8", "surrogatepass")
            kept, at, removed, spans = [], 0, 0, 0
            end = -1
            for c in covered or ():
                begin, until = c["pos"], min(c["until"], len(data))
                if begin > end:
                    spans += 1
                    kept.append(data[at:begin])
                begin = max(begin, at)
                if until > begin:
                    removed += until - begin
                end = at = max(end, until)
            kept.append(data[at:])
            for column, value in zip(out, (doc, twin, len(data), removed, spans, b"".join(kept))):
                column.append(value)
        types = [pa.int64()] * 5 + [pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, types)],
            ["doc", "twin", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    length: int = 100,
    gram: int = 32,
    hot_anchors: int = 4096,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes), one row per row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a
    document of smaller id, or earlier in the same one.  Overlaps count, strings are
    judged on the input, and none crosses documents.  ``gram`` is a power of two below
    ``length``.

    Equal bytes are recognised by 64-bit hashes of grams and surroundings and, within
    the rounds, by themselves.  A gram of more than ``hot_anchors`` anchors isn't
    gathered in one place: each window around it is dealt out by its own hash, and only
    its first place meets the rest.

    Null and empty texts are empty.  Rows with a null id come after all others.  Rows of
    one id and different texts are different documents, in the order of a hash of the
    text; rows equal in both are one document, of which each row gets the result.  Other
    columns are not looked at; an empty table gives an empty result.
    """
    keyed = with_row_key(docs, id_col, text_col)
    found = keyed.mapInArrow(_find(length, gram), _ANCHOR)
    line = W.partitionBy("key").orderBy("around", "doc", "twin", "pos")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = ["doc", "twin", "pos"]
    hits = stage(
        found.select(
            "*",
            F.lag("around").over(line).alias("last_around"),
            *[F.lag(c).over(line).alias(f"last_{c}") for c in place],
            F.first("around").over(whole).alias("low"),
            F.last("around").over(whole).alias("high"),
            F.count(F.lit(1)).over(whole).alias("anchors"),
        )
        # A document that stands in the table twice is no repeat of itself.
        .filter("NOT (until < 0 AND last_around <=> around AND last_doc <=> doc AND last_twin <=> twin AND last_pos <=> pos)")
        .withColumn("again", F.expr("last_around <=> around"))
        .filter("until >= 0 OR again OR low <> high")
        .select("key", *place, "until", "again", (F.col("anchors") > hot_anchors).alias("hot")),
        "anchors",
    )
    margin = length - gram
    covered = hits.filter("until >= 0").select(*place, "until").unionAll(
        hits.filter("until < 0 AND again").select(
            "doc", "twin", F.greatest(F.col("pos") - margin, F.lit(0)).alias("pos"), (F.col("pos") + length).alias("until")
        )
    )
    asked = (
        hits.filter("until < 0 AND NOT again")
        .groupBy("doc", "twin")
        .agg(F.collect_list(F.struct("key", "pos", "hot")).alias("asked"))
    )
    around = stage(
        keyed.join(asked, ["doc", "twin"])
        .select("doc", "twin", "text", "asked")
        .mapInArrow(_surroundings(length, gram), _ASKED),
        "surroundings",
    )
    refined = (
        around.filter("NOT hot")
        .select("key", *place, "before", "after")
        .repartition("key")
        .sortWithinPartitions("key", *place)
        .mapInArrow(_refine(length, gram), "doc long, twin long, pos int, until int")
    )
    windows = around.filter("hot").select("key", *place).distinct()
    first = windows.groupBy("key").agg(F.min(F.struct(*place)).alias("first"))
    repeated = windows.join(first, "key").filter(F.struct(*place) > F.col("first"))
    covered = covered.unionAll(refined).unionAll(
        repeated.select(*place, (F.col("pos") + length).alias("until"))
    )
    spans = covered.groupBy("doc", "twin").agg(
        F.sort_array(F.collect_set(F.struct("pos", "until"))).alias("covered")
    )
    return (
        keyed.join(spans, ["doc", "twin"], "left")
        .select("doc", "twin", "text", "covered")
        .mapInArrow(lean(_cut), "doc long, twin long, n_bytes long, n_removed long, n_spans long, kept binary")
        .select(id_back(F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
    )
