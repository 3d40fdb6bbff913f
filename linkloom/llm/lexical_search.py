"""Ranked lexical search over bit-sliced Bloom signatures, with exact rescoring."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.workspace import stage

from .common import U64, WordHashes, by_block, id_back, joined, lean, mix, slices, text_of, with_row_key

#: Bytes between terms become blanks, A-Z small letters; what is not ASCII stays.
_TERMS = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
    for b in range(256)
)
#: Occurrences from which a signature holds a further entry of a term.
_LEVELS = [1, 2, 3, 4, *(x << i for i in range(1, 40) for x in (3, 4))]
#: Rows that an entry sets in its document's signature, and the least rows a document has for each
#: entry: a fifth of a signature is set at most, and a term is taken to be there wrongly less than
#: once in ten thousand.
_PROBES, _ROWS_PER_ENTRY = 6, 24
#: Terms whose slices are made at once.
_TERMS_AT_ONCE = 8192
_SLAB_BITS = 1 << 25
_FILTER_BITS = 1 << 22


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, small letters and whatever is not ASCII, in order."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


def _probe_rows(entries: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """The rows of a signature of ``rows`` (a power of two) that each entry sets."""
    at, step = mix(entries, 40), mix(entries, 41) | U64(1)
    for _ in range(_PROBES):
        yield (at & U64(rows - 1)).astype(np.int64)
        at = at + step


def _slabs(docs: list[tuple]):
    """Signatures of documents ``(doc, twin, n, entries, most)``: equal heights together.

    A signature has a power of two rows, by how many entries the document has, so long
    documents are no denser than short ones; a slab holds at most ``_SLAB_BITS`` bits.
    """
    sizes = np.array([len(d[3]) for d in docs], np.int64)
    heights = 1 << np.ceil(np.log2(np.maximum(64, sizes * _ROWS_PER_ENTRY))).astype(np.int64)
    for rows in np.unique(heights).tolist():
        members = np.flatnonzero(heights == rows)
        width = max(8, min(4096, _SLAB_BITS // rows))
        for begin in range(0, len(members), width):
            part = [docs[i] for i in members[begin : begin + width]]
            bits = np.zeros((rows, -(-len(part) // 8) * 8), bool)
            entries = np.concatenate([d[3] for d in part])
            column = np.repeat(np.arange(len(part)), [len(d[3]) for d in part])
            for place in _probe_rows(entries, rows):
                bits[place, column] = True
            yield (
                np.array([d[0] for d in part], np.int64),
                np.array([d[1] for d in part], np.int64),
                np.array([d[2] for d in part], np.int64),
                max(d[4] for d in part),
                rows,
                np.packbits(bits, axis=1),
            )


_INDEX = (
    "docs binary, twins binary, sizes binary, most long, height int, bits binary, "
    "term binary, df long, occurrences long"
)


def _build_index(docs: DataFrame, asked_bits) -> DataFrame:
    """Slabs of signatures, and each task's counts of terms that may be asked for.

    The counting rows hold a term and its documents; the one without a term holds the
    documents with any term and all their terms.
    """
    names = [f.split(" ")[0] for f in _INDEX.split(", ")]

    def run(batches):
        asked = np.unpackbits(np.frombuffer(asked_bits.value, np.uint8)).view(bool)
        hashes = WordHashes()
        counts: Counter = Counter()
        documents = occurrences = 0
        held: list[tuple] = []
        held_entries = 0

        def flush():
            for ids, twins, sizes, most, rows, bits in _slabs(held):
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([a.tobytes()], pa.binary()) for a in (ids, twins, sizes)),
                        pa.array([most], pa.int64()),
                        pa.array([rows], pa.int32()),
                        pa.array([bits.tobytes()], pa.binary()),
                        pa.array([None], pa.binary()),
                        pa.array([None], pa.int64()),
                        pa.array([None], pa.int64()),
                    ],
                    names,
                )

        for batch in batches:
            for begin, end in slices(batch.column(2), 4_000_000):
                part = batch.slice(begin, end - begin)
                for doc, twin, text in zip(*(c.to_pylist() for c in part.columns)):
                    terms = terms_of(text)
                    if not terms:
                        continue
                    documents += 1
                    occurrences += len(terms)
                    own = Counter(terms)
                    names_of = list(own)
                    hashed = hashes.of(names_of)
                    for i in np.flatnonzero(asked[(hashed % U64(len(asked))).astype(np.int64)]):
                        counts[names_of[i]] += 1
                    often = np.fromiter(own.values(), np.int64, len(own))
                    entries, most = [hashed], int(often.max())
                    for level, least in enumerate(_LEVELS[1:], 1):
                        if least > most:
                            break
                        entries.append(mix(hashed[often >= least], level))
                    entries = np.concatenate(entries)
                    held.append((doc, twin, len(terms), entries, most))
                    held_entries += len(entries)
                    if len(held) >= 4096 or held_entries >= 2_000_000:
                        yield from flush()
                        held, held_entries = [], 0
                if len(counts) >= 500_000:
                    yield _count_rows(counts, names)
                    counts = Counter()
        if held:
            yield from flush()
        if documents:
            counts_batch = _count_rows(counts, names)
            yield counts_batch
            yield _count_rows({None: documents}, names, occurrences)

    return docs.mapInArrow(lean(run), _INDEX)


def _count_rows(counts: dict, names: list[str], occurrences: int | None = None) -> pa.RecordBatch:
    n = len(counts)
    return pa.RecordBatch.from_arrays(
        [
            *(pa.nulls(n, pa.binary()) for _ in range(3)),
            pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.int32()),
            pa.nulls(n, pa.binary()),
            pa.array(list(counts), pa.binary()),
            pa.array(list(counts.values()), pa.int64()),
            pa.array([occurrences] * n, pa.int64()),
        ],
        names,
    )


class _Block:
    """A block of items as it is sent: distinct terms with weights, and each item's terms."""

    def __init__(self, rows: pa.Table, documents: int, occurrences: int):
        self.documents, self.occurrences = documents, occurrences
        self.items, item = np.unique(rows["item"].to_numpy(), return_inverse=True)
        terms = rows["term"].to_pylist()
        self.terms = sorted(set(terms))
        place = {t: i for i, t in enumerate(self.terms)}
        df = np.zeros(len(self.terms))
        owner = np.fromiter(map(place.__getitem__, terms), np.int64, len(terms))
        df[owner] = rows["df"].to_numpy()
        self.weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        self.owned = [np.zeros(0, np.int64)] * len(self.items)
        for i, (own,) in by_block(item, [owner]):
            self.owned[i] = own
        self.place = {item: i for i, item in enumerate(self.items.tolist())}

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """``m`` of documents with these numbers of terms."""
        return 50 + (50 * sizes * self.documents) // self.occurrences

    def score(self, item: int, own: Counter) -> int:
        """The exact score of a document's term counts."""
        size = sum(own.values())
        m = int(self.lengths(np.array([size]))[0])
        total = 0
        for t in self.owned[self.place[item]].tolist():
            tf = own.get(self.terms[t], 0)
            if tf:
                total += int(self.weight[t]) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        return total

    def bounds(self, hashes: np.ndarray, sizes: np.ndarray, most: int, rows: int, bits: np.ndarray):
        """For each item, an upper bound of the score of each document of a slab.

        A term's slice is the union of the rows it sets; where all are set the term may
        be there.  Slices of higher levels add what more occurrences can add.
        """
        m = self.lengths(sizes)
        levels = [i for i, least in enumerate(_LEVELS) if least <= most]
        gain, before = [], np.zeros(len(m), np.int64)
        for i in levels:
            top = min(most, _LEVELS[i + 1] - 1)
            upper = (1_000_000_000 * top) // (1000 * top + 20 * m)
            gain.append(upper - before)
            before = upper
        total = np.zeros((len(self.items), len(m)), np.int64)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for begin in range(0, len(hashes), _TERMS_AT_ONCE):
            alive = np.arange(begin, min(begin + _TERMS_AT_ONCE, len(hashes)))
            slices_ = None
            for i in levels:
                entries = hashes[alive] if i == 0 else mix(hashes[alive], i)
                for place in _probe_rows(entries, rows):
                    slices_ = bits[place] if slices_ is None else slices_ & bits[place]
                there = slices_.any(axis=1)
                alive, slices_ = alive[there], slices_[there]
                if not len(alive):
                    break
                for t, slice_ in zip(alive.tolist(), slices_):
                    at = np.flatnonzero(np.unpackbits(slice_, count=len(m)))
                    if i == 0:
                        found[t] = at, gain[0][at]
                    else:
                        # Documents of a higher level are among those of the one before.
                        first, value = found[t]
                        value[np.searchsorted(first, at)] += gain[i][at]
        for i, own in enumerate(self.owned):
            for t in own.tolist():
                if t in found:
                    at, value = found[t]
                    total[i, at] += self.weight[t] * value
        return total


def _search(index: DataFrame, block, k: int, floors) -> DataFrame:
    """``item, doc, twin``: the ``k`` largest bounds of each item and task, or all that reach the floors.

    ``floors`` gives for each item a score and a document; whatever has a smaller bound,
    or the same and a larger id, is proven to come after it.
    """

    def run(batches):
        own: _Block = block.value
        limits = None if floors is None else floors.value
        hashes = WordHashes().of(own.terms)
        n = len(own.items)
        best = [(np.zeros(0, np.int64),) * 3 for _ in range(n)]

        def rows(item, bound, doc, twin):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(doc), own.items[item])),
                    pa.array(bound),
                    pa.array(doc),
                    pa.array(twin),
                ],
                ["item", "bound", "doc", "twin"],
            )

        for batch in batches:
            for docs, twins, sizes, most, height, bits in zip(*(c.to_pylist() for c in batch.columns)):
                docs, twins, sizes = (np.frombuffer(x, np.int64) for x in (docs, twins, sizes))
                matrix = np.frombuffer(bits, np.uint8).reshape(height, -1)
                total = own.bounds(hashes, sizes, most, height, matrix)
                for i in range(n):
                    score = total[i]
                    if limits is None:
                        keep = np.flatnonzero(score)
                        if len(best[i][0]) == k:
                            keep = keep[score[keep] >= best[i][0][-1]]
                        merged = [
                            np.append(a, b[keep]) for a, b in zip(best[i], (score, docs, twins))
                        ]
                        order = np.lexsort((merged[1], -merged[0]))[:k]
                        best[i] = tuple(a[order] for a in merged)
                    else:
                        floor, last = limits[i]
                        keep = (score > floor) | ((score == floor) & (docs <= last) & (floor > 0))
                        if keep.any():
                            yield rows(i, score[keep], docs[keep], twins[keep])
        if limits is None:
            for i in range(n):
                if len(best[i][0]):
                    yield rows(i, *best[i])

    return index.mapInArrow(lean(run), "item long, bound long, doc long, twin long")


def _rescore(docs: DataFrame, found: DataFrame, block) -> DataFrame:
    """``item, doc, twin, score``: exact scores of the found pairs, a row per document row.

    Texts that nothing was found for mostly stay where they are: a bit table of fixed
    size tells which documents may be among the found, before the others are joined.
    """
    spark = docs.sparkSession
    asked = found.groupBy("doc", "twin").agg(F.collect_set("item").alias("items"))
    slot = F.pmod(F.xxhash64("doc", "twin"), F.lit(_FILTER_BITS))
    slots = asked.select(slot.alias("slot")).distinct().toArrow()["slot"].to_numpy()
    table = np.zeros(_FILTER_BITS, bool)
    table[slots] = True
    sent = spark.sparkContext.broadcast(np.packbits(table).tobytes())

    def few(batches):
        table = np.unpackbits(np.frombuffer(sent.value, np.uint8)).view(bool)
        for batch in batches:
            keep = table[batch.column(3).to_numpy(zero_copy_only=False)]
            if keep.any():
                yield batch.filter(pa.array(keep)).select([0, 1, 2])

    def run(batches):
        own: _Block = block.value
        for batch in batches:
            rows = []
            for doc, twin, text, items in zip(*(c.to_pylist() for c in batch.columns)):
                counts = Counter(terms_of(text))
                rows += [(item, doc, twin, own.score(item, counts)) for item in items]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["item", "doc", "twin", "score"]
            )

    return (
        docs.withColumn("slot", slot)
        .mapInArrow(lean(few), "doc long, twin long, text string")
        .join(asked, ["doc", "twin"])
        .select("doc", "twin", "text", "items")
        .mapInArrow(lean(run), "item long, doc long, twin long, score long")
        .filter("score > 0")
    )


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = 200_000,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents for each item.

    Documents are indexed once as signatures, bit-sliced by slabs of up to 4,096
    documents, with entries for a term and for its occurrences from 2, 3, 4, 6, 8, 12, ... on.
    A search adds up weighted slices to an upper bound of each document's score.  The
    documents of the ``k`` largest bounds are scored exactly; their k-th score excludes
    every document whose bound is lower, and all others are scored exactly.

    Items are searched in blocks of about ``block_terms`` different terms of an item, which
    bounds what is sent to the tasks, but for a single longer item.  Rows that repeat an
    item's id and text are one item; rows with one id and different texts are ranked each.
    Every row of ``docs`` is a document, repeated ones too; equal scores go by id, nulls
    last.  Null and empty texts have no terms: such items have no rows, such documents
    are not found.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = with_row_key(docs, id_col, text_col)
    item = items.select(
        F.xxhash64(F.col(item_col).cast("string"), text_of(item_text_col)).alias("item"),
        F.col(item_col).cast("long").alias("item_id"),
        text_of(item_text_col).alias("text"),
    )

    def split(batches):
        hashes = WordHashes()
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sorted(set(terms_of(text)))
                slots = (hashes.of(own) % U64(_FILTER_BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(own), pa.int64()), pa.array(own, pa.binary()), pa.array(slots)],
                    ["item", "term", "slot"],
                )

    item_terms = stage(
        item.select("item", "text").distinct().mapInArrow(lean(split), "item long, term binary, slot long"),
        "item-terms",
    )
    asked = np.zeros(_FILTER_BITS, bool)
    asked[item_terms.select("slot").distinct().toArrow()["slot"].to_numpy()] = True
    index = stage(_build_index(rows, spark.sparkContext.broadcast(np.packbits(asked).tobytes())), "signatures")
    counts = index.filter("df IS NOT NULL").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences")
    )
    counts = stage(counts, "term-counts")
    totals = counts.filter("term IS NULL").first()
    out = None
    if totals is not None:
        slabs = index.filter("df IS NULL").select("docs", "twins", "sizes", "most", "height", "bits")
        weighted = stage(item_terms.join(counts.select("term", "df"), "term"), "item-weights")
        blocks = max(1, -(-weighted.count() // block_terms))
        for number in range(blocks):
            own = weighted.filter(F.pmod("item", F.lit(blocks)) == number).select("item", "term", "df").toArrow()
            if not own.num_rows:
                continue
            found = _ranked_block(rows, slabs, _Block(own, totals.df, totals.occurrences), k)
            out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.join(item.select("item", "item_id").distinct(), "item").select(
        "item_id", "rank", id_back(F.col("doc")).alias("doc_id"), "score"
    )


def _ranked_block(rows: DataFrame, slabs: DataFrame, own: _Block, k: int) -> DataFrame:
    """``item, rank, doc, score`` for the items of one block."""
    spark = rows.sparkSession
    block = spark.sparkContext.broadcast(own)
    by_bound = W.partitionBy("item").orderBy(F.desc("bound"), "doc", "twin")
    by_score = W.partitionBy("item").orderBy(F.desc("score"), "doc", "twin")
    place = F.row_number()
    seeds = stage(
        _search(slabs, block, k, None).withColumn("rank", place.over(by_bound)).filter(F.col("rank") <= k),
        "seeds",
    )
    scored = _rescore(rows, seeds, block).withColumn("rank", place.over(by_score)).filter(F.col("rank") == k)
    floors = np.zeros((len(own.items), 2), np.int64)
    for r in scored.select("item", "score", "doc").collect():  # at most one row for each item of the block
        floors[own.place[r.item]] = r.score, r.doc
    found = stage(_search(slabs, block, k, spark.sparkContext.broadcast(floors)), "not-excluded")
    ranked = _rescore(rows, found, block).withColumn("rank", place.over(by_score)).filter(F.col("rank") <= k)
    return stage(ranked.select("item", "rank", "doc", "score"), "ranked")
