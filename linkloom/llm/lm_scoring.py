"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.workspace import stage

from .common import U64, WordHashes, by_block, lean, lean_group, mix, slices, text_of, words_of

_END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds a line feed
_START = xxhash.xxh3_64_intdigest(b"\n\n")
#: Bits of a pair's hash that are kept: with those of its segment enough for any corpus.
_PAIR_BITS = 48


def _tokens(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each closed by the end token, and the texts' lengths."""
    rows = [hashes.of(words_of(t)) for t in texts]
    sizes = np.array([len(r) + 1 for r in rows], np.int64)
    out = np.full(int(sizes.sum()), U64(_END))
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = np.concatenate(rows) if rows else []
    return out, sizes


def _pairs(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each token, and the hash of both; the start stands before a text."""
    before = np.concatenate([[U64(_START)], tokens[:-1]])
    before[np.cumsum(sizes) - sizes] = U64(_START)
    return before, mix(mix(before, 21) ^ tokens, 22)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.floor(np.log2(counts.astype(np.float64))).astype(np.int64) + 1


def least_of(levels: np.ndarray) -> np.ndarray:
    """The smallest count of a level; level 0 is no count."""
    return np.where(levels > 0, 2.0 ** (levels - 1), 0.0)


def most_of(levels: np.ndarray) -> np.ndarray:
    """The largest count of a level."""
    return 2.0**levels - 1


class LogFrequencyFilter:
    """Bits in segments; an n-gram of level ``q`` is a member together with 1, ..., q.

    ``starts`` are the first bits of the segments and the end; without them all are equal.
    """

    PROBES = 3
    #: For each n-gram and level: a quarter of the bits are set, a level is a false hit in one of 57.
    BITS = 10

    def __init__(self, bits: np.ndarray, segments: int, starts: np.ndarray | None = None):
        self.bits, self.segments = bits, segments
        if starts is None:
            starts = np.arange(segments + 1) * (len(bits) * 8 // segments)
        self.starts = starts.astype(U64)

    @staticmethod
    def segment(keys: np.ndarray, segments: int) -> np.ndarray:
        return (mix(keys, 31) >> U64(32)) % U64(segments)

    @classmethod
    def places(cls, keys: np.ndarray, level: int, probe: int, width: int | np.ndarray) -> np.ndarray:
        return mix(keys, 100 + level * cls.PROBES + probe) % np.asarray(width, U64)

    @classmethod
    def width_for(cls, entries: int, each: int = BITS) -> int:
        """Bits of a segment with so many pairs of n-gram and level, in whole bytes."""
        return max(64, -(-entries * each // 8) * 8)

    @classmethod
    def build(cls, keys: np.ndarray, levels: np.ndarray, width: int) -> np.ndarray:
        """The bytes of one segment."""
        flags = np.zeros(width, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            keys = keys[levels >= level]
            levels = levels[levels >= level]
            for probe in range(cls.PROBES):
                flags[cls.places(keys, level, probe, width)] = True
        return np.packbits(flags, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes, up to the first that fails."""
        found = np.zeros(len(keys), np.int64)
        segment = self.segment(keys, self.segments)
        base = self.starts[segment]
        width = self.starts[segment + U64(1)] - base
        at, level = np.arange(len(keys)), 0
        while len(at):
            level += 1
            for probe in range(self.PROBES):
                place = base[at] + self.places(keys[at], level, probe, width[at])
                hit = (self.bits[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1
                at = at[hit.astype(bool)]
            found[at] = level
        return found


# What moves between tasks, packed: sorted hashes and small numbers.


def pack_keys(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys of ``bits``: steps of the upper 16 bits, then the lower ones."""
    top = (keys >> U64(bits - 16)).astype(np.uint16)
    low = keys.astype(np.uint32)
    parts = [np.diff(top, prepend=np.uint16(0)), low]
    if bits == 64:
        parts.append((keys >> U64(32)).astype(np.uint16))
    return b"".join(p.tobytes() for p in parts)


def unpack_keys(data: bytes, bits: int) -> np.ndarray:
    n = len(data) // (bits // 8)
    top = np.cumsum(np.frombuffer(data, np.uint16, n), dtype=np.uint16).astype(U64)
    keys = top << U64(bits - 16) | np.frombuffer(data, np.uint32, n, 2 * n).astype(U64)
    if bits == 64:
        keys |= np.frombuffer(data, np.uint16, n, 6 * n).astype(U64) << U64(32)
    return keys


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each number; those from 255 on follow whole."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n:], np.int64)
    return counts


class _Slab:
    """The n-grams of a slab of documents: each distinct one with its place in a segment."""

    def __init__(self, texts: list[str], segments: int):
        tokens, self.sizes = _tokens(texts, WordHashes())
        _, both = _pairs(tokens, self.sizes)
        # The start token is the first context; it is counted once for each text.
        words = np.concatenate([tokens, np.full(len(self.sizes), U64(_START))])
        self.words, self.word_of = np.unique(words, return_inverse=True)
        self.pairs, self.pair_of = np.unique(both >> U64(64 - _PAIR_BITS), return_inverse=True)
        self.word_places = self._places(self.words, segments)
        self.pair_places = self._places(mix(self.pairs, 5), segments)

    @staticmethod
    def _places(keys: np.ndarray, segments: int) -> dict[int, np.ndarray]:
        own = LogFrequencyFilter.segment(keys, segments).astype(np.int64)
        return {s: at for s, (at,) in by_block(own, [np.arange(len(keys))])}

    def segments(self) -> list[int]:
        return sorted({*self.word_places, *self.pair_places})


_NOWHERE = np.zeros(0, np.int64)
_ASKED = "slab long, segment int, words binary, word_counts binary, pairs binary, pair_counts binary"
_REPLY = (
    "slab long, segment int, counts binary, word_levels binary, pair_levels binary, "
    "distinct long, entries long, n_bits long, n_set long"
)
_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "distinct long, entries long, n_bits long, n_set long"
)


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def _gather(segments: int):
    """A slab's distinct n-grams by segment, with their counts in its training documents."""

    def run(table: pa.Table) -> pa.Table:
        slab = _Slab(table["text"].to_pylist(), segments)
        train = ~table["held_out"].to_numpy()
        of_token = np.repeat(train, slab.sizes)
        weight = np.concatenate([of_token, train])
        words = np.bincount(slab.word_of, weight, len(slab.words)).astype(np.int64)
        pairs = np.bincount(slab.pair_of, of_token, len(slab.pairs)).astype(np.int64)
        rows = []
        for s in slab.segments():
            w, p = slab.word_places.get(s, _NOWHERE), slab.pair_places.get(s, _NOWHERE)
            rows.append(
                (
                    s,
                    pack_keys(slab.words[w], 64),
                    pack_counts(words[w]),
                    pack_keys(slab.pairs[p], _PAIR_BITS),
                    pack_counts(pairs[p]),
                )
            )
        number = table["slab"][0].as_py()
        columns = [pa.array([number] * len(rows), pa.int64())] + [
            pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])
        ]
        return pa.Table.from_arrays(columns, _names(_ASKED))

    return lean_group(run)


def _answer(bits_per_entry: int):
    """One segment: counts to the filter's bits, then probes of the bits for every slab that asks.

    Words are counted exactly as well.  The last row tells the segment's size.
    """

    def run(table: pa.Table) -> pa.Table:
        segment = table["segment"][0].as_py()

        def totals(keys: str, counts: str, bits: int):
            packed = [unpack_keys(k.as_py(), bits) for k in table[keys]]
            sizes = [len(k) for k in packed]
            own = np.concatenate([unpack_counts(c.as_py(), n) for c, n in zip(table[counts], sizes)])
            distinct, of = np.unique(np.concatenate(packed), return_inverse=True)
            total = np.bincount(of, own, len(distinct)).astype(np.int64)
            return distinct, total, np.split(of, np.cumsum(sizes)[:-1])

        words, word_total, word_of = totals("words", "word_counts", 64)
        pairs, pair_total, pair_of = totals("pairs", "pair_counts", _PAIR_BITS)
        pairs = mix(pairs, 5)
        known, count = np.concatenate([words, pairs]), np.concatenate([word_total, pair_total])
        known, count = known[count > 0], count[count > 0]
        levels = level_of(count)
        entries = int(levels.sum())
        bits = LogFrequencyFilter.build(known, levels, LogFrequencyFilter.width_for(entries, bits_per_entry))
        model = LogFrequencyFilter(bits, 1)
        word_levels = model.levels(words).astype(np.uint8)
        pair_levels = model.levels(pairs).astype(np.uint8)
        rows = [
            (slab, segment, pack_counts(word_total[w]), word_levels[w].tobytes(), pair_levels[p].tobytes(), *[None] * 4)
            for slab, w, p in zip(table["slab"].to_pylist(), word_of, pair_of)
        ]
        distinct = int(((word_total > 0) & (words != U64(_START))).sum())
        rows.append((-1 - segment, segment, *[None] * 3, distinct, entries, len(bits) * 8, int(np.unpackbits(bits).sum())))
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 4]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _names(_REPLY))

    return lean_group(run)


def _score(total: int, segments: int, strength: float):
    """Scores of a slab by what the segments replied; sizes of segments are passed on."""
    scale = 1.1 * total + 0.1

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            sizes = [replies[name] for name in _names(_SCORED)[6:]]
            empty = [pa.nulls(replies.num_rows, t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 2, *[pa.float64()] * 2)]
            return pa.Table.from_arrays([*empty, *sizes], _names(_SCORED))
        slab = _Slab(table["text"].to_pylist(), segments)
        counts = np.zeros(len(slab.words), np.int64)
        word_levels = np.zeros(len(slab.words), np.int64)
        pair_levels = np.zeros(len(slab.pairs), np.int64)
        if replies["segment"].to_pylist() != (asked := slab.segments()) and sorted(replies["segment"].to_pylist()) != asked:
            raise RuntimeError("a slab was not made of the same documents again")
        for s, *reply in zip(*(replies[name].to_pylist() for name in _names(_REPLY)[1:5])):
            w, p = slab.word_places.get(s, _NOWHERE), slab.pair_places.get(s, _NOWHERE)
            counts[w] = unpack_counts(reply[0], len(w))
            word_levels[w] = np.frombuffer(reply[1], np.uint8)
            pair_levels[p] = np.frombuffer(reply[2], np.uint8)
        sizes = slab.sizes
        starts = np.cumsum(sizes) - sizes
        word_of = slab.word_of[: int(sizes.sum())]
        context = np.empty(len(word_of))
        context[1:] = most_of(word_levels[word_of[:-1]])
        context[starts] = most_of(word_levels[slab.word_of[-1]])
        alone = (least_of(word_levels)[word_of] + 0.1) / scale
        pair = np.minimum(least_of(pair_levels)[slab.pair_of], context)
        chance = (pair + strength * alone) / (context + strength)
        count = counts[word_of]
        columns = [
            table["doc_id"],
            table["held_out"],
            pa.array(sizes),
            pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
            pa.array(np.add.reduceat(np.log10(count + 0.1), starts)),
            pa.array(np.add.reduceat(np.log10(chance), starts)),
            *[pa.nulls(len(sizes), pa.int64())] * 4,
        ]
        return pa.Table.from_arrays(columns, _names(_SCORED))

    def group(table: pa.Table, replies: pa.Table) -> pa.Table:
        return lean_group(lambda own: run(own, replies))(table)

    return group


def _token_counts(batches):
    """``rows, tokens``: documents, and tokens of training documents with their end tokens."""
    for batch in batches:
        rows = tokens = 0
        for begin, end in slices(batch.column(1), 4_000_000):
            part = batch.slice(begin, end - begin)
            for held, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows += 1
                tokens += 0 if held else len(words_of(text)) + 1
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([tokens])], ["rows", "tokens"])


def scored_slabs(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    docs_per_segment: int = 8192,
    docs_per_slab: int = 768,
    bits_per_entry: int = LogFrequencyFilter.BITS,
    strength: float = 4.0,
) -> tuple[DataFrame, int]:
    """The rows of :func:`lm_scores` before the last constant, rows of segment sizes, and the training tokens."""
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
        text_of(text_col).alias("text"),
    )
    counted = source.select("held_out", "text").mapInArrow(lean(_token_counts), "rows long, tokens long")
    rows, total = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("rows", "tokens")]).first()
    segments = 16
    while segments * docs_per_segment < rows:
        segments *= 2
    slabs = max(1, -(-rows // docs_per_slab))
    # Dealt by row number, so that no id or text can be too frequent for a slab.
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slabs)).alias("slab")
    dealt = source.select(number, "doc_id", "held_out", "text")
    replies = (
        dealt.groupBy("slab")
        .applyInArrow(_gather(segments), _ASKED)
        .groupBy("segment")
        .applyInArrow(_answer(bits_per_entry), _REPLY)
    )
    found = (
        dealt.groupBy("slab").cogroup(replies.groupBy("slab")).applyInArrow(_score(total, segments, strength), _SCORED)
    )
    return stage(found, "lm-scores"), total


def filter_report(scored: DataFrame) -> dict[str, float]:
    """Of :func:`scored_slabs`: ``distinct`` words, ``entries`` (n-gram and level), ``bits``, ``fill``, ``false_hits`` of a level."""
    rate = F.pow(F.col("n_set") / F.col("n_bits"), LogFrequencyFilter.PROBES)
    sizes = scored.filter("n_bits IS NOT NULL")
    row = sizes.agg(
        F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"),
        F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum("n_bits"), F.lit(0)).alias("bits"),
        F.coalesce(F.sum("n_set") / F.sum("n_bits"), F.lit(0.0)).alias("fill"),
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("false_hits"),
    ).first()
    return row.asDict()


def lm_scores(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    docs_per_segment: int = 8192,
    docs_per_slab: int = 768,
    bits_per_entry: int = LogFrequencyFilter.BITS,
    strength: float = 4.0,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row per row.

    The model learns from all rows where ``held_out`` is false.  Documents are dealt into slabs.  A
    slab sends its distinct words and word pairs with their counts to the segments of their
    hashes, which grow in number with the documents.  A segment quantises the counts to powers of
    two and puts them into its part of a Bloom filter, with ten bits (``bits_per_entry``) for each n-gram
    and level: a quarter of the bits are set, and a level is a false hit in one of 57, however large the
    corpus.  Repeated probes of these bits then give the levels of all that was asked,
    which go back to the slabs.  The plan is the same at every size.

    ``score`` is the sum of ``log10((c(v, w) + strength * p(w)) / (c(v) + strength))`` over the
    tokens, with levels from the filter: the smallest count of a level for ``c(v, w)`` and for
    ``p(w) = (c(w) + 0.1) / (1.1 N + 0.1)``, the largest one for the context ``c(v)``.  So the
    chances of all next words sum to one at most, but for false hits, which make a pair look
    seen and never a seen one unseen.

    ``base_score`` and ``n_known`` use exact counts of words, which the segments send too.

    Null and empty texts are the end token alone.  Without training rows ``train_tokens``
    is 0 and nothing is known.  Ids are passed on, null or repeated, and ``held_out``
    that is null counts as true; other columns are not looked at.
    """
    scored, total = scored_slabs(
        docs, held_out, id_col, text_col,
        docs_per_segment=docs_per_segment, docs_per_slab=docs_per_slab, bits_per_entry=bits_per_entry, strength=strength,
    )
    distinct = filter_report(scored)["distinct"]
    scale = float(np.log10(total + 0.1 * (distinct + 1)))
    return scored.filter("n_tokens IS NOT NULL").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )
