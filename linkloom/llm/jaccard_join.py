"""Similarity self-join on sets of word n-grams with adaptive multi-match prefixes.

Two documents are linked when the Jaccard similarity of their shingle sets reaches the
threshold.  Equal sets are one class throughout.  The shingles have one global order,
rare before frequent.  A set of ``n`` shingles with a partner shares at least
``need = ceil(threshold * n)`` of them with it, so two partners share at least ``m``
shingles among the first ``n - need + m`` of each.  Each class picks its own ``m`` by
estimated candidate cost; a pair must share ``min(m)`` prefix shingles before it is
verified.

Most classes have so many shingles of their own that these fill the prefix: they can
have no partner and leave before any pair is formed.  The rest is grouped into sets
that are connected by prefix shingles; groups are cut into blocks, and pairs of blocks
are joined within tasks, which return only a spanning forest of the verified links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.workspace import stage

from .common import U64, WordHashes, by_block, joined, lean, lean_group, mix, packed, runs, slices, text_of, words_of
from .components import components

#: a: shingles; b, c, d: per run of one class its key, its number of shingles here, its set size;
#: e: in how many classes each shingle occurs.  Rows of kind 2 hold documents: ids, sizes, keys.
_ROWS = "kind int, grp int, a binary, b binary, c binary, d binary, e binary"
_ARROW = pa.schema(
    [("kind", pa.int32()), ("grp", pa.int32()), *[(x, pa.binary()) for x in "abcde"]]
)
_NO_ID = np.iinfo(np.int64).max


def shingles(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; fewer words than ``size`` are one shingle."""
    if not words:
        return np.zeros(0, U64)
    h = hashes.of(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, U64(len(words) if len(words) < size else size))
    for i in range(min(size, len(h))):
        out = mix(out ^ h[i : i + n])
    return np.unique(out)


def _emit(kind: int, group: np.ndarray, token: np.ndarray, owner: np.ndarray, size=None, df=None):
    """Postings packed by group: the owner, and its size if given, are written once for each run."""
    given = [a for a in (size, df) if a is not None]
    for grp, (t, o, *rest) in by_block(group, [token, owner, *given]):
        starts, counts = runs(o)
        s = rest.pop(0)[starts].astype(np.uint32) if size is not None else b""
        yield kind, grp, t, o[starts], counts.astype(np.uint32), s, rest[0].astype(np.uint32) if rest else b""


def _postings(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Shingles, owners, sizes and frequencies of packed rows, one entry for each posting."""
    counts = joined(rows["c"], np.uint32).astype(np.int64)
    return (
        joined(rows["a"], U64),
        np.repeat(joined(rows["b"], U64), counts),
        np.repeat(size, counts) if len(size := joined(rows["d"], np.uint32)) == len(counts) else None,
        joined(rows["e"], np.uint32),
    )


def _distinct(token: np.ndarray, owner: np.ndarray, *more: np.ndarray | None, by_owner: bool):
    """Sorted by shingle or by owner, each pair once."""
    order = np.lexsort((token, owner) if by_owner else (owner, token))
    token, owner = token[order], owner[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return [token[fresh], owner[fresh], *[m if m is None else m[order][fresh] for m in more]]


def _need(size: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * size.astype(np.int64) // 100)


def _read(docs: DataFrame, words: int, token_blocks: int, chunks: int, heavy: int) -> DataFrame:
    """Documents to packed postings by shingle block, and the documents' sizes and classes."""

    def run(batches):
        hashes = WordHashes()
        sent: set[int] = set()
        for batch in batches:
            for begin, end in slices(batch.column(1), 3_000_000):
                part = batch.slice(begin, end - begin)
                ids = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                sets = [shingles(words_of(t), words, hashes) for t in part.column(1).to_pylist()]
                size = np.array([len(s) for s in sets], np.int64)
                key = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], U64)
                rows = list(
                    (2, grp, i, n, k, b"", b"")
                    for grp, (i, n, k) in by_block(
                        (mix(key) % U64(chunks)).astype(np.int32), [ids, size, key]
                    )
                )
                # One document of each class, once for this task.
                first = [i for i, k in enumerate(key.tolist()) if size[i] and k not in sent and not sent.add(k)]
                if len(sent) > 2_000_000:
                    sent.clear()
                if first:
                    token, owner = np.concatenate([sets[i] for i in first]), np.repeat(key[first], size[first])
                    # A shingle of many classes here is frequent everywhere: it need not
                    # be counted, and its postings are dealt out by class, not by shingle.
                    _, place, count = np.unique(token, return_inverse=True, return_counts=True)
                    often = count[place] >= heavy
                    # Two of them are counted all the same, for other tasks to meet.
                    counted = ~often
                    at = np.flatnonzero(often)
                    at = at[np.argsort(token[at], kind="stable")]
                    starts, _ = runs(token[at])
                    counted[at[starts]] = counted[at[starts + 1]] = True
                    group = (mix(token, 1) % U64(token_blocks)).astype(np.int32)
                    rows += _emit(0, group[counted], token[counted], owner[counted])
                    group = (mix(owner, 2) % U64(token_blocks)).astype(np.int32)
                    rows += _emit(1, group[often], token[often], owner[often])
                yield from packed(_ARROW, rows, 64)

    return docs.mapInArrow(lean(run), _ROWS)


def _shared(rows: DataFrame, chunks: int, with_counts: bool) -> DataFrame:
    """By shingle block: only the postings of shingles that several classes have, dealt to chunks of classes."""

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        out = []
        for k in (0, 1):
            token, owner, size, _ = _postings(table.filter(pa.array(kind == k)))
            if k == 0:
                token, owner, size = _distinct(token, owner, size, by_owner=False)
                starts, counts = runs(token)
                df = np.repeat(counts, counts)
                keep = df > 1
                token, owner, df = token[keep], owner[keep], df[keep]
                size = size if size is None else size[keep]
            else:
                df = np.zeros(len(token), np.int64)
            order = np.argsort(owner, kind="stable")
            token, owner, df = token[order], owner[order], df[order]
            size = size if size is None else size[order]
            chunk = (mix(owner) % U64(chunks)).astype(np.int32)
            out += _emit(0, chunk, token, owner, size, df if with_counts else None)
        batches = list(packed(_ARROW, out))
        documents = table.filter(pa.array(kind == 2))
        return pa.Table.from_batches(
            batches + documents.cast(_ARROW).to_batches() if documents.num_rows else batches, _ARROW
        )

    return rows.groupBy("grp").applyInArrow(lean_group(run), _ROWS)


def _alive(rows: DataFrame, token_blocks: int, percent: int) -> DataFrame:
    """By chunk of classes: drop the classes whose own shingles fill the prefix."""

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        token, owner, _, _ = _postings(table.filter(pa.array(kind == 0)))
        token, owner = _distinct(token, owner, by_owner=True)
        starts, counts = runs(owner)
        # The sizes come with the documents, which are dealt out by class as well.
        documents = table.filter(pa.array(kind == 2)).cast(_ARROW)
        keys, first = np.unique(joined(documents["c"], U64), return_index=True)
        n = joined(documents["b"], np.int64)[first][np.searchsorted(keys, owner[starts])]
        alive = np.repeat(n - counts < n - _need(n, percent) + 1, counts)
        token, owner, size = token[alive], owner[alive], np.repeat(n, counts)[alive]
        group = (mix(token, 1) % U64(token_blocks)).astype(np.int32)
        batches = list(packed(_ARROW, list(_emit(0, group, token, owner, size))))
        return pa.Table.from_batches(batches + documents.to_batches(), _ARROW)

    return rows.groupBy("grp").applyInArrow(lean_group(run), _ROWS)


def _prefixes(rows: DataFrame, percent: int, levels: tuple[int, ...], verify_cost: float) -> DataFrame:
    """By chunk of classes: each class's ``m``, its prefix and all shingles it shares."""
    schema = pa.schema(
        [
            ("cls", pa.int64()),
            ("n", pa.int64()),
            ("level", pa.int32()),
            ("prefix", pa.list_(pa.int64())),
            ("tokens", pa.binary()),
        ]
    )

    def run(table: pa.Table) -> pa.Table:
        token, owner, size, df = _postings(table)
        order = np.lexsort((token, df, owner))
        token, owner, size, df = token[order], owner[order], size[order], df[order]
        out = []
        for begin, count in zip(*runs(owner)):
            own, often = token[begin : begin + count], df[begin : begin + count].astype(np.int64)
            n = int(size[begin])
            need = -(-percent * n // 100)
            slots = n - need + 1 - (n - count)  # of the prefix, left to shared shingles
            if slots <= 0:
                continue
            met = np.cumsum(often - 1)
            best = None
            for level in levels:
                taken = min(slots + level - 1, count)
                if level > need:
                    break
                cost = met[taken - 1] * (1 + verify_cost / level)
                if best is None or cost < best[0]:
                    best = (cost, level, taken)
            _, level, taken = best
            out.append((int(owner[begin].astype(np.int64)), n, level, own[:taken].view(np.int64), np.sort(own)))
        if not out:
            return schema.empty_table()
        columns = list(zip(*out))
        prefix = pa.ListArray.from_arrays(
            np.cumsum([0, *map(len, columns[3])]).astype(np.int32), pa.array(np.concatenate(columns[3]))
        )
        return pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns[:3], schema)]
            + [prefix, pa.array([t.tobytes() for t in columns[4]], pa.binary())],
            schema=schema,
        )

    return rows.groupBy("grp").applyInArrow(
        lean_group(run), "cls long, n long, level int, prefix array<bigint>, tokens binary"
    )


class _Forest:
    """Which rows of a block are connected already."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[j] = i
        return i != j


def _verify(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks: count common prefix shingles, verify what has enough, return a forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(key, table):
        one_block = key[1].as_py() == key[2].as_py()
        cls, n = table["cls"].to_numpy(), table["n"].to_numpy()
        level, second = table["level"].to_numpy(), table["block"].to_numpy() != key[1].as_py()
        prefixes = table["prefix"].combine_chunks()
        if isinstance(prefixes, pa.ChunkedArray):
            prefixes = prefixes.chunk(0)
        width = np.diff(prefixes.offsets.to_numpy())
        local, prefix = np.unique(prefixes.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        starts = np.cumsum(width) - width
        tokens = [np.frombuffer(t, U64) for t in table["tokens"].to_pylist()]
        sizes = np.array([len(t) for t in tokens])
        every, flat = np.unique(np.concatenate(tokens), return_inverse=True)
        begins = np.cumsum(sizes) - sizes
        in_prefix, in_set = np.zeros(len(local), bool), np.zeros(len(every), bool)
        forest, links, degree = _Forest(len(cls)), [], np.zeros(len(cls), np.int64)
        for i in range(len(cls)):
            if not one_block and second[i]:
                continue
            own = prefix[starts[i] : starts[i] + width[i]]
            in_prefix[own] = True
            shared = np.add.reduceat(in_prefix[prefix].astype(np.int32), starts)
            in_prefix[own] = False
            ok = shared >= np.minimum(level, level[i])
            ok &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
            if one_block:
                ok[: i + 1] = False
            else:
                ok &= second
            rivals = np.flatnonzero(ok)
            if not len(rivals):
                continue
            mine = flat[begins[i] : begins[i] + sizes[i]]
            in_set[mine] = True
            for at in range(0, len(rivals), 256):
                some = rivals[at : at + 256]
                ends = np.cumsum(sizes[some])
                where = np.repeat(begins[some] - (ends - sizes[some]), sizes[some]) + np.arange(ends[-1])
                common = np.add.reduceat(in_set[flat[where]].astype(np.int64), ends - sizes[some])
                for j in some[100 * common >= percent * (n[i] + n[some] - common)]:
                    degree[[i, j]] += 1
                    if forest.join(i, int(j)):
                        links.append((cls[i], cls[j], 0))
            in_set[mine] = False
        links += [(c, c, d) for c, d in zip(cls, degree) if d]
        columns = [np.array(c, np.int64) for c in zip(*links)] or [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)

    return blocks.groupBy("group", "low", "high").applyInArrow(run, "a long, b long, links long")


def _documents(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids, n, key = joined(table["a"], np.int64), joined(table["b"], np.int64), joined(table["c"], U64)
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == _NO_ID), pa.array(n), pa.array(key.view(np.int64), mask=n == 0)],
                    ["doc_id", "n_shingles", "cls"],
                )

    return rows.filter("kind = 2").select("a", "b", "c").mapInArrow(
        run, "doc_id long, n_shingles long, cls long"
    )


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    words: int = 5,
    percent: int = 80,
    docs_per_block: int = 2048,
    heavy: int = 8,
    levels: tuple[int, ...] = (1, 2, 4, 8),
    verify_cost: float = 8.0,
    block_rows: int = 1024,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``, one row per row of ``docs``.

    Documents link when ``100 * |A and B| >= percent * |A or B|`` for their sets of
    ``words``-word shingles (A-Z in lower case, words between ASCII blanks; fewer words
    are one shingle).  ``component_id`` is the smallest id reachable by links,
    ``n_links`` the number of other distinct sets a document's set is linked with.

    Shingles and sets are known by 64-bit hashes.  All rows and whole texts take part,
    and no candidate is dropped other than by the bounds given in the module's text.

    Null, empty and blank texts have no shingle and link with nothing, not even with
    each other; their component is their own id.  Repeated rows are one class and each
    is returned.  Null ids never are a component's id unless all its ids are null.
    Other columns are not looked at; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    total = docs.count()
    blocks = max(8, -(-total // docs_per_block))
    chunks = max(8, -(-total // docs_per_block))
    shared = _shared(_read(source, words, blocks, chunks, heavy), chunks, False)
    alive = stage(_alive(shared, blocks, percent), "shared-shingles")
    counted = _shared(alive.filter("kind = 0"), chunks, True)
    sets = stage(_prefixes(counted, percent, levels, verify_cost), "prefixes")

    # Classes that share a prefix shingle, tied to the smallest class that has it.
    postings = sets.select("cls", F.explode("prefix").alias("token"))
    least = postings.groupBy("token").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("df"))
    ties = postings.join(least.filter("df > 1"), "token").filter("cls <> b").select(F.col("cls").alias("a"), "b")
    groups = components(ties)
    parts = groups.groupBy("component").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts")
    )
    dealt = (
        sets.join(groups, F.col("cls") == F.col("node"))
        .join(parts, "component")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.col("component").alias("group"),
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block",
            "cls",
            "n",
            "level",
            "prefix",
            "tokens",
        )
    )
    links = stage(_verify(dealt, percent), "jaccard-links")
    linked = components(links.filter("a <> b"))
    degrees = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))

    documents = _documents(alive)
    classes = (
        documents.filter("cls IS NOT NULL")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("least"))
        .join(linked, F.col("cls") == F.col("node"), "left")
        .withColumn("component", F.coalesce("component", "cls"))
        .drop("node")
    )
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = (
        classes.join(smallest, "component")
        .join(degrees, F.col("cls") == F.col("node"), "left")
        .select(F.col("cls").alias("own"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    return documents.join(classes, F.col("cls") == F.col("own"), "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
