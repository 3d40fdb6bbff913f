"""Small helpers that several operators share: hashing, words, row keys, packed arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_MIX = U64(0xBF58476D1CE4E5B9)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values; different seeds give independent orders."""
    h = (values + U64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) & (2**64 - 1))) * _GOLD
    h ^= h >> U64(29)
    h *= _MIX
    return h ^ (h >> U64(32))


def release() -> None:
    """Give memory that a finished task held back to the system: Python workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(run):
    """A function over batches that releases memory when it ends."""

    def stream(batches):
        yield from run(batches)
        release()

    return stream


def lean_group(run):
    """The same for a function over one group."""

    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    return group


class WordHashes(dict):
    """Word -> 64-bit hash, remembered within one task; emptied before it grows large."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc`` (the id, nulls last), ``twin`` (hash of the text), ``text``.

    Rows that repeat an id are told apart by their text; rows equal in both are one
    document, and every one of them gets that document's result.
    """
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"),
        F.xxhash64(text_of(text_col)).alias("twin"),
        text_of(text_col).alias("text"),
    )


def id_back(doc: Column) -> Column:
    return F.when(doc < F.lit(2**63 - 1), doc)


def by_block(
    block: np.ndarray, arrays: list[np.ndarray]
) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Cut parallel arrays into one piece for each block number, keeping their order."""
    if not len(block):
        return
    order = np.argsort(block, kind="stable")
    block = block[order]
    cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
    ends = np.append(cuts, len(block))
    arrays = [a[order] for a in arrays]
    begin = 0
    for end in ends:
        yield int(block[begin]), [a[begin:end] for a in arrays]
        begin = end


def packed(schema: pa.Schema, rows: list[tuple], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows; arrays become binary values."""
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(
                    [v.tobytes() if isinstance(v, np.ndarray) else v for v in column], field.type
                )
                for column, field in zip(zip(*part), schema)
            ],
            schema=schema,
        )


def joined(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """All arrays of a binary column, one after the other."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype) if data else np.zeros(0, dtype)


def lengths(column: pa.Array | pa.ChunkedArray, item: int) -> np.ndarray:
    """How many items of ``item`` bytes each binary value of a column holds."""
    return np.fromiter(map(len, column.to_pylist()), np.int64, len(column)) // item


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.append(0, np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1)
    return starts, np.diff(np.append(starts, len(sorted_values)))


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into row ranges of about ``most`` bytes of text (one row at least)."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).tolist()
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield begin, len(sizes)
