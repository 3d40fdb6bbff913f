"""Byte-level BPE by speculation: longest match first, compatibility checks, exact merging where they fail."""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, text_of

#: How the tokenizer's pre-tokenizer cuts a text (a fixed value of the byte-level format).
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: The same for texts of nothing but ASCII and Latin-1 letters, without control characters.
_LETTER, _BLANK = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", "\t-\r "
_PLAIN = f"[\t-\r -~{_LETTER}]*"
_PLAIN_WORD = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_BLANK}{_LETTER}0-9]+"
    f"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_NONE = 2**62


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens numbered by rank: the 256 bytes, then each merge in its order.

    ``left`` and ``right`` give the two tokens that a merge joins, ``ids`` the number of
    each token in the file, ``special`` the strings that are tokens by themselves.
    """

    def __init__(self, content: str):
        file = json.loads(content)
        letters = _byte_letters()
        vocab = file["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        by_letter = {b: c for c, b in letters.items()}
        names = [by_letter[b] for b in range(256)] + [a + b for a, b in merges]
        own = {name: i for i, name in reversed(list(enumerate(names)))}
        self.ids = np.array([vocab[n] for n in names], np.int32)
        self.text = [bytes(letters[c] for c in n) for n in names]
        self.rank = {b: i for i, b in reversed(list(enumerate(self.text)))}
        self.left = np.array([*range(256), *(own[a] for a, _ in merges)], np.int64)
        self.right = np.array([*range(256), *(own[b] for _, b in merges)], np.int64)
        self.size = len(names)
        self.merge = {
            (int(a), int(b)): i + 256
            for i, (a, b) in reversed(list(enumerate(zip(self.left[256:], self.right[256:]))))
        }
        keys = self.left[256:] * self.size + self.right[256:]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_tokens = keys[order], order + 256
        # By the first two bytes: how long a token can be.
        self.longest: dict[bytes, int] = {}
        for token in self.text:
            self.longest[token[:2]] = max(len(token), self.longest.get(token[:2], 0))
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.bytes_of = {int(i): t for i, t in zip(self.ids, self.text)} | {
            i: s.encode() for s, i in self.special.items()
        }

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, or a number above all tokens."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_tokens[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours stays as it is under merging, all pairs at once.

        Walks back in time: the younger of the two tokens at the border is undone into
        its parts.  A merge across the border happens if it ranks before the merge that
        has used up one of its parts; at equal rank the one further left comes first.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), _NONE)
        while len(at):
            good[at[self.joins(a, b) < limit]] = False
            undo_left = a > b
            more = good[at] & ((undo_left & (a >= 256)) | (~undo_left & (b >= 256)))
            at, a, b, undo_left = at[more], a[more], b[more], undo_left[more]
            limit = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place, from the left."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        rank, longest, out, i, n = self.rank, self.longest.get, [], 0, len(word)
        while i < n:
            j = min(n, i + longest(word[i : i + 2], 1))
            while (token := rank.get(word[i:j])) is None:
                j -= 1
            out.append(token)
            i = j
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost first."""
        tokens = [self.rank[word[i : i + 1]] for i in range(len(word))]
        n = len(tokens)
        if n <= 24:
            return self._merged_short(tokens)
        after, before, merge = list(range(1, n + 1)), list(range(-1, n - 1)), self.merge
        heap = [
            (token, i, tokens[i], tokens[i + 1])
            for i in range(n - 1)
            if (token := merge.get((tokens[i], tokens[i + 1]))) is not None
        ]
        heapq.heapify(heap)
        while heap:
            token, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = token, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (new := merge.get((tokens[x], tokens[y]))) is not None:
                    heapq.heappush(heap, (new, x, tokens[x], tokens[y]))
        return [t for t in tokens if t >= 0]

    def _merged_short(self, tokens: list[int]) -> list[int]:
        """The same by looking at all pairs each time, which costs less for usual words."""
        merge = self.merge.get
        found = [merge(pair, _NONE) for pair in zip(tokens, tokens[1:])]
        while found and (best := min(found)) != _NONE:
            i = found.index(best)
            tokens[i : i + 2] = [best]
            del found[i]
            if i:
                found[i - 1] = merge((tokens[i - 1], best), _NONE)
            if i < len(found):
                found[i] = merge((best, tokens[i + 1]), _NONE)
        return tokens

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ranks of the tokens of each word: propose, check all neighbours, mend what fails."""
        proposed = [self.greedy(w) for w in words]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        inner = owner[1:] == owner[:-1]
        left, right = flat[:-1][inner], flat[1:][inner]
        pairs, place = np.unique(left * self.size + right, return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[place]
        for i in np.unique(owner[1:][inner][~good]):
            proposed[i] = self.merged(words[i])
        return proposed


def _load(spark, path: str):
    """The vocabulary file, read once on the driver; a few MB, whatever the data."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids`` for each row: the token ids of the whole text.

    Words are encoded once per task.  Special strings of the vocabulary are cut out
    first and become their own id.  Null and empty texts give an empty list; ids are
    passed on, null or repeated; other columns are not looked at.
    """
    sent = _load(docs.sparkSession, tokenizer)

    def run(batches):
        import regex

        vocabulary = Vocabulary(sent.value)
        any_cut, plain = regex.compile(WORD_PATTERN).findall, re.compile(_PLAIN).fullmatch
        plain_cut = re.compile(_PLAIN_WORD).findall
        cut = lambda text: plain_cut(text) if plain(text) else any_cut(text)
        special = (
            regex.compile(
                "(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len)[::-1])) + ")"
            )
            if vocabulary.special
            else None
        )
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for begin, end in slices(batch.column(1), 4_000_000):
                part = batch.slice(begin, end - begin)
                cuts = []
                for text in part.column(1).to_pylist():
                    if special is not None and any(s in text for s in vocabulary.special):
                        words = []
                        for i, piece in enumerate(special.split(text)):
                            if i % 2:
                                known[piece + "\0special"] = (vocabulary.special[piece],)
                                words.append(piece + "\0special")
                            else:
                                words += cut(piece)
                    else:
                        words = cut(text)
                    cuts.append(words)
                new = list(set(chain.from_iterable(cuts)).difference(known))
                for word, ranks in zip(new, vocabulary.encode_words([w.encode() for w in new])):
                    known[word] = tuple(vocabulary.ids[ranks].tolist())
                lists = [list(chain.from_iterable(map(known.__getitem__, w))) for w in cuts]
                offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    ["doc_id", "ids"],
                )
                if len(known) > 500_000:
                    known.clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(
        lean(run), "doc_id long, ids array<int>"
    )


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids, text``: the text of each list of token ids.

    Bytes that are no UTF-8 become U+FFFD.  A null list gives an empty text.
    """
    sent = _load(encoded.sparkSession, tokenizer)

    def run(batches):
        vocabulary = Vocabulary(sent.value)
        size = max(vocabulary.bytes_of) + 1
        data = b"".join(vocabulary.bytes_of.get(i, b"") for i in range(size))
        width = np.array([len(vocabulary.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        start = np.cumsum(width) - width
        data = np.frombuffer(data, np.uint8)
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            sizes = np.fromiter(
                (n or 0 for n in pa.compute.list_value_length(column).to_pylist()), np.int64, len(column)
            )
            ends = np.cumsum(sizes)
            texts = []
            for begin, end in zip(ends - sizes, ends):
                own = flat[begin:end]
                w = width[own]
                shift = np.repeat(start[own] - (np.cumsum(w) - w), w)
                texts.append(data[np.arange(len(shift)) + shift].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), column, pa.array(texts, pa.string())], ["doc_id", "ids", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids array<int>, text string")
