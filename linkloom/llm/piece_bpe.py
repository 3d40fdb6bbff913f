"""SentencePiece BPE by a table of prefixes: each prefix of a word has one last token."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, text_of

#: The sign that stands for a space in pieces (a fixed value of the format).
SPACE = "▁"
#: Kinds of pieces in a model file (fixed values of the format).
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown piece decodes to when the model file does not say (fixed value).
_UNKNOWN_TEXT = " ⁇ "


def _fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """Field numbers and values of one message of a model file."""
    out, at = [], 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value = data[at : at + size]
            at += size
        out.append((key >> 3, value))
    return out


class _Pairs(dict):
    """Whether a token may follow another, or stand first; tested once, emptied before it grows large."""

    LIMIT = 1_000_000

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= self.LIMIT:
            self.clear()
        before, token = pair
        if before == len(self.model.tokens):
            good = self.model.history(token)[3]
        else:
            good = self.model.compatible(before, token)
        self[pair] = good
        return good


class _Numbers:
    """Whole numbers to small whole numbers, put and looked up many at a time; absent ones give -1."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        scrambled = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (scrambled >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        at, todo = self._places(keys), np.arange(len(keys))
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (there >= 0)
            todo, at = todo[more], (at[more] + 1) & (len(self.keys) - 1)
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add different keys, none of which is there yet."""
        self.count += len(keys)
        if 3 * self.count > len(self.keys):
            held = self.keys >= 0
            old_keys, old_values = self.keys[held], self.values[held]
            self.__init__(int(3 * self.count).bit_length())
            self.put(np.append(old_keys, keys), np.append(old_values, values))
            return
        at = self._places(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.keys) - 1)


class PieceModel:
    """The pieces of a model file with their merge order, and the prefix table over them.

    Merging joins, again and again, the neighbours whose union is the piece of highest
    score, the leftmost first.  What two neighbouring tokens do under merging does not
    depend on their surroundings until a merge crosses their border, so a sequence of
    tokens is an encoding exactly if each single token and each pair of neighbours is.
    Hence the encoding of a prefix has one possible last token: the one that matches
    there and is compatible with the last token of the prefix before it.
    """

    def __init__(self, content: bytes):
        model = _fields(content)
        pieces = []
        for number, value in model:
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own.get(1, b"").decode(), score, own.get(3, _NORMAL)))
        trainer = dict(_fields(b"".join(v for n, v in model if n == 2)))
        normal = dict(_fields(b"".join(v for n, v in model if n == 3)))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("only BPE models with the space before the word are read")
        if normal.get(2, b"") or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only models without normalisation of the text are read")
        if any(kind in (_USER, _UNUSED) for _, _, kind in pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        self.prefix = bool(normal.get(3, 1))
        self.unknown_text = trainer.get(44, _UNKNOWN_TEXT.encode()).decode()
        self.pieces = pieces
        self.kinds = [kind for _, _, kind in pieces]
        self.unknown = self.kinds.index(_UNKNOWN)
        named = {piece: i for i, (piece, _, _) in enumerate(pieces)}
        self.end = named[trainer.get(47, b"</s>").decode()]
        self.score = {piece: score for piece, score, kind in pieces if kind == _NORMAL}
        bytes_of = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.byte_ids = [bytes_of[b] for b in range(256)] if trainer.get(35, 0) else None
        # Words end before a space sign unless a piece has one behind something else.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        # A letter that only stands inside longer pieces is a symbol of its own too.
        letters = set("".join(self.score)).difference(self.score)
        self.tokens = [*self.score, *letters]
        self.ids = [named[p] for p in self.score] + [None] * len(letters)
        self.letters = {t for t in self.tokens if len(t) == 1}
        self.widths = list(map(len, self.tokens))
        self.whole = not letters
        self.steps: dict[int, tuple] = {}
        self.pairs = _Pairs(self)
        self.good = _Numbers()
        self.code = None

    def _grow_tree(self) -> None:
        """The automaton as numbers: letters by code, edges by node and letter, the token of each node."""
        self.code = np.zeros(0x110000, np.int16)
        own = sorted(self.letters)
        self.code[[ord(c) for c in own]] = np.arange(1, len(own) + 1)
        self.base = len(own) + 1
        number = {c: i for i, c in enumerate(own, 1)}
        edges: dict[int, int] = {}
        token_at = [-1]
        for token, text in enumerate(self.tokens):
            node = 0
            for letter in text:
                node = edges.setdefault(node * self.base + number[letter], len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = token
        self.token_at = np.array(token_at, np.int32)
        self.edges = _Numbers()
        self.edges.put(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.first = self.edges.get(np.arange(self.base))
        self.width_of = np.array([*self.widths, 1], np.int64)
        self.id_of = np.array([-1 if i is None else i for i in self.ids], np.int32)

    def matcher(self):
        """The automaton that finds every token that ends at each place of a text."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for number, token in enumerate(self.tokens):
            machine.add_word(token, (number, len(token)))
        machine.make_automaton()
        return machine.iter

    def history(self, token: int) -> tuple[list[float], list[str], list[str], bool]:
        """How merging makes a token: scores in turn, first and last symbol before each, and the end."""
        found = self.steps.get(token)
        if found is None:
            symbols, score = list(self.tokens[token]), self.score.get
            scores, first, last = [], [symbols[0]], [symbols[-1]]
            while len(symbols) > 1:
                best = max(range(len(symbols) - 1), key=lambda i: score(symbols[i] + symbols[i + 1], -np.inf))
                joined = symbols[best] + symbols[best + 1]
                if joined not in self.score:
                    break
                symbols[best : best + 2] = [joined]
                scores.append(self.score[joined])
                first.append(symbols[0])
                last.append(symbols[-1])
            scores.append(-np.inf)
            found = self.steps[token] = (scores, first, last, len(symbols) == 1)
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of two tokens ends with just these two.

        Plays both histories in the order of their scores; the pair fails once the
        symbols at the border could be joined before either side's next merge.
        """
        scores_a, _, last, whole_a = self.history(a)
        scores_b, first, _, whole_b = self.history(b)
        i = j = 0
        score = self.score.get
        while whole_a and whole_b:
            next_a, next_b = scores_a[i], scores_b[j]
            across = score(last[i] + first[j])
            if across is not None and across > next_a and across >= next_b:
                return False
            if next_a == next_b == -np.inf:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1
        return False

    def _tokens(self, word: str, matches) -> list[int]:
        """Tokens of a word of known letters: the last one of every prefix, then back from the end."""
        begin, test = len(self.tokens), self.pairs
        # The place before the first letter is found at the end, with a sign for "no token".
        last: list[int | None] = [None] * len(word) + [begin]
        for end, (token, length) in matches(word):
            if last[end] is None and test[last[end - length], token]:
                last[end] = token
        out = []
        place = len(word) - 1
        while place >= 0:
            token = last[place]
            out.append(token)
            place -= self.widths[token]
        out.reverse()
        return out

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of many words of known letters at once, for models in which each letter is a piece.

        The automaton walks from every place of all words together.  The tables of prefixes
        fill in the order of the prefixes' lengths, one array operation for all words, and the
        tokens are marked from the ends of the words backwards.
        """
        if self.code is None:
            self._grow_tree()
        begin = len(self.tokens)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        # A sign that is no letter stands before each word and after the last.
        text = "\U0010ffff" + "\U0010ffff".join(words) + "\U0010ffff"
        codes = self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
        starts = np.cumsum(sizes + 1) - sizes
        origin = np.repeat(starts, sizes)
        place = np.arange(len(origin)) + np.repeat(np.arange(1, len(words) + 1), sizes)
        at, node, length = place, self.first[codes[place]], 1
        offset = place - origin
        ends, tokens, offsets = [], [], []
        while len(at):
            alive = node >= 0
            at, node, offset = at[alive], node[alive], offset[alive]
            token = self.token_at[node]
            match = token >= 0
            ends.append(at[match] + (length - 1))
            tokens.append(token[match])
            offsets.append((offset[match] + (length - 1)).astype(np.int16))
            node = self.edges.get(node.astype(np.int64) * self.base + codes[at + length])
            length += 1
        ends, tokens, offsets = map(np.concatenate, (ends, tokens, offsets))
        order = np.argsort(offsets, kind="stable")
        ends, tokens = ends[order], tokens[order].astype(np.int64)
        before = ends - self.width_of[tokens]
        cuts = np.append(0, np.cumsum(np.bincount(offsets)))
        last = np.full(len(codes), begin, np.int64)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            token = tokens[low:high]
            pair = last[before[low:high]] * (begin + 1) + token
            good = self.good.get(pair)
            if (new := good < 0).any():
                fresh, back = np.unique(pair[new], return_inverse=True)
                tested = [
                    self.compatible(a, b) if a < begin else self.history(b)[3]
                    for a, b in zip((fresh // (begin + 1)).tolist(), (fresh % (begin + 1)).tolist())
                ]
                tested = np.array(tested, np.int32)
                self.good.put(fresh, tested)
                good[new] = tested[back]
            stays = good > 0
            last[ends[low:high][stays]] = token[stays]
        marked = np.zeros(len(codes), bool)
        own, at = starts, starts + sizes - 1
        while len(at):
            marked[at] = True
            at = at - self.width_of[last[at]]
            more = at >= own
            at, own = at[more], own[more]
        counts = np.add.reduceat(marked, starts).tolist() if len(starts) else []
        flat = iter(self.id_of[last[np.flatnonzero(marked)]].tolist())
        return [tuple(islice(flat, n)) for n in counts]

    def encode_all(self, words: Iterable[str], matches) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Every word with its ids; long ones and those with letters of no piece go one by one."""
        held, size = [], 0
        for word in words:
            if self.whole and 0 < len(word) <= 100 and self.letters.issuperset(word):
                held.append(word)
                size += len(word)
                if size > 400_000:
                    yield from zip(held, self.encode_words(held))
                    held, size = [], 0
            else:
                yield word, tuple(self.encode_word(word, matches))
        if held:
            yield from zip(held, self.encode_words(held))
        if self.good.count > _Pairs.LIMIT:
            self.good = _Numbers()

    def encode_word(self, word: str, matches) -> list[int]:
        """Ids of a word; letters the model does not know join with nothing and cut it."""
        if self.letters.issuperset(word):
            tokens = self._tokens(word, matches)
            if self.whole:
                return list(map(self.ids.__getitem__, tokens))
            parts = [(self.ids[t], self.tokens[t]) for t in tokens]
        else:
            parts = []
            for known, run in groupby(word, self.letters.__contains__):
                if known:
                    parts += [(self.ids[t], self.tokens[t]) for t in self._tokens("".join(run), matches)]
                else:
                    parts += [(None, letter) for letter in run]
        out: list[int] = []
        for own, text in parts:
            if own is not None:
                out.append(own)
            elif self.byte_ids is not None:
                out += map(self.byte_ids.__getitem__, text.encode())
            elif not out or out[-1] != self.unknown:  # neighbouring unknown letters are one piece
                out.append(self.unknown)
        return out

    def decode_ids(self, ids: list[int]) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        out: list[str] = []
        held = bytearray()
        begun = False
        for i in ids:
            if self.kinds[i] == _BYTE:
                held.append(int(self.pieces[i][0][3:5], 16))
                continue
            if held:
                out.append(_text_of_bytes(bytes(held)))
                held.clear()
                begun = True
            if self.kinds[i] == _CONTROL:
                continue
            piece = self.unknown_text if self.kinds[i] == _UNKNOWN else self.pieces[i][0]
            if not begun and self.prefix and piece.startswith(SPACE):
                piece = piece[1:]
            begun = True
            out.append(piece.replace(SPACE, " "))
        if held:
            out.append(_text_of_bytes(bytes(held)))
        return "".join(out)


def _text_of_bytes(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            try:
                out.append(data[at : at + size].decode())
                at += size
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


def _load(spark, path: str):
    """The model file, read and checked once on the driver; under a MB, whatever the data."""
    with open(path, "rb") as file:
        content = file.read()
    PieceModel(content)
    return spark.sparkContext.broadcast(content)


def encode_pieces(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True
) -> DataFrame:
    """``doc_id, ids`` for each row: the piece ids of the whole text, then the end id.

    A task keeps the ids of words it has met, and the pairs it has tested.  Null and empty
    texts give the end id alone (an empty list without ``end``); doc ids are passed on,
    null or repeated; other columns are not looked at.
    """
    sent = _load(docs.sparkSession, model)

    def run(batches):
        pieces = PieceModel(sent.value)
        matches = pieces.matcher()
        # A line feed of no piece joins with nothing, so it ends words too.
        cut = re.compile(
            f"{SPACE}*[^{SPACE}]+|{SPACE}+" if "\n" in pieces.letters else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        ).findall
        head, tail = SPACE if pieces.prefix else "", [pieces.end] if end else []
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for begin, stop in slices(batch.column(1), 4_000_000):
                part = batch.slice(begin, stop - begin)
                texts = [
                    cut(marked) if pieces.cuts else [marked]
                    for marked in (
                        head + text.replace(" ", SPACE) if text else "" for text in part.column(1).to_pylist()
                    )
                ]
                known.update(pieces.encode_all(set(chain.from_iterable(texts)).difference(known), matches))
                lists = [[*chain.from_iterable(map(known.__getitem__, words)), *tail] for words in texts]
                offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "ids"]
                )
                if len(known) > 500_000:
                    known.clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(
        lean(run), "doc_id long, ids array<int>"
    )


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, text``: the text of each list of piece ids.

    Control ids give no text, an unknown id the model's sign for it.  A null list or a
    null id in it gives an empty text or nothing; an id the model does not have ends the query.
    """
    sent = _load(encoded.sparkSession, model)

    def run(batches):
        pieces = PieceModel(sent.value)
        # Bytes of every id; where they make no text, and for unknown, null and inner control ids, ids
        # are read one by one.
        known = [
            bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(SPACE, " ").encode() if kind == _NORMAL else b""
            for p, _, kind in pieces.pieces
        ]
        width = np.fromiter(map(len, known), np.int64, len(known))
        start = np.cumsum(width) - width
        data = np.frombuffer(b"".join(known), np.uint8)
        control = np.array([kind == _CONTROL for kind in pieces.kinds])
        spaced = np.array([kind == _NORMAL and p[0] == SPACE for p, _, kind in pieces.pieces]) & pieces.prefix
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten()
            whole = not flat.null_count
            flat = flat.to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            texts = []
            for low, high in zip((ends - sizes).tolist(), ends.tolist()):
                own = flat[low:high]
                if not whole or (own == pieces.unknown).any() or control[own[:-1]].any():
                    texts.append(pieces.decode_ids([int(i) for i in own if i == i]))
                    continue
                w = width[own]
                at = np.arange(int(w.sum())) + np.repeat(start[own] - (np.cumsum(w) - w), w)
                head = own[0] if len(own) else 0
                try:
                    text = data[at].tobytes().decode()
                    texts.append(text[1:] if spaced[head] else text)
                except UnicodeDecodeError:
                    texts.append(pieces.decode_ids(own.tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), column, pa.array(texts, pa.string())], ["doc_id", "ids", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids array<int>, text string")
