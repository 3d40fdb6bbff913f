"""SentencePiece encoding against the library, and the prefix table against plain merging."""

import random
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

from linkloom.llm.piece_bpe import SPACE, PieceModel, decode_pieces, encode_pieces
from linkloom.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as file:
        return PieceModel(file.read())


ODD = ["", " ", "  a  b ", "a\nb\r\n", "<s></s><unk><0x41>", "▁▁a ▁", "\x00​�", "😀é中文 Ａ", " " * 777 + "x" + " " * 50]


def test_round_trip_equals_the_library(spark, docs, rows, library):
    got = {r.doc_id: (r.ids, r.text) for r in decode_pieces(encode_pieces(docs, PATH), PATH).collect()}
    for doc, text in rows:
        ids = library.encode(text or "", add_eos=True)
        assert got[doc] == (ids, library.decode(ids))


def test_odd_and_very_long_texts(spark, library):
    rng = random.Random(4)
    texts = ODD + ["x" * 60_000, "ab\n" * 20_000, "".join(chr(rng.randrange(33, 0x3000)) for _ in range(30_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids")
    for r in decode_pieces(encode_pieces(df, PATH), PATH).collect():
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.ids == ids
        assert r.text == library.decode(ids)


def test_odd_rows(spark, odd, none, library):
    rows = encode_pieces(odd, PATH).collect()
    assert sorted(str((r.doc_id, r.ids)) for r in rows) == sorted(
        str((r.doc_id, library.encode(r.text or "", add_eos=True))) for r in odd.collect()
    )
    assert encode_pieces(none, PATH).count() == 0
    assert [r.ids for r in encode_pieces(odd.filter("text IS NULL"), PATH, end=False).collect()] == [[], []]
    lists = [(1, None), (2, []), (3, [None, 264])]
    got = decode_pieces(spark.createDataFrame(lists, "doc_id long, ids array<int>"), PATH).orderBy("doc_id")
    assert [r.text for r in got.collect()] == ["", "", "a"]


def test_words_at_once_equal_words_one_by_one(pieces, library):
    rng = random.Random(6)
    words = ["".join(rng.choice(pieces.tokens) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    words += [SPACE * n for n in range(1, 40)] + ["a", SPACE + "a"]
    words = [w for w in dict.fromkeys(words) if SPACE not in w.lstrip(SPACE)]
    matches = pieces.matcher()
    for word, ids in pieces.encode_all(words, matches):
        assert list(ids) == pieces.encode_word(word, matches)
        if word.startswith(SPACE) and word != SPACE:
            assert list(ids) == library.encode(word[1:].replace(SPACE, " "))


def test_any_ids_decode_as_in_the_library(spark, library):
    rng = random.Random(7)
    some = lambda: rng.choice([rng.randrange(3, 32_000), rng.randrange(3, 259), rng.choice([0, 1, 2, 28705, 259])])
    lists = [(i, [some() for _ in range(rng.randint(0, 8))]) for i in range(2000)]
    got = decode_pieces(spark.createDataFrame(lists, "doc_id long, ids array<int>"), PATH).collect()
    for r in got:
        assert r.text == library.decode(r.ids), r.ids


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2, len(value)]) if number < 16 else bytes([number << 3 & 127 | 130, number >> 4, len(value)])
            out += value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3, value]) if number < 16 else bytes([number << 3 & 127 | 128, number >> 4, value])
    return out


def _small_model(pieces, byte_fallback=0):
    kinds = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((p, s, 1) for p, s in pieces)]
    listed = [(1, _message((1, p.encode()), (2, s), (3, k))) for p, s, k in kinds]
    return _message(*listed, (2, _message((3, 2), (35, byte_fallback))), (3, _message((3, 1), (4, 0), (5, 1))))


@pytest.mark.parametrize("seed", range(6))
def test_models_whose_merges_do_not_go_by_length(seed):
    """Random vocabularies: scores in any order, letters that are no piece, several ways to one piece."""
    rng = random.Random(seed)
    found = {SPACE} | ({"a", "b", "c"} if seed % 2 else {"a", "b"})
    while len(found) < 40:
        found.add("".join(rng.choice("abc" + SPACE * (seed == 3)) for _ in range(rng.randint(2, 5))))
    content = _small_model([(p, -float(i)) for i, p in enumerate(rng.sample(sorted(found), len(found)))])
    model, matches = PieceModel(content), None
    matches = model.matcher()
    library = sentencepiece.SentencePieceProcessor(model_proto=content)
    for _ in range(2000):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 25)))
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        assert model.encode_word(marked, matches) == library.encode(text), text


def test_other_models_are_refused(pieces):
    with pytest.raises(ValueError, match="BPE"):
        PieceModel(_message((2, _message((3, 1)))))
    with pytest.raises(ValueError, match="normalisation"):
        PieceModel(_message((2, _message((3, 2))), (3, _message((4, 1)))))
