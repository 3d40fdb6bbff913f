"""Lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linkloom.llm import lexical_search as module
from linkloom.llm.lexical_search import _Block, _slabs, lexical_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(docs, items, k):
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        scores = []
        for doc, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(TERM.findall(lower(text)))
                if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(8)
    texts = [t for _, t in rows if t and t.strip()]
    out = []
    for i in range(25):
        words = rng.choice(texts).split()
        out.append((i, " ".join(rng.sample(words, min(len(words), 12)))))
    return out + [(30, None), (31, ""), (32, "?!"), (33, "NOWHEREtobefound"), (None, texts[0][:60]), (3, "X" * 400), (0, out[0][1])]


@pytest.mark.parametrize("block_terms", [200_000, 40])
def test_ranks(spark, docs, rows, items, block_terms):
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS doc_id", "'y' AS item")
    got = lexical_search(docs, asked, k=7, block_terms=block_terms)
    assert found(got) == ranked(rows, items, 7)


def test_every_item_gets_all_when_few_match(spark, docs, rows, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(lexical_search(docs, asked, k=1000)) == ranked(rows, items, 1000)


def test_repeated_documents_hold_a_place_each(spark, odd):
    data = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "alpha more"), (2, "first tau text")]
    got = lexical_search(odd, spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert found(got) == ranked(data, items, 3)


def test_empty_tables(spark, docs, none):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search(none, items).count() == 0
    assert lexical_search(docs, nothing).count() == 0
    assert lexical_search(none, nothing).columns == ["item_id", "rank", "doc_id", "score"]


def test_many_equal_copies_end_at_the_smallest_ids(spark):
    data = [(i, "one two three") for i in range(500)] + [(1000 + i, f"one other{i}") for i in range(50)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    items = [(1, "two one"), (2, "other3")]
    got = lexical_search(docs, spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert found(got) == ranked(data, items, 5)


def test_bounds_hold_and_exclude(rows):
    """No bound is below the exact score, and most are equal to it."""
    counts = [Counter(terms_of(t)) for _, t in rows]
    counts = [c for c in counts if c]
    hashes = module.WordHashes()
    docs = []
    for i, c in enumerate(counts):
        often = np.array(list(c.values()))
        h = hashes.of(list(c))
        parts = [h] + [module.mix(h[often >= n], level) for level, n in enumerate(module._LEVELS[1:], 1) if n <= often.max()]
        docs.append((i, 0, sum(c.values()), np.concatenate(parts), int(often.max())))
    df = Counter(t for c in counts for t in c)
    terms = sorted(df)[::3]

    rows_of = pa.table({"item": [0] * len(terms), "term": terms, "df": [df[t] for t in terms]})
    block = _Block(rows_of, len(counts), sum(sum(c.values()) for c in counts))
    equal = total = 0
    for ids, _, sizes, most, height, bits in _slabs(docs):
        bound = block.bounds(hashes.of(block.terms), sizes, most, height, bits)[0]
        for i, b in zip(ids, bound):
            exact = block.score(0, counts[i])
            # A level covers several numbers of occurrences, so long texts may lie above.
            assert b >= exact
            equal += b == exact
            total += 1
    assert equal > total / 3
