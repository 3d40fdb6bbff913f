import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from linkloom.operators import window_dedup
from linkloom.operators.window_dedup import Memory, drop_window_duplicates


def naive(rows, size):
    """Accepted positions, straight from the definition."""
    kept, accepted = [], []
    for ord_, url in rows:
        if url not in accepted[-size:]:
            accepted.append(url)
            kept.append(ord_)
    return kept


def run(spark, rows, size, max_rows=10**9, partition_by=()):
    df = spark.createDataFrame(rows, "ord long, url string" + ", host string" * bool(partition_by))
    df = df.repartition(3)
    got = drop_window_duplicates(df, size, ["ord"], partition_by, max_rows)
    assert got.columns == df.columns
    return sorted(r.ord for r in got.collect())


@pytest.mark.parametrize(
    "size, urls, kept",
    [
        (50, "XYZ", "012"),
        (50, "XYXXX", "01"),
        (1, "XYXXX", "012"),
        (0, "XXY", "02"),
        (2, "XYXZX", "0134"),
    ],
)
def test_small(spark, size, urls, kept):
    assert run(spark, list(enumerate(urls)), size) == [int(k) for k in kept]


def test_memory_does_not_refresh():
    memory = Memory(2)
    assert [memory.admit(u) for u in "abacab"] == [True, True, False, True, True, True]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.integers(0, 12), min_size=1, max_size=120),
    st.integers(1, 14),
    st.integers(3, 40),
)
def test_chunks_equal_the_definition(spark, numbers, size, max_rows):
    rows = [(i, f"u{n}") for i, n in enumerate(numbers)]
    assert run(spark, rows, size, max_rows) == naive(rows, size)


@pytest.mark.parametrize("size", [1, 3, 40, 5_000])
@pytest.mark.parametrize("kind", ["fresh", "few", "cycle", "phases"])
def test_long_sequences(spark, size, kind):
    rng = random.Random(size)
    number = {
        "fresh": lambda i: rng.randint(0, 2_000),
        "few": lambda i: rng.randint(0, 30),
        "cycle": lambda i: i % 41,
        "phases": lambda i: (i // 700) * 20 + rng.randint(0, 25),
    }[kind]
    rows = [(i, f"u{number(i)}") for i in range(3_000)]
    assert run(spark, rows, size, max_rows=300) == naive(rows, size)


def test_hot_sequence_among_others(spark):
    """A third of all rows in one sequence: it is cut, the others are not."""
    rng = random.Random(3)
    rows = []
    for i in range(3_000):
        host = "hot" if i % 3 == 0 else f"h{rng.randint(0, 40)}"
        rows.append((i, f"u{rng.randint(0, 25)}", host))
    want = sorted(
        ord_
        for host in {r[2] for r in rows}
        for ord_ in naive([(o, u) for o, u, h in rows if h == host], 8)
    )
    assert run(spark, rows, 8, max_rows=200, partition_by=["host"]) == want
    assert run(spark, rows, 8, partition_by=["host"]) == want


def test_missing_partition_value_is_a_sequence(spark):
    rows = [(0, "a", None), (1, "a", None), (2, "a", "h"), (3, "b", None)]
    assert run(spark, rows, 5, partition_by=["host"]) == [0, 2, 3]


def test_distinct_urls_decide_a_chunk_or_not():
    after = window_dedup._after
    assert after(["a", "b"], ["b", "a"], 2) == ["a", "b"]
    assert after(["a", "b"], ["c"], 2) == ["b", "c"]
    # "a" is seen, then pushed out by "c": a later row might bring it back.
    assert after(["a", "b"], ["a", "c"], 2) is None
    # "a" is pushed out before its first row, which then brings it back.
    assert after(["a", "b"], ["c", "a"], 2) == ["c", "a"]
    assert after(["a"], None, 2) is None
