"""Conversation repair against a plain recursion over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from linkloom.llm.conversations import conversation_reports, damage, repair

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Cost, audit and lines of the best repair of ``(role, text, fault)`` rows."""
    insert = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "user", 3: "assistant"}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        if inserts < 2:
            c, a, t = get(i, insert[state], inserts + 1)
            options.append((c + 2, "I" + a, (names[insert[state]] + ":", *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = get(i + 1, state, 0)
            options.append((c + 3, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (to := keep.get((state, role[:1]))) is not None:
                    c, a, t = get(i + 1, to, 0)
                    options.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = get(i + 1, insert[state], 0)
                options.append((c + 2 + extra, "R" + a, (f"{names[insert[state]]}:{text}", *t)))
        return min(options, default=(10**9, "", ()))

    get = cache(best)
    for i in range(len(rows), -1, -1):  # from the end, so that the recursion stays flat
        for state, inserts in itertools.product(range(4), (2, 1, 0)):
            get(i, state, inserts)
    return get(0, 0, 0)


def expected(original, rows):
    out = {conv: (0, 0, 0, 0, 0, 0, "", EMPTY) for conv, *_ in original}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest())
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        seen, faults = set(), []
        for _, _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = (
                "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            )
            seen.add((role, text))
            faults.append(fault)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest([(r[2], r[3], f) for r, f in zip(own, faults)])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["a.", "b!", "c", "d? \n", "", " \t", "é 😀.", "long " * 50, "x...", None]
    roles = ["user", "assistant", "system", "tool", "", "u", None]
    out = []
    for conv in range(60):
        n = rng.choice([1, 2, 3, 5, 8, 13])
        for turn in range(n):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = f"t{rng.randrange(40)}." if rng.random() < 0.6 else rng.choice(texts)
            out.append((conv, turn + 3 * (rng.random() < 0.1), role, text))
    out += [(None, t, "user", f"n{t}.") for t in (None, 1, 2, 2)]
    out += [(77, None, r, "same.") for r in ("user", "assistant", "assistant")]
    # One conversation with most of the rows, many of them equal.
    for turn in range(400):
        role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
        out.append((99, turn // 2 * 2, role, f"{turn}." if rng.random() < 0.7 else rng.choice(texts)))
    out += [(98, 5, "user", "again and again.")] * 150
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("chunk_rows", [65_536, 3])
def test_reports(spark, rows, chunk_rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS part", "1 AS seq", "2 AS row").repartition(6)
    broken = damage(df)
    assert sorted(map(str, broken.collect())) == sorted(
        map(str, spark.createDataFrame(damaged(rows), SCHEMA).collect())
    )
    assert found(conversation_reports(df, broken, chunk_rows=chunk_rows)) == expected(rows, damaged(rows))


def test_short_conversations_exhaustively(spark):
    rows, conv = [], 0
    for n in range(1, 5):
        for initials in itertools.product(("user", "assistant", "system"), repeat=n):
            for bad in range(2**n):
                if n < 4 or bad % 3 == 0:
                    rows += [(conv, t, r, f"{t}" if bad >> t & 1 else f"{t}.") for t, r in enumerate(initials)]
                    conv += 1
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(conversation_reports(df, df, chunk_rows=2)) == expected(rows, rows)


def test_only_dropped_rows_and_empty_tables(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "x.")], SCHEMA)
    assert found(conversation_reports(df, damage(df))) == {conv: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_reports(none, damage(none)).count() == 0
    for table in repair(none):
        assert table.count() == 0


def test_edits_hold_the_repaired_turns(spark):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "assistant", "there."), (1, 2, "user", " "), (1, 3, "user", "q")]
    _, _, turns = repair(spark.createDataFrame(rows, SCHEMA))
    got = sorted(turns.collect(), key=lambda r: (r.part, r.seq, r.pos))
    kept = [r for r in got if r.edit != "D"]
    assert [r.role[0] for r in kept] == ["u", "a"] * (len(kept) // 2)
    assert all((r.role is None) == (r.text is None) == (r.edit == "D") for r in got)
    assert sum({"D": 3, "I": 2, "K": 0, "R": 2}[r.edit] for r in got) + sum(
        r.text == "q" for r in kept
    ) == cheapest([("assistant", "hello.", ""), ("assistant", "there.", ""), ("user", " ", "blank"), ("user", "q", "truncated")])[0]
