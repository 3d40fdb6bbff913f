import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Columns whose names operators use themselves.
CLASH = ["doc", "twin", "word", "count", "row", "kind", "grp", "ids", "score", "rank", "block", "print", "n"]


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, blanks, odd characters and one very long text."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = text(40), text(7)
    out = []
    for i in range(90):
        kind = i % 6
        if kind == 0 or not out:
            t = text(rng.randint(1, 60))
        elif kind == 1:
            t = out[rng.randrange(len(out))][1]
        elif kind == 2:
            w = out[rng.randrange(len(out))][1].split(" ")
            w[rng.randrange(len(w))] = "new"
            t = " ".join(w)
        elif kind == 3:
            t = text(5) + "\n" + passage + "\n" + text(5)
        elif kind == 4:
            t = text(4) + "\n" + line + "\n" + text(9)
        else:
            t = "  " + out[rng.randrange(len(out))][1].upper() + "\t"
        out.append((i, t))
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "a"), (204, "x" * 400), (205, text(20_000))]
    out += [(206, "one two three"), (207, "ONE  two\nthree"), (208, "😀 é \x85\xa0中文 \x1c<|endoftext|>'s 12")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name in CLASH:
        df = df.selectExpr("*", f"'other' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and one id with two texts."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    data = [(1, long), (1, long), (None, long), (None, None), (2, None), (2, ""), (3, "first text here"), (3, long + " and more")]
    return spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS score").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
