import random
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from linkloom.operators.item_filters import filter_titles, filter_titles_by_rules, title_words
from linkloom.operators.link_filters import (
    _native_form,
    apply_chain,
    describe_filters,
    expand_short_links,
    filename_as_title,
    filter_catalog,
    filter_domains,
    filter_domains_by_table,
    filter_url_regex,
    flat_map_rows,
)


def items(spark, *titles):
    return spark.createDataFrame([(t,) for t in titles], "title string")


def links(spark, *rows):
    rows = [(r, r) if isinstance(r, str) else r for r in rows]
    return spark.createDataFrame(list(rows), "title string, url string")


def titles(df):
    return [r.title for r in df.collect()]


def urls(df):
    return [r.url for r in df.collect()]


# --- item titles ------------------------------------------------------------------------


def test_no_titles_keep_nothing(spark):
    assert titles(filter_titles(items(spark, "a title"), [])) == []


def test_empty_title_keeps_everything(spark):
    assert titles(filter_titles(items(spark, "one", "two"), ["", "zzz"])) == ["one", "two"]


def test_any_title_with_all_words(spark):
    rows = items(spark, "Big.Show.S01", "show only", "bigger showcase", "Der große Film")
    assert titles(filter_titles(rows, ["The Big & Show!"])) == []
    assert titles(filter_titles(rows, ["Big: Show", "@große film"])) == [
        "Big.Show.S01", "bigger showcase", "Der große Film",
    ]


def test_missing_title_is_dropped(spark):
    assert titles(filter_titles(items(spark, None, "x"), [""])) == ["x"]


def test_rule_table_equals_inlined_rules(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = items(spark, *[" ".join(rng.sample(words, 4)) + str(i) for i in range(200)])
    rules = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(40)]
    want = sorted(titles(filter_titles(rows, rules)))
    got = filter_titles_by_rules(rows, items(spark, *rules))
    assert 0 < len(want) < 200
    assert sorted(titles(got)) == want


@pytest.mark.parametrize("count", [500, 5_000])
def test_long_rule_lists(spark, tmp_path, count):
    rules = [f"word{i} other{i}" for i in range(count)]
    rows = items(spark, "OTHER3 & word3", "word4 other5", "x word499, other499")
    want = ["OTHER3 & word3", "x word499, other499"]
    assert sorted(titles(filter_titles(rows, rules))) == want
    rows.write.parquet(f"{tmp_path}/in")
    stream = filter_titles(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), rules)
    query = (
        stream.writeStream.format("memory").queryName(f"rules_{count}")
        .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(titles(spark.table(f"rules_{count}"))) == want


def test_rule_table_special_cases(spark):
    rows = items(spark, "a", "b")
    assert titles(filter_titles_by_rules(rows, items(spark, "x", ""))) == ["a", "b"]
    assert titles(filter_titles_by_rules(rows, items(spark))) == []


def test_long_expression_lists(spark):
    rows = links(spark, "http://h/number7/", "http://h/number7777/", "http://h/other")
    got = filter_url_regex(rows, [f"number{i}/$" for i in range(1_000)])
    assert [r.url for r in got.collect()] == ["http://h/number7/"]


# --- links ------------------------------------------------------------------------------


def test_domains(spark):
    rows = links(
        spark, "http://Example.com:80/1", "feed://example.com/2", "example.com/3",
        "http:////example.com?/4", "http://sub.example.com/5", "http://example.com/%zz",
        " http://example.com/6",
    )
    assert urls(filter_domains(rows, ["  EXAMPLE.com "])) == [
        "http://Example.com:80/1", "feed://example.com/2",
    ]
    assert urls(filter_domains(rows, [])) == []
    assert urls(filter_domains(links(spark, "/rel", "http://h/"), [""])) == ["/rel"]


def test_domain_table_equals_list(spark):
    rows = links(spark, "http://A.com/", "http://b.com/", "//c.com", "x")
    table = spark.createDataFrame([(" a.COM",), ("c.com",), ("c.com",)], "domain string")
    assert sorted(urls(filter_domains_by_table(rows, table))) == ["//c.com", "http://A.com/"]


def test_url_regex(spark):
    rows = links(spark, "http://h/a.mp4 ", "http://h/a.mkv", "http://h/a.mkv?x", "\u00a0x.mp4")
    assert urls(filter_url_regex(rows, [r".*\.mp4$", r".*?\.mkv$"])) == [
        "http://h/a.mp4 ", "http://h/a.mkv", "\u00a0x.mp4",
    ]
    assert urls(filter_url_regex(rows, [])) == []
    assert urls(filter_url_regex(rows, [".*"])) == urls(rows)
    with pytest.raises(PySparkException):
        filter_url_regex(rows, ["("])


HOSTILE = ["(a*)(a*)(a*)b", "(a|aa)+$", "(x+x+)+y", "([a-z]+)*[0-9]", ".*.*.*=.*", "(a?){30}a{30}"]


def test_hostile_expressions_take_linear_time(spark):
    """Each of these takes a backtracking engine polynomial or exponential time."""
    rows = links(spark, "http://h/" + "a" * 20_000, "http://h/" + "x" * 20_000 + "!")
    filter_url_regex(rows, ["warm(up)*"]).collect()
    for expression in HOSTILE:
        began = time.time()
        filter_url_regex(rows, [expression]).collect()
        assert time.time() - began < 5, expression


def test_expressions_mean_what_they_do_in_re2(spark):
    """The end is the end of the text, a dot is any sign but a line feed, classes are ASCII."""
    rows = links(spark, "http://h/a\nb", "http://h/a\rb", "http://h/\u0661", "http://h/1", "HTTP://H/x")
    keep = lambda e: urls(filter_url_regex(rows, [e]))
    assert keep("a$") == []
    assert keep("a.b") == keep("a(.)*b") == ["http://h/a\rb"]
    assert keep(r"\d") == keep("[[:digit:]]") == ["http://h/1"]
    assert keep("(?i)^http://h/X") == ["HTTP://H/x"]
    for bad in ("(?=a)", "a**", r"\1", "[z-a]", "(?<n"):
        with pytest.raises(ValueError):
            filter_url_regex(rows, [bad])


def test_both_engines_agree(spark):
    """Simple expressions run in generated code; each gives what the linear engine gives."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab.1/-\n\r$é") for _ in range(rng.randint(0, 8))) for _ in range(300)]
    pieces = ["a", "b", ".", r"\.", "[ab]", "[^a]", "a?", "(a|b)", "1", "/", "-", "é", r"\$", "[0-9]"]
    seen = 0
    rows = links(spark, *texts)
    for _ in range(60):
        expression = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))
        expression = rng.choice(["", "^"]) + expression + rng.choice(["", "$"])
        seen += _native_form(expression) is not None
        text = [t.strip() for t in texts]
        want = sorted(t for t, s in zip(texts, text) if pc.match_substring_regex(pa.array([s]), expression)[0].as_py())
        assert sorted(urls(filter_url_regex(rows, [expression]))) == want, expression
    assert seen > 20


def test_many_expressions_of_both_kinds(spark):
    rows = links(spark, *[f"http://h/number{i}" for i in range(0, 600, 7)])
    got = filter_url_regex(rows, [f"number{i}(x*)$" for i in range(500)] + [f"number{i}$" for i in range(500, 550)])
    assert urls(got) == [f"http://h/number{i}" for i in range(0, 550, 7)]


def test_many_title_rules_equal_few(spark):
    """Rules by automaton, by expression and by join keep the same items."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(200)] + ["", "!"]
    rules = [" ".join(rng.sample(words, rng.randint(1, 3))) + rng.choice(["", "!"]) for _ in range(90)]
    items = spark.createDataFrame([(t, i) for i, t in enumerate([*titles, None])], "title string, n int")
    few = sorted(r.n for c in range(0, 90, 15) for r in filter_titles(items, rules[c : c + 15]).collect())
    assert len(title_words(spark, rules)) > 64
    many = sorted(r.n for r in filter_titles(items, rules).collect())
    assert many == sorted(set(few))
    table = spark.createDataFrame([(r,) for r in rules], "title string")
    for sent in (0, 10**6):
        assert sorted(r.n for r in filter_titles_by_rules(items, table, sent=sent).collect()) == many


def test_filename_as_title(spark):
    rows = links(
        spark, ("t", "http://h/img.jpg"), ("t", "http://h/dl/name"), ("", ""), ("t", "http://h"),
        ("t", "http://h/"), ("t", "http://h/cat/news/"), ("t", "http://h/n/   "),
        ("t", "http://h/%zz"), ("t", "/a%20b+c.tar.gz "), ("t", "http://h/.x"), ("t", "http://h/."),
    )
    assert titles(filename_as_title(rows)) == [
        "img.jpg", "name", "", "t", "t", "t", "t", "t", "a b+c.tar.gz", ".x", "t",
    ]
    assert titles(filename_as_title(rows, trim_extension=True)) == [
        "img", "name", "", "t", "t", "t", "t", "t", "a b+c.tar", "", "t",
    ]


def test_expand_short_links(spark):
    lookups = spark.createDataFrame(
        [
            ("http://ul.to/file/abc/status", "file.ext\n198 KB"),
            ("http://uploaded.net/file/abc/status", "other.ext"),
            ("http://uploaded.net/file/none/status", "\n0 KB"),
            ("http://ul.to/file//status", "root.ext"),
        ],
        "status_url string, body string",
    )
    cases = {
        "http://uploaded.net/file/abc/name.ext": "http://uploaded.net/file/abc/name.ext",
        "http://uploaded.net/some/other/url": "http://uploaded.net/some/other/url",
        "http://uploaded.net/other/abc": "http://uploaded.net/other/abc",
        "http://uploaded.net/file/abc": "http://uploaded.net/file/abc/other.ext",
        "http://ul.to/file/abc": "http://ul.to/file/abc/file.ext",
        " http://ul.to:80/abc?q#f": "http://ul.to/file/abc/file.ext",
        "http://uploaded.net/file/abc/": "http://uploaded.net/file/abc/other.ext",
        "http://uploaded.net/file/missing": None,
        "http://uploaded.net/file/none": None,
        "http://ul.to/": "http://ul.to/file//root.ext",
        "http://UL.to/abc": "http://UL.to/abc",
        "http://example.com/files/x": "http://example.com/files/x",
        "http://example.com/%zz": None,
    }
    rows = spark.createDataFrame([(u, u) for u in cases], "title string, url string")
    got = {r.title: r.url for r in expand_short_links(rows, lookups).collect()}
    assert got == {k: v for k, v in cases.items() if v is not None}


def test_chain(spark):
    def append(letter):
        return lambda df: df.withColumn("title", F.concat("title", F.lit(letter)))

    rows = links(spark, ("", "u"))
    assert titles(apply_chain(rows, [append("A"), append("B"), append("C")])) == ["ABC"]
    assert apply_chain(rows, []) is rows


def test_flat_map_rows(spark):
    def twice_or_none(row):
        return [] if row["title"] == "x" else [row, {**row, "title": row["title"] + "2"}]

    assert titles(flat_map_rows(links(spark, "x", "y"), twice_or_none)) == ["y", "y2"]


def test_filter_catalog(spark):
    catalog = filter_catalog(
        spark,
        [{"type": "title", "titles": ["A", "B"]}],
        [{"type": "domain", "domains": ["d"]}, {"type": "expanduploadedlinks"}],
    )
    assert [tuple(r) for r in catalog.collect()] == [
        ("item", 0, "title", "A"), ("item", 0, "title", "B"),
        ("link", 0, "domain", "d"), ("link", 1, "expanduploadedlinks", ""),
    ]
    assert [r.line for r in describe_filters(catalog).collect()] == [
        "ITEM_TITLE:A\n", "ITEM_TITLE:B\n",
    ]


def test_rule_table_by_pairs_of_words(spark, monkeypatch):
    """Rules of one to four words, words in words, repeated ones; sent, and joined for their vocabulary."""
    from linkloom.operators import item_filters

    rng = random.Random(11)
    words = ["a", "ab", "abc", "bcd", "longest", "longer", "long", "er", "x", "yz", "über", "ß1", "word", "sword"]
    items = spark.createDataFrame([(i, " ".join(rng.sample(words, rng.randint(0, 4)))) for i in range(150)] + [(999, None)], "n int, title string")
    rules = [" ".join(rng.choices(words, k=rng.randint(2, 4))) for _ in range(60)] + ["long yz x", "yz long", "sword word"]
    table = spark.createDataFrame([(r,) for r in rules], "title string")
    want = sorted(
        r.n for r in items.collect()
        if r.title is not None and any(all(w in r.title for w in rule.split()) for rule in rules)
    )
    assert 0 < len(want) < 150
    assert sorted(r.n for r in filter_titles_by_rules(items, table).collect()) == want
    assert sorted(r.n for r in filter_titles_by_rules(items, table, sent=0).collect()) == want
    # A vocabulary beyond its bound is not sent either.
    monkeypatch.setattr(item_filters, "SENT_VOCABULARY", 10)
    joined = filter_titles_by_rules(items, table)
    assert "Join LeftSemi" in joined._jdf.queryExecution().toString()
    assert sorted(r.n for r in joined.collect()) == want


def test_sent_rules_are_arrays():
    """A table of rules takes a few bytes for each of its words in a worker."""
    import pickle

    import pyarrow as pa

    from linkloom.operators.item_filters import _RuleMatcher, _Rules

    names = [f"w{i}x" for i in range(1_000)]
    rules = pa.array([[names[i % 1_000], names[(i * 7 + i // 1_000) % 1_000], names[(i * 13) % 1_000]] for i in range(50_000)])
    packed = _Rules(rules)
    assert len(pickle.dumps(packed)) < 50_000 * 24
    matches = _RuleMatcher(packed)
    assert matches(f"z{names[3]} {names[21]} {names[39]}") and not matches(f"{names[3]} {names[21]}")
    assert not _RuleMatcher(_Rules(pa.array([["a", "b"], ["b", "c", "d"]])))("a c d")


def test_many_rules_are_the_rows_of_their_view(spark):
    from __spark_entry__ import SMOKE_DIR
    from workload.queries import _many_rules
    from workload.views import Tables

    t = Tables(spark, SMOKE_DIR)
    got, want = _many_rules(t), t["v_many_rules"]
    assert "split_part" not in got._jdf.queryExecution().toString()
    assert got.count() > 100 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
