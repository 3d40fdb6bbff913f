"""Filters on feed items."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.text import sanitize_title
from linkloom.workspace import local_rows, stage

_GRAM = 3
#: Words of rules up to which they are tested one by one.
FEW_WORDS = 64
#: Characters of rules up to which a rule table is sent to the tasks.
SENT_CHARACTERS = 16_000_000
#: Characters of their different words up to which these are sent: each worker makes an automaton of them.
SENT_VOCABULARY = 2_000_000
_TITLE = T.StructType([T.StructField("title", T.StringType())])


def title_words(spark: SparkSession, titles: Sequence[str]) -> list[list[str]]:
    """The words of each rule title, normalised by the same expression as item titles."""
    if not titles:
        return []
    rows = local_rows(spark, _TITLE, [(title,) for title in titles])
    return [r[0] for r in rows.select(F.split(sanitize_title(F.col("title")), " ")).collect()]


def _matches_any(title: Column, rules: Sequence[Sequence[str]]) -> Column:
    """True where all words of some rule occur in the normalised title as substrings.

    The rules are one literal, so the expression is as deep for one as for thousands.
    The title is bound to a lambda variable: a filter would otherwise normalise it anew
    for every word of every rule.
    """
    table = F.array(*[F.array(*[F.lit(word) for word in words]) for words in rules])
    return F.exists(
        F.array(sanitize_title(title)),
        lambda normal: F.exists(table, lambda words: F.forall(words, lambda w: F.contains(normal, w))),
    )


class _Rules:
    """Rules as numbers of words, longest words first, in a few arrays; duplicate words and rules count once.

    A rule of one word is marked at the word.  Any other is filed under its two longest words,
    as one number, with what words it has besides.
    """

    def __init__(self, rules: pa.Array) -> None:
        coded = rules.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        order = sorted(range(len(words)), key=lambda i: (-len(words[i]), words[i]))
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        self.words = pa.array([words[i] for i in order], pa.string())
        lengths = pc.list_value_length(rules).to_numpy(zero_copy_only=False).astype(np.int64)
        rule, word = np.repeat(np.arange(len(rules)), lengths), number[coded.indices.to_numpy()]
        sort = np.lexsort((word, rule))
        rule, word = rule[sort], word[sort]
        new = np.ones(len(rule), bool)
        new[1:] = (rule[1:] != rule[:-1]) | (word[1:] != word[:-1])
        rule, word = rule[new], word[new]
        begin = np.flatnonzero(np.append(True, rule[1:] != rule[:-1])[: len(rule)])
        end = np.append(begin[1:], len(rule))
        size = len(words)
        self.alone = np.zeros(size, bool)
        self.alone[word[begin[end - begin == 1]]] = True
        begin, end = begin[end - begin > 1], end[end - begin > 1]
        pair = word[begin] * size + word[begin + 1]
        sort = np.lexsort((end - begin, pair))
        self.pair, begin, end = pair[sort], begin[sort] + 2, end[sort]
        # Rules of the same two words, of which one has no other, are that one.
        again = np.append(False, self.pair[1:] == self.pair[:-1])[: len(begin)] & (begin == end)
        self.pair, begin, end = self.pair[~again], begin[~again], end[~again]
        self.rest_end = np.cumsum(end - begin)
        self.rest = word[np.repeat(end - self.rest_end, end - begin) + np.arange((end - begin).sum())].astype(np.int32)
        self.first, self.second = np.zeros(size, bool), np.zeros(size, bool)
        self.first[self.pair // max(size, 1)] = True
        self.second[self.pair % max(size, 1)] = True


class _RuleMatcher:
    """Whether a normalised title holds all words of some rule: one automaton pass per title.

    The automaton has the words of all rules.  The pairs of words that were found are looked up, so
    the work on a title does not follow the number of rules.
    """

    def __init__(self, rules: _Rules) -> None:
        import ahocorasick

        self.rules = rules
        self.words = ahocorasick.Automaton()
        for i, word in enumerate(rules.words):
            self.words.add_word(word.as_py(), i)
        self.words.make_automaton()

    def __call__(self, title: str | None) -> bool:
        if not title:
            return False
        found = {i for _, i in self.words.iter(title)}
        if not found:
            return False
        rules, numbers = self.rules, np.fromiter(found, np.int64, len(found))
        if rules.alone[numbers].any():
            return True
        first, second = numbers[rules.first[numbers]], numbers[rules.second[numbers]]
        if not len(first) or not len(second):
            return False
        wanted = np.add.outer(first * len(rules.words), second).ravel()
        begin, end = np.searchsorted(rules.pair, wanted), np.searchsorted(rules.pair, wanted, "right")
        for at in np.flatnonzero(begin < end).tolist():
            for rule in range(begin[at], end[at]):
                rest = rules.rest[rules.rest_end[rule - 1] if rule else 0 : rules.rest_end[rule]]
                if found.issuperset(rest.tolist()):
                    return True
        return False


def _matches_automaton(rules: _Rules):
    """The matcher as a column function over normalised titles; a worker builds it once per task."""
    made: list[_RuleMatcher] = []

    @F.arrow_udf(T.BooleanType())
    def matches(normals: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not made:
            made.append(_RuleMatcher(rules))
        for titles in normals:
            yield pa.array(map(made[0], titles.to_pylist()), pa.bool_())

    return matches


def _keep_matching(items: DataFrame, rules: pa.Array, title: str) -> DataFrame:
    if not len(rules):
        return items.where(F.lit(False))
    if len(rules.flatten()) <= FEW_WORDS:
        few = rules.to_pylist()
        return items.where(F.col(title).isNotNull() if [""] in few else _matches_any(F.col(title), few))
    return items.where(_matches_automaton(_Rules(rules))(sanitize_title(F.col(title))))


def filter_titles(items: DataFrame, titles: Sequence[str], title: str = "title") -> DataFrame:
    """Keep items whose title holds all words of at least one of ``titles``.

    No titles keep nothing; an empty title keeps everything.  Works on streams.  Up to
    ``FEW_WORDS`` words of rules are tested in generated code, one after the other; more of
    them by an automaton that reads each title once, however many rules there are.
    """
    words = title_words(items.sparkSession, titles)
    if [""] in words:
        return items.where(F.col(title).isNotNull())
    return _keep_matching(items, pa.array(words, pa.list_(pa.string())), title)


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters."""
    count = F.length(text) - size + 1
    return F.when(
        count > 0,
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(size)))
        ),
    ).otherwise(F.array().cast("array<string>"))


def _held_words(normals: DataFrame, words: DataFrame) -> DataFrame:
    """``normal, word``: which of the words each normalised title holds.

    Every word is filed under its rarest piece of three characters, short words as they are; titles
    are looked up by the pieces they hold, and only these candidates are compared.  Of the titles'
    pieces only those that some word has are kept, before anything is counted or compared.
    """
    filed = words.select(
        "word",
        F.explode(
            F.when(F.length("word") < _GRAM, F.array("word")).otherwise(_grams(F.col("word"), _GRAM))
        ).alias("piece"),
    )
    pieces = stage(
        normals.select(
            "normal", F.explode(F.concat(*[_grams(F.col("normal"), n) for n in range(1, _GRAM + 1)])).alias("piece")
        ).join(filed.select("piece").distinct(), "piece", "left_semi"),
        "title-pieces",
    )
    frequency = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = (
        filed.join(frequency, "piece", "left")
        .groupBy("word")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("best"))
        .where("best.n > 0")
        .select("word", "best.piece")
    )
    held = pieces.join(rarest, "piece").where(F.contains(F.col("normal"), F.col("word")))
    return stage(held.select("normal", "word"), "held-words")


def filter_titles_by_rules(
    items: DataFrame, rules: DataFrame, title: str = "title", sent: int = SENT_CHARACTERS
) -> DataFrame:
    """:func:`filter_titles` with the rules in a table of any size, column ``title``.

    A table of up to ``sent`` characters, and up to ``SENT_VOCABULARY`` of different words, is sent
    to the tasks.  Beyond that the words that titles hold are found by an equi-join on pieces of
    them, and rules by another one: a rule is filed under its two longest words, and the pairs of
    words of a title are looked up.  The work follows the titles and the rules, not their product.
    The lookup runs over distinct titles.
    """
    rule_words = stage(
        rules.where(F.col("title").isNotNull())
        .select(F.split(sanitize_title(F.col("title")), " ").alias("words"))
        .distinct(),
        "title-rules",
    )
    size, empty = rule_words.agg(
        F.sum(F.length(F.array_join("words", " ")) + 1), F.max(F.col("words") == F.array(F.lit("")))
    ).first()
    if empty:
        return items.where(F.col(title).isNotNull())
    if not size:
        return items.where(F.lit(False))
    words = stage(rule_words.select(F.explode("words").alias("word")).distinct(), "rule-words")
    letters = words.agg(F.sum(F.length("word"))).first()[0]
    if size <= sent and letters <= SENT_VOCABULARY:
        return _keep_matching(items, rule_words.toArrow()["words"].combine_chunks(), title)
    normals = items.select(sanitize_title(F.col(title)).alias("normal")).distinct()
    held = _held_words(normals, words)
    by_length = F.transform(
        F.array_sort(F.transform(F.array_distinct("words"), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))),
        lambda s: s["w"],
    )
    filed = stage(
        rule_words.select(by_length.alias("words")).select(
            F.get("words", 0).alias("first"), F.get("words", 1).alias("second"), F.slice("words", 3, 2**31 - 1).alias("rest")
        ).distinct(),
        "filed-rules",
    )
    alone = filed.where("second IS NULL").select(F.col("first").alias("word"))
    several = filed.where("second IS NOT NULL")
    # Of a title's words, those that are the first and those that are the second of some rule make pairs.
    first, second = (
        held.join(several.select(F.col(c).alias("word")).distinct(), "word", "left_semi")
        .groupBy("normal").agg(F.collect_set("word").alias(f"__{c}"))
        for c in ("first", "second")
    )
    pairs = (
        first.join(second, "normal")
        .select("normal", "__second", F.explode("__first").alias("first"))
        .select("normal", "first", F.explode("__second").alias("second"))
    )
    matched = (
        pairs.join(several, ["first", "second"])
        .where(F.forall("rest", lambda w: F.contains(F.col("normal"), w)))
        .select("normal")
        .unionByName(held.join(alone, "word", "left_semi").select("normal"))
        .distinct()
    )
    return (
        items.withColumn("__normal", sanitize_title(F.col(title)))
        .join(matched.withColumnRenamed("normal", "__normal"), "__normal", "left_semi")
        .drop("__normal")
    )
