"""The pipeline on the smallest tables, stage by stage against plain versions."""

import os

import brute
import pytest

import corpus_pipeline as cp
from __spark_entry__ import SMOKE_DIR, queries
from linkloom.workspace import stage

needs_tables = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")]
    for name, function in cp.STAGES:
        docs.append(stage(function(spark, docs[-1], SMOKE_DIR), name))
    return docs


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@needs_tables
def test_stages(spark, stages):
    from tokenizers import Tokenizer

    first, clean, lines, unique, mixed, tokens = stages
    assert all(df.columns == first.columns for df in (clean, lines, unique, mixed))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMOKE_DIR}/labels.parquet").collect()}
    left = {i for i, _ in rows_of(clean)}
    clean_ids = [i for i, y in labels.items() if not y]
    assert sum(i in left for i in clean_ids) >= 0.9 * len(clean_ids)
    assert dict(rows_of(lines)) == brute.lines_left(rows_of(clean), 2, 24)
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    groups = brute.jaccard_components(rows_of(lines), 5, 80)
    assert {i for i, _ in rows_of(unique)} == {i for i, (_, c) in groups.items() if i == c}
    assert sorted(rows_of(mixed)) == sorted(rows_of(unique))
    tokenizer = Tokenizer.from_file(cp.tokenizer_path())
    texts = dict(rows_of(mixed))
    got = {r.doc_id: r for r in tokens.collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (got[i].ids, got[i].n_tokens, got[i].text) == (want, len(want), t)


@needs_tables
def test_run_is_registered(spark, stages):
    assert sorted(r.doc_id for r in queries()["pipeline"](spark, SMOKE_DIR).collect()) == sorted(
        r.doc_id for r in stages[-1].collect()
    )


def test_stages_on_odd_rows(spark, tmp_path, none, odd):
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.selectExpr("*", "'en' AS lang", "IF(doc_id = 1, NULL, 'x') AS source", "length(text)::long AS n_chars")
    for start in (none, docs):
        df = start
        for name, function in cp.STAGES:
            df = stage(function(spark, df, str(tmp_path)), name)
        ids = sorted(str(r.doc_id) for r in df.collect())
        # Row 1 has a copy of its own and one without an id; the longer text of id 3 is near it.
        assert ids == ([] if start is none else ["1", "2", "3", "None"])


def test_one_row_of_each_group_stays(spark):
    """Groups of rows without ids, of repeated ids, and of both."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    other = "completely different words stand here and nothing of the first text is among them at all today"
    rows = [(None, text), (1, text + " more"), (None, None), (None, text), (7, other), (7, other + " x"), (None, other + " y"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = cp.near_duplicates(spark, docs, "")
    assert sorted(map(str, [tuple(r) for r in got.collect()])) in (
        sorted(map(str, [(1, text + " more"), (None, None), (7, other), (5, None)])),
        sorted(map(str, [(1, text + " more"), (None, None), (7, other + " x"), (5, None)])),
    )


def test_the_order_of_the_mix_is_that_of_the_files(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 50), f"s{i % 7 % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    cp.mixing(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    read = spark.read.parquet(f"{tmp_path}/mixed").orderBy("_metadata.file_name", "_metadata.row_index")
    places = {r.doc_id: r.position for r in cp.mix_sources(docs).collect()}
    order = [places[r.doc_id] for r in read.collect()]
    assert order == sorted(order) and len(order) == 3000
