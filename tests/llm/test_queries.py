"""Registered queries of the subpackage: against their SQL, and the pipeline's stages."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from docledger.llm import queries

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in sorted(Path(SF_DIR).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    frame = contract.queries()[name](spark, SF_DIR)
    cursor = tables.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(names, cursor.fetchall())


def test_all_thirteen_and_the_pipeline_are_registered():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in contract.queries()


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.persisted(stage(spark, docs, SF_DIR), "test")
        assert docs.columns == columns
        after = docs.count()
        assert after <= before and (name != "line dedup" or after == before)
        assert docs.select("doc_id").distinct().count() == after
        before = after
    mix = corpus_pipeline.mixed_sources(spark, docs, SF_DIR)
    assert mix.count() == before


def test_stages_with_no_rows_and_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0),
         (None, "some words here and there again", "en", "a", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.where("false")):
        frame = start
        for _, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.persisted(stage(spark, frame, SF_DIR), "test")
        assert frame.count() == start.count()


def test_stages_with_columns_named_like_their_own(spark):
    names = ["version", "other_id", "key", "removed_lines", "removed_id", "removed_version", "row", "size",
             "score", "n_hit", "label_id", "toxic", "place", "part", "rate", "a", "b"]
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(1, words[0], *names), (2, words[0] + " more", *names), (2, words[1], *names), (3, words[2], *names),
            (4, "a line\na line", *names), (4, words[2], *names)]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", 1, *rest) for i, t, *rest in rows],
        "doc_id long, text string, lang string, source string, n_chars long, "
        + ", ".join(f"{n} string" for n in names))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.persisted(stage(spark, docs, SF_DIR), "test")
        assert docs.columns == columns
    assert all(list(x[5:]) == names for x in docs.collect() if x["doc_id"] == 1)
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert mix.count() == docs.count() and "copies" in mix.columns


def test_rows_with_repeated_or_no_ids_have_decisions_of_their_own(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefgh"]
    bad = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("length(text) > 99").first()["text"]
    rows = [(None, words[0]), (None, bad), (7, words[1]), (7, bad), (None, words[2]), (None, words[2]),
            (7, words[3]), (3, words[3]), (8, words[4]), (8, words[4]), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    told = lambda frame: sorted(map(str, [(x["doc_id"], x["text"]) for x in frame.collect()]))
    clean = corpus_pipeline.without_benchmark(spark, docs, SF_DIR)
    assert told(clean) == sorted(map(str, [x for x in rows if x[1] != bad]))
    one = corpus_pipeline.one_of_each_group(spark, docs, SF_DIR)
    assert told(one) == sorted(map(str, [
        (None, words[0]), (7, bad), (7, words[1]), (None, words[2]), (3, words[3]), (8, words[4]),
        (9, ""), (9, "")]))

    lines = [(5, words[5]), (6, f"{words[5]}\n{words[6]}"), (6, f"{words[7]}\n{words[0]}"),
             (None, words[1]), (None, f"{words[2]}\n{words[1]}"), (4, words[2])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in lines], docs.schema)
    got = told(corpus_pipeline.without_repeated_lines(spark, docs, SF_DIR))
    assert str((6, words[6])) in got and str((6, f"{words[7]}\n{words[0]}")) in got
    assert str((4, "")) in got and sum(words[1] in x for x in got) == 1


def test_licenses_of_rows_with_repeated_or_no_ids(spark, tmp_path):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(None, mit, "a"), (None, apache, "a"), (None, None, "b"), (15, apache, "c"), (15, "words", "c"),
            (15, "words", "c"), (16, "words", None), (17, "words", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in queries.op7_licenses(spark, str(tmp_path)).collect()]
    assert sorted(str((x[0], x[2], x[5], x[6])) for x in got) == sorted(map(str, [
        (None, "MIT", "MIT", None), (None, "Apache-2.0", "Apache-2.0", None), (None, None, None, None),
        (15, "Apache-2.0", "Apache-2.0", None), (15, None, "Apache-2.0", 15), (15, None, "Apache-2.0", 15),
        (16, None, None, None), (17, None, "Apache-2.0", 15)]))
    paths = [x[1] for x in got]
    assert len(set(paths)) == 7 and {"c/0/1/17.txt", "none/0/1/16.txt", "b/none/none/none.txt"} <= set(paths)
