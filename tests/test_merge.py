"""Merges into tables stored by tenant: what they touch, and what a crash leaves."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docledger.sources import merge

SCHEMA = "document_id string, status string, size int, organization_id string"
ROWS = [("d1", "NEW", 1, "a"), ("d2", "NEW", 2, "a"), ("d3", "NEW", 3, "b"), ("d4", "NEW", 4, "c"),
        ("d5", "NEW", 5, None), ("d6", "NEW", 6, "x/y=z")]


@pytest.fixture
def table(spark, tmp_path):
    merge.write_by_tenant(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path), "documents")
    return str(tmp_path)


def rows(spark, root):
    got = merge.read_by_tenant(spark, root, "documents", SCHEMA).select(
        "document_id", "status", "size", "organization_id").collect()
    return in_order(map(tuple, got))


def in_order(rows):
    return sorted(rows, key=str)


def files(root):
    """Names and times of the data files of each tenant."""
    out = {}
    for path in Path(root, "documents").rglob("*.parquet"):
        out.setdefault(path.parent.name, set()).add((path.name, path.stat().st_mtime_ns))
    return out


def change(spark, root, removed, added):
    merge.merge_rows(
        root, "documents", SCHEMA, "document_id",
        spark.createDataFrame(removed, "document_id string, organization_id string"),
        spark.createDataFrame(added, "document_id string, status string, organization_id string"))


def test_only_named_tenants_get_new_files(spark, table):
    before = files(table)
    change(spark, table, [("d1", "a")], [("d1", "DONE", "a"), ("d7", "NEW", "b")])
    want = in_order([("d1", "DONE", None, "a"), ("d7", "NEW", None, "b"), *ROWS[1:]])
    assert rows(spark, table) == want
    after = files(table)
    same = {k for k in before if after.get(k) == before[k]}
    assert set(before) - same == {"organization_id=a", "organization_id=b"}
    change(spark, table, [("d1", "a")], [("d1", "DONE", "a"), ("d7", "NEW", "b")][:1])
    assert rows(spark, table) == want
    assert os.listdir(f"{table}/_merges/documents") == []


def test_tenants_without_a_name_with_an_odd_one_and_left_empty(spark, table):
    change(spark, table, [("d5", None), ("d6", "x/y=z"), ("d4", "c")],
           [("d5", "DONE", None), ("d6", "DONE", "x/y=z"), ("d8", "NEW", "new")])
    assert rows(spark, table) == in_order([
        *ROWS[:3], ("d5", "DONE", None, None), ("d6", "DONE", None, "x/y=z"), ("d8", "NEW", None, "new")])
    change(spark, table, [], [])
    assert len(rows(spark, table)) == 6


def test_many_tenants_are_found_by_a_join(spark, table, monkeypatch):
    monkeypatch.setattr(merge, "NAMED_TENANTS", 1)
    change(spark, table, [("d1", "a"), ("d5", None)], [("d1", "DONE", "a"), ("d5", "DONE", None)])
    assert rows(spark, table) == in_order([
        ("d1", "DONE", None, "a"), ("d5", "DONE", None, None), *ROWS[1:4], ROWS[5]])


def test_a_merge_that_fails_while_writing_leaves_the_old_rows(spark, table):
    before = files(table)
    added = spark.createDataFrame([("d1", "DONE", "a")], "document_id string, status string, "
                                  "organization_id string").withColumn(
        "status", F.when(F.lit(True), F.raise_error(F.lit("no"))).otherwise(F.col("status")))
    removed = spark.createDataFrame([("d1", "a")], "document_id string, organization_id string")
    with pytest.raises(Exception, match="no"):
        merge.merge_rows(table, "documents", SCHEMA, "document_id", removed, added.select(
            "document_id", F.col("status").cast("string").alias("status"), "organization_id"))
    assert files(table) == before and rows(spark, table) == in_order(ROWS)
    Path(f"{table}/_merges/documents/half/new/organization_id=a").mkdir(parents=True)
    assert merge.finish_merges(spark, table, "documents") == 0
    assert files(table) == before and os.listdir(f"{table}/_merges/documents") == []


@pytest.mark.parametrize("moves", range(6))
def test_a_crash_between_the_moves_is_finished_later(spark, table, monkeypatch, moves):
    real, left = merge._Folders.move, [moves]

    def move(self, path, to):
        if not left[0]:
            raise OSError("crash")
        left[0] -= 1
        real(self, path, to)

    monkeypatch.setattr(merge._Folders, "move", move)
    removed = [("d1", "a"), ("d3", "b"), ("d4", "c")]
    added = [("d1", "DONE", "a"), ("d3", "DONE", "b")]
    with pytest.raises(OSError, match="crash"):
        change(spark, table, removed, added)
    monkeypatch.setattr(merge._Folders, "move", real)
    # No row is lost: the old ones are in the table or aside, the new ones are complete.
    assert merge.finish_merges(spark, table, "documents") == 1
    want = [("d1", "DONE", None, "a"), ROWS[1], ("d3", "DONE", None, "b"), *ROWS[4:]]
    assert rows(spark, table) == in_order(want)
    change(spark, table, removed, added)
    assert rows(spark, table) == in_order(want)


def ranged_rows(monkeypatch, frame):
    """How many rows each later layout by ranges shuffles."""
    counts, real = [], frame.repartitionByRange

    def spy(self, *columns):
        counts.append(self.count())
        return real(self, *columns)

    monkeypatch.setattr(frame, "repartitionByRange", spy)
    return counts


def test_rows_that_stay_are_not_shuffled(spark, tmp_path, monkeypatch):
    stored = spark.range(2_000).selectExpr(
        "concat('d', id) AS document_id", "'NEW' AS status", "CAST(id AS int) AS size",
        "concat('t', id % 3) AS organization_id")
    merge.write_by_tenant(stored, str(tmp_path), "documents")
    counts = ranged_rows(monkeypatch, type(stored))
    change(spark, str(tmp_path), [("d1", "t1"), ("d2", "t2")], [("d1", "DONE", "t1")])
    got = rows(spark, str(tmp_path))
    assert len(got) == 1_999 and ("d1", "DONE", None, "t1") in got
    assert ("d0", "NEW", 0, "t0") in got and not any(r[0] == "d2" for r in got)
    assert len(counts) == 1 and counts[0] < 100


def test_many_merges_do_not_leave_ever_more_files(spark, table, monkeypatch):
    monkeypatch.setattr(merge, "TENANT_FILES", 1)
    for n in range(6):
        change(spark, table, [], [(f"new{n}", "NEW", "a")])
    assert len(files(table)["organization_id=a"]) <= 6
    assert len(rows(spark, table)) == len(ROWS) + 6
