"""Length and first bytes of stored files, and their pages in ranges."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docledger import fixed
from docledger.operators import gate
from docledger.plans.samples import MarkupRanges
from docledger.sources import sinks
from docledger.sources.headers import stored_headers
from docledger.sources.ranges import page_ranges, read_page_ranges

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "files"
    for name, content in {"a/1.pdf": b"%PDF-1.7 text", "a/2.pdf": b"%P", "b/3.pdf": b"", "b/c/4.pdf": b"MZ\x90",
                          "b/_tmp": b"x", ".hidden/5.pdf": b"x"}.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return folder


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
@pytest.mark.parametrize("per_task", [1, 100])
def test_headers_of_short_empty_and_hidden_files(spark, root, prefix, per_task):
    got = stored_headers(spark, f"{prefix}{root}", files_per_task=per_task)
    assert sorted((r["storage_key"], r["length"], bytes(r["header"])) for r in got.collect()) == [
        ("a/1.pdf", 13, b"%PDF-"), ("a/2.pdf", 2, b"%P"), ("b/3.pdf", 0, b""), ("b/c/4.pdf", 3, b"MZ\x90")]
    assert got.rdd.getNumPartitions() == (4 if per_task == 1 else 1)


def test_a_file_of_a_terabyte_costs_five_bytes(spark, root):
    with open(root / "huge.pdf", "wb") as file:
        file.write(b"%PDF-")
        file.truncate(1 << 40)
    found = stored_headers(spark, str(root)).where("storage_key = 'huge.pdf'").first()
    assert (found["length"], bytes(found["header"])) == (1 << 40, b"%PDF-")


def test_gate_over_files(spark, root):
    uploads = spark.createDataFrame(
        [(i, "t", f"{k}", f"{i}.pdf") for i, k in enumerate(
            ["a/1.pdf", "a/2.pdf", "b/3.pdf", "b/c/4.pdf", "no/file.pdf"])],
        "upload_id long, organization_id string, storage_key string, filename string")
    gated = gate.gate(gate.stored_uploads(uploads, stored_headers(spark, str(root))))
    assert {r["upload_id"]: r["reject_reason"] for r in gated.collect()} == {
        0: None, 1: fixed.CONTENT_INVALID, 2: fixed.FILE_EMPTY, 3: fixed.CONTENT_INVALID,
        4: fixed.FILE_EMPTY}


def test_no_files(spark, tmp_path):
    assert stored_headers(spark, str(tmp_path)).collect() == []


class Lines:
    """Ten bytes a page, read by place; counts the reads it makes."""

    def count(self, file):
        size = file.seek(0, os.SEEK_END)
        if size % 10:
            raise ValueError("cut off")
        return size // 10

    def read(self, file, first, stop):
        file.seek(first * 10)
        text = file.read((stop - first) * 10).decode()
        if "!" in text:
            raise ValueError("bad range")
        pages = [text[i:i + 10].strip() for i in range(0, len(text), 10)]
        return [None if p == "-" else p for p in pages]


def test_one_file_is_the_work_of_many_tasks(spark, tmp_path):
    def write(name, pages):
        (tmp_path / name).write_text("".join(f"{p:<10}" for p in pages))

    write("long", [f"page {i}" for i in range(1000)])
    write("short", ["one", "-", "three"])
    write("none", [])
    write("bad", ["a", "b", "!", "d"])
    (tmp_path / "cut").write_text("abc")
    files = spark.createDataFrame(
        [(1, "long"), (2, "short"), (3, "none"), (4, "bad"), (5, "cut"), (6, "missing")],
        "document_id long, storage_key string")
    ranges = page_ranges(files, f"file:{tmp_path}", Lines, 2)
    rows = read_page_ranges(ranges, str(tmp_path), Lines, 8).withColumn("task", F.spark_partition_id()).collect()
    by = {}
    for r in rows:
        by.setdefault(r["document_id"], []).append(
            (r["page_no"], r["text"], r["page_error"], r["open_failed"]))
    assert sorted(by[1]) == [(i, f"page {i}", False, False) for i in range(1000)]
    assert sorted(by[2], key=str) == [(0, "one", False, False), (1, None, True, False), (2, "three", False, False)]
    assert 3 not in by
    assert sorted(by[4], key=str) == [(0, "a", False, False), (1, "b", False, False), (2, None, True, False),
                                      (3, None, True, False)]
    assert by[5] == by[6] == [(None, None, False, True)]
    assert len({r["task"] for r in rows if r["document_id"] == 1}) == 8


def test_ranges_are_dealt_over_the_tasks_of_the_session(spark, tmp_path):
    keys = [f"d{i}/f" for i in range(40)]
    files = spark.createDataFrame([(k, b"<html><p>a<p>b\n") for k in keys], "storage_key string, content binary")
    root = f"file:{tmp_path}/files"
    assert sinks.write_files(files, root) == 40
    assert (tmp_path / "files" / "d7" / "f").read_bytes() == b"<html><p>a<p>b\n"
    assert sinks.write_files(files.limit(0), root) == 0
    named = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "document_id long, storage_key string")
    ranges = page_ranges(named, root, MarkupRanges, 2)
    read = read_page_ranges(ranges, root, MarkupRanges).withColumn("task", F.spark_partition_id()).collect()
    assert len(read) == 120 and len({r["task"] for r in read}) > 1
