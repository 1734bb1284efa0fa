from __future__ import annotations

import sys

import pytest
from builders import build
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docledger import fixed, schemas
from docledger.functions.text import is_blank, non_space_count
from docledger.operators import pages
from docledger.operators.hooks import read_pages
from docledger.sources.files import read_outcome, stored_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLES = ["", " ", "abc", " a b\tc\n", "\x1c\x1d\x1e\x1fx", "\x85y\xa0", "   ",
           "    　z", "​z", "é ü 漢字", "﻿", "᠎"]


def test_white_space_is_pythons(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    for row in df.select("s", non_space_count("s").alias("n"), is_blank("s").alias("b")).collect():
        assert row["n"] == len("".join(row["s"].split())), repr(row["s"])
        assert row["b"] is (not row["s"].strip()), repr(row["s"])


def test_every_character_is_classed_like_python(spark):
    df = spark.range(1, 0x10000).where("id NOT BETWEEN 55296 AND 57343").select(
        F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"), "id")
    blank = df.where(non_space_count("c") == 0).union(df.where(is_blank("c")))
    spaces = [i for i in range(1, 0x10000) if chr(i).isspace()]
    assert sorted(r["id"] for r in blank.collect()) == sorted(spaces * 2)


def page_rows(spark, rows):
    return build(spark, schemas.PAGES, [
        dict(zip(("document_id", "page_no", "text", "page_error"), r, strict=True)) for r in rows])


def test_pages_join_in_order_and_bad_pages_stay_counted(spark):
    df = page_rows(spark, [("d", 10, "c", False), ("d", 2, "b", False), ("d", 1, None, True),
                           ("e", 0, "x", False), ("d", 3, "lost", True)])
    rows = {r["document_id"]: r for r in pages.assemble_pages(df).collect()}
    assert rows["d"]["combined_text"] == "\n\nb\n\n\n\nc"
    assert rows["d"]["page_count"] == 4
    assert rows["e"]["combined_text"] == "x"
    strict = {r["document_id"]: r for r in pages.assemble_strict(df).collect()}
    assert strict["d"]["render_failed"] and strict["d"]["combined_text"] is None
    assert strict["e"]["combined_text"] == "x"


def test_parts_joined_give_the_whole_text(spark):
    df = page_rows(spark, [("d", i, f"page {i}", i % 7 == 3) for i in range(50)])
    whole = pages.assemble_pages(df).first()["combined_text"]
    parts = sorted((r["part_no"], r["part_text"])
                   for r in pages.assemble_parts(df, pages_per_part=8).collect())
    assert len(parts) == 7
    assert "\n\n".join(text for _, text in parts) == whole
    measured = pages.page_measures(df).first()
    assert measured["non_space_chars"] == len("".join(whole.split()))


def stage(spark, rows, **flags):
    docs = spark.createDataFrame(
        [("d", "a", flags.get("read_failed", False), flags.get("open_failed", False))],
        "document_id string, organization_id string, read_failed boolean, open_failed boolean")
    return pages.text_stage(docs, pages.page_measures(page_rows(spark, rows))).first()


@pytest.mark.parametrize(("size", "status"), [(19, "OCR_REQUIRED"), (20, "TEXT_EXTRACTED")])
def test_threshold(spark, size, status):
    row = stage(spark, [("d", 0, "x " * (size - 5), False), ("d", 1, "y" * 5, False)])
    assert (row["verdict_status"], row["error_category"]) == (status, None)
    key = "a/d/extracted_text.txt" if status == "TEXT_EXTRACTED" else None
    assert row["extracted_text_storage_key"] == key


def test_no_pages_go_to_recognition(spark):
    row = stage(spark, [("other", 0, "x" * 50, False)])
    assert (row["verdict_status"], row["page_count"]) == ("OCR_REQUIRED", 0)


@pytest.mark.parametrize(("flag", "message"), [
    ("read_failed", fixed.READ_FAILED), ("open_failed", fixed.OPEN_FAILED)])
def test_failures(spark, flag, message):
    row = stage(spark, [("d", 0, "x" * 50, False)], **{flag: True})
    assert (row["verdict_status"], row["error_category"], row["error_message"]) == (
        "FAILED", "PROCESSING_ERROR", message)


class Engine:
    def run(self, image):
        text = image.decode()
        if text == "boom":
            raise RuntimeError("engine")
        return text


def test_recognition_outcomes(spark):
    images = build(spark, schemas.PAGE_IMAGES, [
        {"document_id": d, "page_no": n, "image": t.encode(), "page_error": e} for d, n, t, e in [
            ("ok", 0, "x" * 15, False), ("ok", 1, "y" * 5, False), ("low", 0, "tiny", False),
            ("crash", 0, "x" * 30, False), ("crash", 1, "boom", False),
            ("render", 0, "boom", False), ("render", 1, "", True)]])
    docs = spark.createDataFrame([(d, "a") for d in ("ok", "low", "crash", "render")],
                                 "document_id string, organization_id string")
    read = pages.recognised_pages(images, Engine)
    rows = {r["document_id"]: (r["verdict_status"], r["error_category"], r["error_message"])
            for r in pages.ocr_stage(docs, images, read).collect()}
    assert rows == {
        "ok": ("TEXT_EXTRACTED", None, None),
        "low": ("FAILED", "PROCESSING_ERROR", fixed.NO_USABLE_TEXT),
        "crash": ("FAILED", "OCR_ERROR", fixed.ENGINE_FAILED),
        "render": ("FAILED", "PROCESSING_ERROR", fixed.RENDER_FAILED),
    }
    assert ("render", 1) not in {(r["document_id"], r["page_no"]) for r in read.collect()}


class FormFeedReader:
    def read(self, content):
        if not content.startswith(b"%PDF-"):
            raise ValueError("not a document")
        return [None if p == "bad" else p for p in content[5:].decode().split("\f")]


def test_stored_files_are_read_and_split_into_pages(spark, tmp_path):
    for key, content in {"a/1.pdf": b"%PDF-one\fbad\fthree", "a/2.pdf": b"garbage",
                         "b/big.pdf": b"%PDF-" + b"x" * 100}.items():
        path = tmp_path / key
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    files = stored_files(spark, str(tmp_path))
    docs = spark.createDataFrame([("1", "a/1.pdf"), ("2", "a/2.pdf"), ("3", "a/3.pdf"),
                                  ("4", "b/big.pdf")], "document_id string, storage_key string")
    outcome = read_outcome(docs, files)
    failed = {r["document_id"]: r["error_message"] for r in outcome.collect()}
    assert failed == {"1": None, "2": None, "3": fixed.READ_FAILED, "4": None}
    for root in (f"file://{tmp_path}", f"file:{tmp_path}/", f"{tmp_path}/"):
        keys = [r["storage_key"] for r in stored_files(spark, root).collect()]
        assert sorted(keys) == ["a/1.pdf", "a/2.pdf", "b/big.pdf"]
    small = outcome.where("length < 50")
    found = read_pages(small.where(F.col("content").isNotNull()), FormFeedReader).collect()
    rows = sorted((r["document_id"], r["page_no"] if r["page_no"] is not None else -1, r["text"],
                   r["page_error"], r["open_failed"]) for r in found)
    assert rows == [("1", 0, "one", False, False), ("1", 1, None, True, False),
                    ("1", 2, "three", False, False), ("2", -1, None, False, True)]
