"""Stored files to findings: stages, batch against stream, replays, crashes, the ledger."""

from __future__ import annotations

import os
import sys
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docledger import fixed
from docledger.operators import hooks, processing
from docledger.sources.files import stored_file_stream, stored_files
from docledger.sources.ledger import Ledger, drop_ledger
from docledger.streaming import pipeline

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONG = "enough native text to be read without help"


class Reader:
    """A file is its pages, one a line; `scan` has none, `broken` cannot be opened."""

    def read(self, content):
        text = content.decode()
        if text.startswith("broken"):
            raise ValueError(text)
        return [None if x == "-" else x for x in text.split("\n")]


class Renderer:
    def render(self, content):
        text = content.decode()
        if "unrenderable" in text:
            raise ValueError(text)
        return [None if "halfway" in text and i else LONG.encode() if "legible" in text else b"jam"
                if "jam" in text else b" " for i, _ in enumerate(text.split("\n"))]


class Engine:
    def run(self, image):
        if image == b"jam":
            raise RuntimeError("engine")
        return image.decode()


class Extractor:
    """Leaves one file per call."""

    def __init__(self, folder):
        self.folder = folder

    def extract(self, text):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(text)
        if "slow" in text:
            raise hooks.ExtractorError("timeout")
        if "odd" in text:
            return {"vendor_name": 3}
        return {"vendor_name": text[:9], "line_items": [{"quantity": 1, "unit_price": 1, "amount": 5}]}


FILES = {
    "a/1": LONG, "a/2": f"{LONG}\n-", "a/3": "broken", "a/4": "scan legible", "a/5": "scan unrenderable",
    "a/6": "halfway\n-", "b/7": "scan jam", "b/8": "scan", "b/9": f"{LONG} slow", "b/10": f"{LONG} odd",
    "b/11": f"{LONG} had", "b/12": "scan legible\n-",
}
WANT = {
    1: ("REVIEW_REQUIRED", None), 2: ("REVIEW_REQUIRED", None), 3: ("FAILED", fixed.OPEN_FAILED),
    4: ("REVIEW_REQUIRED", None), 5: ("FAILED", fixed.RENDER_FAILED), 6: ("FAILED", fixed.RENDER_FAILED),
    7: ("FAILED", fixed.ENGINE_FAILED), 8: ("FAILED", fixed.NO_USABLE_TEXT),
    9: ("FAILED", fixed.PROVIDER_ERRORS["timeout"]), 10: ("FAILED", fixed.SCHEMA_MISMATCH),
    11: ("TEXT_EXTRACTED", None), 12: ("REVIEW_REQUIRED", None), 13: ("FAILED", fixed.READ_FAILED),
}


@pytest.fixture
def case(spark, tmp_path):
    """Documents 1 to 13, the last without a file, document 11 with a draft."""
    calls = tmp_path / "calls"
    calls.mkdir()
    for i, (key, text) in enumerate(FILES.items()):
        path = tmp_path / "files" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (time.time() - 100 + i,) * 2)
    documents = spark.createDataFrame(
        [(int(k.split("/")[1]), k.split("/")[0], k) for k in [*FILES, "b/13"]],
        "document_id long, organization_id string, storage_key string")
    existing = spark.createDataFrame([(11,)], "document_id long")
    folder = str(calls)
    used = processing.Hooks(Reader, Renderer, Engine, lambda: Extractor(folder))
    return str(tmp_path), documents, existing, used, calls


def run(name="run"):
    return processing.Run(name, F.lit("2024-01-01 00:00:00").cast("timestamp"),
                          F.lit("2024-01-01 00:00:02").cast("timestamp"))


def in_folder(root):
    def keep(df, name):
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")
    return keep


def told(jobs, statuses):
    """(status, message of the failed stage) by document, and the stages of each."""
    messages, stages = {}, {}
    for r in jobs.collect():
        stages.setdefault(r["document_id"], set()).add(r["stage"])
        assert (r["status"] == "FAILED") == (r["error_message"] is not None)
        if r["error_message"]:
            assert r["document_id"] not in messages
            messages[r["document_id"]] = r["error_message"]
    return {r["document_id"]: (r["status"], messages.get(r["document_id"]))
            for r in statuses.collect()}, stages


def batch(spark, case, used=None, name="batch"):
    root, documents, existing, default, _ = case
    used = used or default
    keep = in_folder(f"{root}/{name}")
    rows = keep(processing.read_files(stored_files(spark, f"{root}/files"), used), "rows")
    return processing.process(documents, rows, existing, used, run(), keep)


def test_a_batch_takes_every_document_to_its_end(spark, case):
    made = batch(spark, case)
    assert tuple(made) == processing.RESULTS
    status, stages = told(made["processing_jobs"], made["document_statuses"])
    assert status == WANT
    text, ocr = {"TEXT_EXTRACTION"}, {"TEXT_EXTRACTION", "OCR"}
    done = {"AI_EXTRACTION", "RESULT_VALIDATION"}
    assert stages == {
        1: text | done, 2: text | done, 3: text, 4: ocr | done, 5: ocr, 6: ocr, 7: ocr, 8: ocr,
        9: text | {"AI_EXTRACTION"}, 10: text | {"AI_EXTRACTION"}, 11: text, 12: ocr | done, 13: text}
    texts = {r["document_id"]: r["text"] for r in made["texts"].collect()}
    assert texts[2] == f"{LONG}\n\n" and texts[12] == f"{LONG}\n\n{LONG}" and 8 not in texts
    codes = {r["code"] for r in made["findings"].collect()}
    assert codes == {"FIELD_MISSING", "LINE_ITEM_AMOUNT_MISMATCH"}
    assert len(list(case[4].iterdir())) == 6


def test_stages_that_are_off_stop_documents_where_they_are(spark, case):
    reader_only = batch(spark, case, processing.Hooks(Reader), "reader")
    status, _ = told(reader_only["processing_jobs"], reader_only["document_statuses"])
    assert {i for i, (s, _) in status.items() if s == "OCR_REQUIRED"} == {4, 5, 6, 7, 8, 12}
    assert {i for i, (s, _) in status.items() if s == "TEXT_EXTRACTED"} == {1, 2, 9, 10, 11}
    no_extractor = batch(spark, case, processing.Hooks(Reader, Renderer, Engine), "unasked")
    status, stages = told(no_extractor["processing_jobs"], no_extractor["document_statuses"])
    assert {i for i, (s, _) in status.items() if s == "TEXT_EXTRACTED"} == {1, 2, 4, 9, 10, 11, 12}
    assert no_extractor["invoices"].count() == 0 and not list(case[4].iterdir())
    assert not any("AI_EXTRACTION" in s for s in stages.values())


SHOWN = {
    "processing_jobs": "document_id long, stage string, status string, error_category string, "
                       "error_message string",
    "document_statuses": "document_id long, status string",
    "findings": "invoice_id string, field string, code string, message string",
    "invoices": "invoice_id string, document_id long, vendor_name string",
    "texts": "document_id long, text string",
}


def streamed(spark, root):
    return {n: pipeline.results(spark, root, n, s).drop("batch_id") for n, s in SHOWN.items()}


def same_rows(a, b):
    for name, frame in a.items():
        want = b[name].select(*frame.columns)
        assert sorted(map(str, frame.collect())) == sorted(map(str, want.collect())), name


def test_a_stream_equals_the_batch_also_when_batches_are_replayed(spark, case):
    root, documents, existing, used, calls = case
    made = batch(spark, case)
    for call in calls.iterdir():
        call.unlink()
    out = f"{root}/out"
    files = stored_file_stream(spark, f"{root}/files", 3)
    pipeline.start_pipeline(
        files, out, f"{root}/checkpoint", documents, existing, used, run()).awaitTermination()
    assert pipeline.committed(spark, out).count() == 4
    pipeline.process_missing(spark, out, documents, existing, used, run())
    same_rows(streamed(spark, out), made)
    assert len(list(calls.iterdir())) == 6
    # A batch that counts is not done again, whatever comes under its number.
    again = stored_files(spark, f"{root}/files")
    pipeline.process_batch(again, 2, out, documents, existing, used, run())
    same_rows(streamed(spark, out), made)
    # Files that come again are read again, and nobody is asked again.
    pipeline.process_batch(
        again.where("storage_key = 'a/1'"), 9, out, documents, existing, used, run())
    assert len(list(calls.iterdir())) == 6
    last = pipeline.results(spark, out, "document_statuses", SHOWN["document_statuses"])
    assert [tuple(r) for r in last.where("batch_id = 9").collect()] == [(1, "TEXT_EXTRACTED", 9)]


def test_a_batch_that_dies_leaves_nothing_and_is_not_paid_twice(spark, case, monkeypatch):
    root, documents, existing, used, calls = case
    files, out = stored_files(spark, f"{root}/files"), f"{root}/out"
    whole = processing.findings.all_findings
    monkeypatch.setattr(processing.findings, "all_findings", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pipeline.process_batch(files, 0, out, documents, existing, used, run())
    assert pipeline.committed(spark, out).count() == 0
    assert all(f.count() == 0 for f in streamed(spark, out).values())
    assert len(list(calls.iterdir())) == 6
    monkeypatch.setattr(processing.findings, "all_findings", whole)
    pipeline.process_batch(files, 0, out, documents, existing, used, run())
    pipeline.process_missing(spark, out, documents, existing, used, run())
    assert len(list(calls.iterdir())) == 6
    same_rows(streamed(spark, out), batch(spark, case))
    assert not os.path.exists(f"{out}/ledger/batch_id=0")


class Dying(Extractor):
    """Ends its process in the middle, once."""

    def extract(self, text):
        if len(os.listdir(self.folder)) == 5 and not os.path.exists(f"{self.folder}-died"):
            open(f"{self.folder}-died", "w").close()
            os._exit(1)
        return super().extract(text)


def test_a_task_that_is_killed_asks_once_per_document(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)
    ledger = Ledger(f"file:{tmp_path}/ledger")
    requests = spark.range(12).selectExpr(
        "id AS document_id", "concat('text ', id, IF(id = 3, ' slow', '')) AS request_text").coalesce(1)
    with pytest.raises(Exception, match="worker exited|crashed"):
        hooks.run_extractor(requests, lambda: Dying(folder), ledger).collect()
    assert len(list(calls.iterdir())) == 5
    got = hooks.run_extractor(requests, lambda: Dying(folder), ledger).collect()
    assert len(list(calls.iterdir())) == 12
    assert {r["document_id"]: r["error_kind"] for r in got} == {
        i: "timeout" if i == 3 else None for i in range(12)}
    # Another text of the same document is another request.
    changed = requests.withColumn("request_text", F.concat("request_text", F.lit(" again")))
    hooks.run_extractor(changed.limit(1), lambda: Dying(folder), ledger).collect()
    assert len(list(calls.iterdir())) == 13
    drop_ledger(spark, ledger)
    assert not os.path.exists(f"{tmp_path}/ledger")
