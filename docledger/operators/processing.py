"""Documents from stored file to findings, in one path over one id space.

Each stage is the operator of that name; this module keeps what the stages hand on and
derives drafts, findings, job rows and document statuses from the same kept outcomes, so
that they cannot disagree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import fixed
from docledger.operators import extract, findings, hooks, jobs, pages
from docledger.sources.ledger import Ledger

#: Tables that a run leaves, in the order they are written.
RESULTS = (
    "text_outcomes", "texts", "answers", "extractions", "invoices", "invoice_line_items",
    "findings", "processing_jobs", "document_statuses",
)


@dataclass(frozen=True)
class Hooks:
    """The user's Python. Without a renderer or recogniser documents stay at
    OCR_REQUIRED, without an extractor at TEXT_EXTRACTED."""

    reader: Callable[[], hooks.PageReader]
    renderer: Callable[[], hooks.PageRenderer] | None = None
    recogniser: Callable[[], hooks.Recogniser] | None = None
    extractor: Callable[[], hooks.Extractor] | None = None
    min_chars: int = fixed.MIN_TEXT_CHARS
    ocr_min_chars: int = fixed.MIN_TEXT_CHARS

    @property
    def recognises(self) -> bool:
        return self.renderer is not None and self.recogniser is not None


@dataclass(frozen=True)
class Run:
    """What job rows say about a run; literals, so that a replay writes the same rows."""

    run_id: str
    started: Column
    completed: Column


def read_files(files: DataFrame, used: Hooks) -> DataFrame:
    """Rows of files and pages of (storage_key, content); see `hooks.read_files`."""
    return hooks.read_files(
        files, used.reader, used.renderer, used.recogniser, used.min_chars)


def text_stages(documents: DataFrame, rows: DataFrame, used: Hooks) -> tuple[DataFrame, DataFrame | None]:
    """(native, recognised) stage outcomes of `documents` from the rows of their files.

    A document without a file row could not be read.
    """
    opened = rows.where("kind = 'file'").groupBy("storage_key").agg(
        F.bool_or("open_failed").alias("open_failed"))
    known = documents.select("document_id", "organization_id", "storage_key")
    flagged = known.join(opened, "storage_key", "left").select(
        "document_id", "organization_id", F.col("open_failed").isNull().alias("read_failed"),
        F.coalesce("open_failed", F.lit(False)).alias("open_failed"))
    own = rows.join(known.select("document_id", "storage_key"), "storage_key")
    native = pages.text_stage(
        flagged, pages.page_measures(own.where("kind = 'native'")), used.min_chars)
    if not used.recognises:
        return native, None
    waiting = native.where(F.col("verdict_status") == "OCR_REQUIRED").select(
        "document_id", "organization_id")
    images = own.where("kind = 'ocr'")
    return native, pages.ocr_stage(
        waiting, images, images.where("NOT page_error"), used.ocr_min_chars)


def assembled(outcomes: DataFrame, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """document_id, organization_id, extracted_text_storage_key, text of documents with text."""
    ready = outcomes.where(F.col("verdict_status") == "TEXT_EXTRACTED").join(
        documents.select("document_id", "organization_id", "storage_key"), "document_id")
    source = F.when(F.col("stage") == "OCR", "ocr").otherwise("native")
    own = rows.join(ready.select("document_id", "storage_key", source.alias("kind")),
                    ["storage_key", "kind"])
    return ready.join(pages.assemble_pages(own), "document_id").select(
        "document_id", "organization_id", "extracted_text_storage_key",
        F.col("combined_text").alias("text"))


def process(
    documents: DataFrame, rows: DataFrame, existing: DataFrame, used: Hooks, run: Run,
    keep: Callable[[DataFrame, str], DataFrame], ledger: Ledger | None = None,
) -> dict[str, DataFrame]:
    """Take documents as far as the hooks allow; the tables of RESULTS by name.

    `documents` has document_id, organization_id and storage_key, `rows` comes from
    `read_files` and should be a kept table, `existing` has the document_id of all drafts
    there are: such documents are read again and end at TEXT_EXTRACTED, as nobody is
    asked about them twice. `keep` writes a frame under a name and reads it back.
    """
    native, recognised = text_stages(documents, rows, used)
    native = keep(native, "native")
    if recognised is not None:
        recognised = keep(recognised, "recognised")
    outcomes = keep(pages.text_outcomes(native, recognised), "text_outcomes")
    texts = keep(assembled(outcomes, documents, rows), "texts")
    stages = [native] if recognised is None else [native, recognised]

    had = existing.select("document_id").distinct()
    new = texts.join(had, "document_id", "left_anti")
    if not used.extractor:
        new = new.where(F.lit(False))
    answers = keep(hooks.run_extractor(
        extract.requests(new), used.extractor or _Unused, ledger), "answers")
    parsed = keep(extract.with_extraction_outcome(
        extract.parse_payload(answers, "raw_json")), "extractions")
    stages.append(parsed.select(
        "document_id", "error_category", "error_message", F.lit("AI_EXTRACTION").alias("stage")))
    good = parsed.where(F.col("error_message").isNull())
    drafts = keep(extract.draft_headers(good), "invoices")
    lines = keep(extract.draft_lines(good), "invoice_line_items")
    found = keep(findings.all_findings(drafts, lines), "findings")
    stages.append(findings.validation_stage(
        good.select("document_id"), drafts.select("document_id")))
    history = keep(jobs.union_jobs(*[
        jobs.stage_jobs(s, run.run_id, run.started, run.completed) for s in stages]),
        "processing_jobs")
    status = extract.final_status(outcomes, had, parsed)
    keys = outcomes.select("document_id", "extracted_text_storage_key")
    statuses = keep(status.join(keys, "document_id"), "document_statuses")
    made = (outcomes, texts, answers, parsed, drafts, lines, found, history, statuses)
    return dict(zip(RESULTS, made, strict=True))


class _Unused:
    """Stands in where nothing is asked."""

    def extract(self, text: str) -> dict:
        raise RuntimeError("no extractor")
