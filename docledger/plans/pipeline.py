"""Whole runs from stored files to findings, as a batch and as a stream.

The web pages stand in for uploaded files and are written as real files, one each.
Some documents have no file, some files no native text, some cannot be rendered, and some
documents have a draft from before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger import fixed
from docledger.functions.text import non_space_count
from docledger.operators import gate, pages, processing
from docledger.plans.samples import (
    LengthExtractor,
    MarkupRanges,
    ParagraphRenderer,
    ScanReader,
    WordRecogniser,
)
from docledger.plans.standins import driver_table
from docledger.plans.uploads import GATED_SQL, chars_sql
from docledger.sources.files import stored_file_stream, stored_files
from docledger.sources.headers import stored_headers
from docledger.sources.ledger import Ledger
from docledger.sources.ranges import page_ranges, read_page_ranges
from docledger.sources.sinks import write_files
from docledger.sources.workspace import new_path, persisted
from docledger.streaming import pipeline

BATCHES = 4
HOOKS = processing.Hooks(ScanReader, ParagraphRenderer, WordRecogniser, LengthExtractor)

_KEY = "concat('file=', CAST(page_id AS STRING))"
_CONTENT = ("CASE WHEN page_id % 7 = 3 THEN html WHEN page_id % 7 = 5 THEN '%PD' "
            "ELSE concat('%PDF-', html) END")
_NAME = ("CASE WHEN page_id % 11 = 2 THEN NULL WHEN page_id % 11 = 4 THEN 'a/b.pdf' "
         "ELSE concat('Page ', CAST(page_id AS STRING), '.PDF') END")
_MOST_BYTES = 6_000
_LOST, _HAD = "page_id % 37 = 5", "page_id % 9 = 4"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_table(spark, sf_dir, "pages").selectExpr(
        "page_id AS document_id", "page_id % 20 AS organization_id", f"{_KEY} AS storage_key")


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_table(spark, sf_dir, "pages").where(_HAD).selectExpr("page_id AS document_id")


def _write_files(spark: SparkSession, sf_dir: str, root: str, content: str = "html") -> int:
    """One file per page, a line, under a folder of its name; how many there are."""
    rows = driver_table(spark, sf_dir, "pages").where(f"NOT ({_LOST})")
    return write_files(rows.selectExpr(
        f"concat({_KEY}, '/page.txt') AS storage_key",
        f"CAST(concat(coalesce({content}, ''), '\\n') AS BINARY) AS content"), root)


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("storage_key", F.regexp_extract("storage_key", "^(file=[^/]*)/", 1))


def _run(run_id: str) -> processing.Run:
    return processing.Run(
        run_id, F.lit("2024-01-01 00:00:00").cast("timestamp"),
        F.lit("2024-01-01 00:01:00").cast("timestamp"))


def _shown(jobs: DataFrame, statuses: DataFrame, invoices: DataFrame, found: DataFrame) -> DataFrame:
    counted = invoices.select("document_id", "invoice_id").join(
        found.groupBy("invoice_id").agg(F.count("*").alias("n_findings")), "invoice_id", "left",
    ).select("document_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
    return jobs.select(
        "document_id", "stage", F.col("status").alias("job_status"), "error_category", "error_message",
    ).join(statuses.select("document_id", F.col("status").alias("document_status")), "document_id",
    ).join(counted, "document_id", "left")


def file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over real files, of which it reads five bytes each."""
    root = new_path(spark, "file-gate")
    _write_files(spark, sf_dir, root, _CONTENT)
    headers = _named(stored_headers(spark, root, files_per_task=100))
    uploads = driver_table(spark, sf_dir, "pages").selectExpr(
        "page_id AS upload_id", "page_id % 20 AS organization_id", f"{_KEY} AS storage_key",
        f"{_NAME} AS filename")
    return gate.gate(gate.stored_uploads(uploads, headers), _MOST_BYTES).select(
        "upload_id", "organization_id", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        "reject_reason")


def page_reader_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of real files in ranges of eight, each range a piece of work of its own."""
    root = new_path(spark, "page-ranges")
    _write_files(spark, sf_dir, root)
    keys = stored_headers(spark, root, 0).select(
        F.regexp_extract("storage_key", "^file=([^/]*)/", 1).cast("bigint").alias("document_id"),
        "storage_key")
    ranges = page_ranges(keys, root, MarkupRanges, 8)
    return read_page_ranges(ranges, root, MarkupRanges).select(
        "document_id", "page_no", "page_error", "open_failed",
        non_space_count(pages.native_text()).cast("bigint").alias("non_space_chars"))


def file_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rows of a whole batch, with each document's status and findings."""
    root = new_path(spark, "file-pipeline")
    _write_files(spark, sf_dir, f"{root}/files")
    files = _named(stored_files(spark, f"{root}/files"))
    rows = persisted(processing.read_files(files, HOOKS), "file-rows")
    made = processing.process(
        _documents(spark, sf_dir), rows, _existing(spark, sf_dir), HOOKS, _run("file-pipeline"),
        persisted, Ledger(f"{root}/ledger"))
    return _shown(*(made[n] for n in (
        "processing_jobs", "document_statuses", "invoices", "findings")))


def stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of the files in several micro-batches."""
    root = new_path(spark, "stream-pipeline")
    count = _write_files(spark, sf_dir, f"{root}/files")
    files = _named(stored_file_stream(
        spark, f"{root}/files", max(1, -(-count // BATCHES)), f"{root}/lists"))
    documents, existing = _documents(spark, sf_dir), _existing(spark, sf_dir)
    run = _run("stream-pipeline")
    pipeline.start_pipeline(
        files, f"{root}/out", f"{root}/checkpoint", documents, existing, HOOKS, run,
    ).awaitTermination()
    pipeline.process_missing(spark, f"{root}/out", documents, existing, HOOKS, run)
    shown = (
        ("processing_jobs", "document_id bigint, stage string, status string, "
                            "error_category string, error_message string"),
        ("document_statuses", "document_id bigint, status string"),
        ("invoices", "document_id bigint, invoice_id string"),
        ("findings", "invoice_id string, code string"),
    )
    return _shown(*(pipeline.results(spark, f"{root}/out", name, schema) for name, schema in shown))


QUERIES = {
    "file_gate": file_gate,
    "page_reader_ranges": page_reader_ranges,
    "file_pipeline": file_pipeline,
    "stream_pipeline": stream_pipeline,
}

_JOINED = "chr(10) || chr(10) ORDER BY i"
_SQL = f"""WITH files AS (
  SELECT page_id AS document_id, html || chr(10) AS content, strlen(html) + 1 AS n,
    {_LOST} AS lost, {_HAD} AS had, NOT contains(html, '<html') AS unopened
  FROM pages
),
parts AS (
  SELECT document_id, n, unnest(string_split(content, '<p>')) AS part,
    generate_subscripts(string_split(content, '<p>'), 1) AS i
  FROM files WHERE NOT lost AND NOT unopened
),
texts AS (
  SELECT document_id, n,
    string_agg(CASE WHEN n % 5 = 0 THEN '' ELSE regexp_replace(part, '<[^>]*>', ' ', 'g') END,
      {_JOINED}) AS native,
    CASE WHEN n % 35 = 0 THEN ' ' ELSE string_agg(part, {_JOINED}) END AS seen
  FROM parts GROUP BY document_id, n
),
first_stage AS (
  SELECT f.*, native, seen, CASE WHEN lost THEN '{fixed.READ_FAILED}'
    WHEN unopened THEN '{fixed.OPEN_FAILED}' END AS first_error,
    NOT lost AND NOT unopened AND {chars_sql('native')} < 20 AS routed
  FROM files f LEFT JOIN texts t ON t.document_id = f.document_id
),
second_stage AS (
  SELECT *, CASE WHEN NOT routed THEN NULL
    WHEN n % 25 = 0 OR (n % 35 <> 0 AND n % 55 = 0) THEN '{fixed.RENDER_FAILED}'
    WHEN n % 35 <> 0 AND n % 65 = 0 THEN '{fixed.ENGINE_FAILED}'
    WHEN {chars_sql('seen')} < 20 THEN '{fixed.NO_USABLE_TEXT}' END AS second_error
  FROM first_stage
),
asked AS (
  SELECT *, length(CASE WHEN routed THEN seen ELSE native END) AS size,
    first_error IS NULL AND second_error IS NULL AND NOT had AS is_asked
  FROM second_stage
),
answered AS (
  SELECT *, CASE WHEN NOT is_asked THEN NULL
    WHEN size % 19 = 0 THEN CASE size % 3 WHEN 0 THEN '{fixed.PROVIDER_ERRORS["timeout"]}'
      WHEN 1 THEN '{fixed.PROVIDER_ERRORS["auth"]}' ELSE '{fixed.PROVIDER_ERRORS["response"]}' END
    WHEN size % 23 = 0 THEN '{fixed.PROVIDER_ERRORS["other"]}'
    WHEN size % 29 = 0 THEN '{fixed.SCHEMA_MISMATCH}' END AS third_error
  FROM asked
),
ended AS (
  SELECT *, CASE WHEN coalesce(first_error, second_error, third_error) IS NOT NULL THEN 'FAILED'
    WHEN is_asked THEN 'REVIEW_REQUIRED' ELSE 'TEXT_EXTRACTED' END AS document_status,
    CASE WHEN is_asked AND third_error IS NULL THEN 6 + size % 2 END AS n_findings
  FROM answered
),
steps AS (
  SELECT *, 'TEXT_EXTRACTION' AS stage, first_error AS error_message FROM ended
  UNION ALL SELECT *, 'OCR', second_error FROM ended WHERE routed
  UNION ALL SELECT *, 'AI_EXTRACTION', third_error FROM ended WHERE is_asked
  UNION ALL SELECT *, 'RESULT_VALIDATION', NULL FROM ended WHERE n_findings IS NOT NULL
)
SELECT document_id, stage, CASE WHEN error_message IS NULL THEN 'SUCCESS' ELSE 'FAILED' END
  AS job_status, CASE WHEN error_message IS NULL THEN NULL WHEN stage = 'AI_EXTRACTION'
    THEN 'AI_PROVIDER_ERROR' WHEN error_message = '{fixed.ENGINE_FAILED}' THEN 'OCR_ERROR'
    ELSE 'PROCESSING_ERROR' END AS error_category, error_message, document_status, n_findings
FROM steps"""

ORACLES = {
    "file_gate": f"""WITH uploads AS (
  SELECT page_id AS upload_id, page_id % 20 AS organization_id, {_NAME} AS filename,
    CASE WHEN {_LOST} THEN 0 ELSE strlen({_CONTENT}) + 1 END AS size_bytes,
    encode({_CONTENT}) AS header FROM pages
), {GATED_SQL.replace(str(fixed.MAX_UPLOAD_BYTES), str(_MOST_BYTES))}
SELECT upload_id, organization_id, size_bytes, reject_reason FROM gated""",
    "page_reader_ranges": f"""WITH parts AS (
  SELECT page_id, unnest(string_split(html, '<p>')) AS part,
    generate_subscripts(string_split(html, '<p>'), 1) AS n
  FROM pages WHERE contains(html, '<html') AND NOT ({_LOST}))
SELECT page_id AS document_id, CAST(n - 1 AS INTEGER) AS page_no, false AS page_error,
  false AS open_failed,
  {chars_sql("regexp_replace(part, '<[^>]*>', ' ', 'g')")} AS non_space_chars FROM parts
UNION ALL
SELECT page_id, NULL, false, true, 0 FROM pages WHERE NOT contains(html, '<html') AND NOT ({_LOST})""",
    "file_pipeline": _SQL,
    "stream_pipeline": _SQL,
}
