"""Queries over processing history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger import fixed
from docledger.operators import extract, findings, jobs
from docledger.plans.extraction import OUTCOME_SQL, PARSED_SQL
from docledger.plans.shown import shown, text_sql
from docledger.plans.standins import ctes, frame
from docledger.plans.texts import (
    NATIVE_SQL,
    OCR_SQL,
    native_stage,
    recognition_stage,
    text_stage_outcome,
)
from docledger.plans.uploads import id_sql

RUN = "run-1"
STARTED = "2024-01-01 00:00:00"
COMPLETED = "2024-01-01 00:00:01.234567"


def _stage_frames(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Outcome frames of the four stages; a failed recognition has two job rows."""
    text = native_stage(spark, sf_dir)
    recognised = recognition_stage(spark, sf_dir, text)
    parsed = extract.parse_payload(frame(spark, sf_dir, "payloads"), "raw_json")
    answers = extract.with_extraction_outcome(parsed).withColumn("stage", F.lit("AI_EXTRACTION"))
    checked = findings.validation_stage(
        frame(spark, sf_dir, "queue"), frame(spark, sf_dir, "drafts")
    )
    return [text, recognised, answers, checked]


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.lit(STARTED).cast("timestamp")
    completed = F.lit(COMPLETED).cast("timestamp")
    rows = jobs.union_jobs(*[
        jobs.stage_jobs(stage, RUN, started, completed)
        for stage in _stage_frames(spark, sf_dir)
    ])
    return shown(rows.drop("cost_usd"))


def job_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.lit(STARTED).cast("timestamp")
    rows = jobs.union_jobs(*[
        jobs.stage_jobs(stage, RUN, started, started) for stage in _stage_frames(spark, sf_dir)
    ])
    return jobs.failed_documents(rows)


def rerun_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final status of every document after running all stages again."""
    existing = frame(spark, sf_dir, "invoices").where("approved_by_user_id IS NOT NULL")
    parsed = extract.parse_payload(frame(spark, sf_dir, "payloads"), "raw_json")
    return extract.final_status(
        text_stage_outcome(spark, sf_dir), existing, extract.with_extraction_outcome(parsed)
    )


def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "jobs").select(
        "job_id",
        jobs.duration_ms(F.col("started_at"), F.col("completed_at")).alias("duration_ms"),
    )


def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(jobs.history(frame(spark, sf_dir, "jobs")).select(
        "document_id", "created_at", "job_id", "stage", "status"
    ))


STAGES_SQL = f"""{ctes('pages', 'page_documents', 'images', 'payloads', 'queue', 'drafts')},
{NATIVE_SQL}, {OCR_SQL}, {PARSED_SQL}, {OUTCOME_SQL},
stages AS (
  SELECT document_id, 'TEXT_EXTRACTION' AS stage,
    CASE WHEN error_message IS NOT NULL THEN 'PROCESSING_ERROR' END AS error_category,
    error_message FROM native
  UNION ALL
  SELECT document_id, stage, error_category, error_message FROM ocr
  UNION ALL
  SELECT document_id, 'AI_EXTRACTION', error_category, error_message FROM judged
  UNION ALL
  SELECT q.document_id, 'RESULT_VALIDATION',
    CASE WHEN d.document_id IS NULL THEN 'PROCESSING_ERROR' END,
    CASE WHEN d.document_id IS NULL THEN '{fixed.NO_DRAFT}' END
  FROM queue q LEFT JOIN drafts d ON d.document_id = q.document_id
),
logged AS (
  SELECT {id_sql('job', f"'{RUN}'", 'stage', 'document_id')} AS job_id, document_id, stage,
    CASE WHEN error_category IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status,
    error_category, error_message FROM stages
)"""

QUERIES = {
    "job_log": job_log,
    "job_failures": job_failures,
    "rerun_status": rerun_status,
    "job_durations": job_durations,
    "job_history": job_history,
}

ORACLES = {
    "job_log": f"""WITH {STAGES_SQL}
SELECT job_id, document_id, stage, status, '{STARTED}' AS started_at,
  '{COMPLETED}' AS completed_at, 1234 AS duration_ms, error_category, error_message,
  CASE WHEN status = 'SUCCESS' AND stage = 'AI_EXTRACTION' THEN '{fixed.PROVIDER_NAME}' END
    AS provider_name FROM logged""",
    "job_failures": f"""WITH {STAGES_SQL}
SELECT document_id, job_id, stage, 'FAILED' AS document_status, error_category, error_message
FROM logged WHERE status = 'FAILED'""",
    "rerun_status": f"""WITH {ctes('pages', 'page_documents', 'images', 'payloads', 'invoices')},
{NATIVE_SQL}, {OCR_SQL}, {PARSED_SQL}, {OUTCOME_SQL},
texts AS (
  SELECT document_id, verdict_status FROM native WHERE verdict_status <> 'OCR_REQUIRED'
  UNION ALL SELECT document_id, verdict_status FROM ocr
)
SELECT t.document_id, CASE WHEN verdict_status <> 'TEXT_EXTRACTED' THEN verdict_status
  WHEN t.document_id IN (SELECT document_id FROM invoices WHERE approved_by_user_id IS NOT NULL)
    OR j.document_id IS NULL THEN verdict_status
  WHEN j.error_message IS NOT NULL THEN 'FAILED' ELSE 'REVIEW_REQUIRED' END AS status
FROM texts t LEFT JOIN judged j ON j.document_id = t.document_id""",
    "job_durations": f"""WITH {ctes('jobs')}
SELECT job_id, CAST(trunc(CAST(epoch_us(completed_at) - epoch_us(started_at) AS DOUBLE)
  / 1e6::DOUBLE * 1000.0::DOUBLE) AS BIGINT) AS duration_ms FROM jobs""",
    "job_history": f"""WITH {ctes('jobs')}
SELECT document_id, {text_sql('created_at')}, job_id, stage, status FROM jobs""",
}
