"""Processing history: one row per document and attempted stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import fixed
from docledger.functions.ids import derived_id


def duration_ms(started: Column, completed: Column) -> Column:
    """Whole milliseconds, cut off after the same double arithmetic Python does."""
    micros = F.unix_micros(completed.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return (micros.cast("double") / F.lit(1e6) * F.lit(1000.0)).cast("bigint")


def stage_jobs(outcomes: DataFrame, run_id: str, started: Column, completed: Column) -> DataFrame:
    """Job rows of one stage's outcome frame.

    `outcomes` has document_id, stage and error_category / error_message; both
    the job and the document status follow from the same row. The times are
    literals of the run, so that a retried task writes the same row.
    """
    failed = F.col("error_category").isNotNull()
    return outcomes.select(
        derived_id("job", F.lit(run_id), "stage", "document_id").alias("job_id"),
        "document_id",
        "stage",
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        started.alias("started_at"),
        completed.alias("completed_at"),
        duration_ms(started, completed).cast("int").alias("duration_ms"),
        "error_category",
        "error_message",
        F.lit(None).cast("decimal(10,6)").alias("cost_usd"),
        F.when(
            ~failed & (F.col("stage") == "AI_EXTRACTION"), F.lit(fixed.PROVIDER_NAME)
        ).alias("provider_name"),
    )


def union_jobs(*stages: DataFrame) -> DataFrame:
    out = stages[0]
    for stage in stages[1:]:
        out = out.unionByName(stage)
    return out


def failed_documents(jobs: DataFrame) -> DataFrame:
    """Documents and jobs fail together: both come from the failed job rows."""
    return jobs.where(F.col("status") == "FAILED").select(
        "document_id", "job_id", "stage", F.lit("FAILED").alias("document_status"),
        "error_category", "error_message",
    )


def history(jobs: DataFrame) -> DataFrame:
    """Jobs in order within each document."""
    return jobs.orderBy("document_id", "created_at", "job_id")
