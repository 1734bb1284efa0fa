"""Queries over the upload gate and stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger import fixed
from docledger.operators import gate
from docledger.plans.standins import ctes, frame
from docledger.sources.files import read_outcome


def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = gate.gate(frame(spark, sf_dir, "uploads"))
    return gated.select("upload_id", "organization_id", "reject_reason")


def upload_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.reject_counts(gate.gate(frame(spark, sf_dir, "uploads")))


def upload_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = gate.accepted_documents(gate.gate(frame(spark, sf_dir, "uploads")))
    return accepted.drop("extracted_text_storage_key")


def storage_read_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = frame(spark, sf_dir, "texts").select(
        "document_id",
        F.concat(F.lit("html/"), F.col("document_id").cast("string")).alias("storage_key"),
    )
    stored = frame(spark, sf_dir, "stored").withColumn("length", F.col("length").cast("bigint"))
    return read_outcome(documents, stored)


_SPACES = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def chars_sql(text: str) -> str:
    """Non-space character count in DuckDB."""
    return f"CAST(length(regexp_replace({text}, '{_SPACES}', '', 'g')) AS BIGINT)"


GATED_SQL = f"""gated AS (
  SELECT *, CASE
    WHEN filename IS NULL OR {chars_sql('filename')} = 0 THEN '{fixed.NAME_REQUIRED}'
    WHEN length(filename) > 255 THEN '{fixed.NAME_TOO_LONG}'
    WHEN filename LIKE '%/%' OR contains(filename, chr(92)) OR contains(filename, '..')
      THEN '{fixed.NAME_UNSAFE}'
    WHEN lower(filename) NOT LIKE '%.pdf' THEN '{fixed.TYPE_UNSUPPORTED}'
    WHEN size_bytes <= 0 THEN '{fixed.FILE_EMPTY}'
    WHEN size_bytes > 15728640 THEN '{fixed.FILE_OVERSIZED}'
    WHEN header IS NULL OR left(hex(header), 10) <> '255044462D' THEN '{fixed.CONTENT_INVALID}'
  END AS reject_reason FROM uploads
)"""


def id_sql(kind: str, *parts: str) -> str:
    """The derived identifier in DuckDB."""
    text = " || ':' || ".join([f"'{kind}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return (
        f"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', "
        r"'\1-\2-\3-\4-\5')"
    )


QUERIES = {
    "upload_gate": upload_gate,
    "upload_reject_counts": upload_reject_counts,
    "upload_accepted": upload_accepted,
    "storage_read_outcome": storage_read_outcome,
}

ORACLES = {
    "upload_gate": f"""WITH {ctes('uploads')}, {GATED_SQL}
SELECT upload_id, organization_id, reject_reason FROM gated""",
    "upload_reject_counts": f"""WITH {ctes('uploads')}, {GATED_SQL}
SELECT reject_reason, count(*) AS n_files, CASE WHEN reject_reason = '{fixed.CONTENT_INVALID}'
  THEN 'VALIDATION_ERROR' ELSE 'USER_ERROR' END AS error_class
FROM gated WHERE reject_reason IS NOT NULL GROUP BY reject_reason""",
    "upload_accepted": f"""WITH {ctes('uploads')}, {GATED_SQL}
SELECT {id_sql('document', 'organization_id', 'upload_id')} AS document_id, organization_id,
  user_id AS uploaded_by_user_id, filename AS original_filename,
  organization_id || '/' || {id_sql('file', 'organization_id', 'upload_id')} || '.pdf'
    AS storage_key,
  coalesce(nullif(content_type, ''), '{fixed.DEFAULT_CONTENT_TYPE}') AS content_type,
  CAST(size_bytes AS BIGINT) AS file_size_bytes, 'UPLOADED' AS status
FROM gated WHERE reject_reason IS NULL""",
    "storage_read_outcome": f"""WITH {ctes('stored')},
d AS (SELECT doc_id AS document_id, 'html/' || doc_id AS storage_key FROM documents)
SELECT d.document_id, d.storage_key, CAST(s.length AS BIGINT) AS length,
  CASE WHEN s.storage_key IS NULL THEN 'PROCESSING_ERROR' END AS error_category,
  CASE WHEN s.storage_key IS NULL THEN '{fixed.READ_FAILED}' END AS error_message
FROM d LEFT JOIN stored s ON s.storage_key = d.storage_key""",
}
