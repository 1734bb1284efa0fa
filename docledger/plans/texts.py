"""Queries over page text, routing and recognition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger import fixed
from docledger.functions.text import non_space_count
from docledger.operators import pages
from docledger.operators.hooks import read_pages
from docledger.plans.samples import MarkupReader, WordRecogniser
from docledger.plans.standins import ctes, driver_table, frame
from docledger.plans.uploads import chars_sql


def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.assemble_pages(frame(spark, sf_dir, "pages"))


def page_assembly_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.assemble_parts(frame(spark, sf_dir, "pages"), pages_per_part=4)


def page_assembly_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = frame(spark, sf_dir, "images").select(
        "document_id", "page_no", "page_error", F.col("image").cast("string").alias("text")
    )
    return pages.assemble_strict(source)


def text_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = driver_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = texts.select(
        F.col("doc_id").alias("document_id"),
        non_space_count("text").cast("bigint").alias("non_space_chars"),
    )
    return counted.withColumn("is_meaningful", pages.has_meaningful_text(F.col("non_space_chars")))


def text_artifact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "documents").select(
        "document_id", pages.text_artifact_key().alias("storage_key")
    )


def native_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = pages.page_measures(frame(spark, sf_dir, "pages"))
    return pages.text_stage(frame(spark, sf_dir, "page_documents"), measures)


def text_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = frame(spark, sf_dir, "page_documents").where("NOT read_failed AND NOT open_failed")
    staged = pages.text_stage(good, pages.page_measures(frame(spark, sf_dir, "pages")))
    return staged.select("document_id", "page_count", "non_space_chars", "verdict_status")


def recognition_stage(spark: SparkSession, sf_dir: str, native: DataFrame) -> DataFrame:
    waiting = native.where(F.col("verdict_status") == "OCR_REQUIRED").select(
        "document_id", "organization_id"
    )
    images = frame(spark, sf_dir, "images").join(
        waiting.select("document_id"), "document_id", "left_semi"
    )
    return pages.ocr_stage(waiting, images, pages.recognised_pages(images, WordRecogniser))


def ocr_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = recognition_stage(spark, sf_dir, native_stage(spark, sf_dir))
    return staged.select(*pages.OUTCOME, "page_count", "non_space_chars")


def text_stage_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final outcome of the text stages: native, or recognition where routed."""
    native = native_stage(spark, sf_dir)
    return pages.text_outcomes(native, recognition_stage(spark, sf_dir, native))


def text_stage_outcome_without_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the recognition fallback off."""
    return pages.text_outcomes(native_stage(spark, sf_dir))


def page_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = driver_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("document_id"), F.encode("html", "utf-8").alias("content")
    )
    return read_pages(stored, MarkupReader).select(
        "document_id", "page_no", "page_error", "open_failed",
        non_space_count(pages.native_text()).cast("bigint").alias("non_space_chars"),
    )


_SEPARATOR = "chr(10) || chr(10)"

NATIVE_SQL = f"""measured AS (
  SELECT document_id, count(*) AS page_count,
    CAST(sum({chars_sql("coalesce(text, '')")}) AS BIGINT) AS chars
  FROM page_rows GROUP BY document_id
),
native AS (
  SELECT d.document_id, d.organization_id, d.read_failed, d.open_failed,
    coalesce(m.page_count, 0) AS page_count, coalesce(m.chars, 0) AS non_space_chars,
    CASE WHEN d.read_failed THEN '{fixed.READ_FAILED}'
      WHEN d.open_failed THEN '{fixed.OPEN_FAILED}' END AS error_message,
    CASE WHEN d.read_failed OR d.open_failed THEN 'FAILED'
      WHEN m.chars >= 20 THEN 'TEXT_EXTRACTED' ELSE 'OCR_REQUIRED' END AS verdict_status
  FROM page_documents d LEFT JOIN measured m ON m.document_id = d.document_id
)"""

OCR_SQL = f"""ocr_pages AS (
  SELECT i.document_id, i.page_error, decode(i.image) AS text FROM images i
  WHERE i.document_id IN (SELECT document_id FROM native WHERE verdict_status = 'OCR_REQUIRED')
),
ocr_docs AS (
  SELECT document_id, bool_or(page_error) AS render_failed,
    bool_or(text = 'unreadable') AS engine_failed, count(*) AS page_count,
    CAST(sum({chars_sql('text')}) FILTER (WHERE text <> 'unreadable') AS BIGINT) AS chars
  FROM ocr_pages GROUP BY document_id
),
ocr AS (
  SELECT document_id, organization_id, 'OCR' AS stage,
    CASE WHEN message IS NULL THEN 'TEXT_EXTRACTED' ELSE 'FAILED' END AS verdict_status,
    CASE WHEN message = '{fixed.ENGINE_FAILED}' THEN 'OCR_ERROR'
      WHEN message IS NOT NULL THEN 'PROCESSING_ERROR' END AS error_category,
    message AS error_message, page_count, non_space_chars
  FROM (
    SELECT n.document_id, n.organization_id,
      CASE WHEN o.render_failed THEN '{fixed.RENDER_FAILED}'
        WHEN o.engine_failed THEN '{fixed.ENGINE_FAILED}'
        WHEN coalesce(o.chars, 0) < 20 THEN '{fixed.NO_USABLE_TEXT}' END AS message,
      CASE WHEN o.render_failed THEN 0 ELSE coalesce(o.page_count, 0) END AS page_count,
      CASE WHEN o.render_failed THEN 0 ELSE coalesce(o.chars, 0) END AS non_space_chars
    FROM native n LEFT JOIN ocr_docs o ON o.document_id = n.document_id
    WHERE n.verdict_status = 'OCR_REQUIRED')
)"""

_KEY = (
    "CASE WHEN verdict_status = 'TEXT_EXTRACTED' THEN organization_id || '/' || document_id "
    "|| '/extracted_text.txt' END AS extracted_text_storage_key"
)

QUERIES = {
    "page_assembly": page_assembly,
    "page_assembly_parts": page_assembly_parts,
    "page_assembly_strict": page_assembly_strict,
    "text_adequacy": text_adequacy,
    "text_artifact_keys": text_artifact_keys,
    "text_route": text_route,
    "ocr_fallback": ocr_fallback,
    "text_stage_outcome": text_stage_outcome,
    "text_stage_outcome_without_ocr": text_stage_outcome_without_ocr,
    "page_reader": page_reader,
}

ORACLES = {
    "page_assembly": f"""WITH {ctes('pages')}
SELECT document_id, string_agg(coalesce(text, ''), {_SEPARATOR} ORDER BY page_no)
  AS combined_text, count(*) AS page_count FROM page_rows GROUP BY document_id""",
    "page_assembly_parts": f"""WITH {ctes('pages')}
SELECT document_id, CAST(page_no // 4 AS INTEGER) AS part_no,
  string_agg(coalesce(text, ''), {_SEPARATOR} ORDER BY page_no) AS part_text,
  count(*) AS page_count FROM page_rows GROUP BY document_id, page_no // 4""",
    "page_assembly_strict": f"""WITH {ctes('images')}
SELECT document_id, bool_or(page_error) AS render_failed, count(*) AS page_count,
  CASE WHEN NOT bool_or(page_error)
    THEN string_agg(decode(image), {_SEPARATOR} ORDER BY page_no) END AS combined_text
FROM images GROUP BY document_id""",
    "text_adequacy": f"""SELECT doc_id AS document_id, {chars_sql('text')} AS non_space_chars,
  {chars_sql('text')} >= 20 AS is_meaningful FROM documents""",
    "page_reader": f"""WITH parts AS (
  SELECT page_id, unnest(string_split(html, '<p>')) AS part,
    generate_subscripts(string_split(html, '<p>'), 1) AS n
  FROM pages WHERE contains(html, '<html'))
SELECT page_id AS document_id, CAST(n - 1 AS INTEGER) AS page_no, false AS page_error,
  false AS open_failed,
  {chars_sql("regexp_replace(part, '<[^>]*>', ' ', 'g')")} AS non_space_chars FROM parts
UNION ALL
SELECT page_id, NULL, false, true, 0 FROM pages WHERE NOT contains(html, '<html')""",
    "text_artifact_keys": f"""WITH {ctes('documents')}
SELECT document_id, organization_id || '/' || document_id || '/extracted_text.txt'
  AS storage_key FROM docs""",
    "text_route": f"""WITH {ctes('pages', 'page_documents')}, {NATIVE_SQL}
SELECT document_id, page_count, non_space_chars, verdict_status FROM native
WHERE NOT read_failed AND NOT open_failed""",
    "ocr_fallback": f"""WITH {ctes('pages', 'page_documents', 'images')}, {NATIVE_SQL}, {OCR_SQL}
SELECT document_id, stage, verdict_status, error_category, error_message, {_KEY},
  page_count, non_space_chars FROM ocr""",
    "text_stage_outcome": f"""WITH {ctes('pages', 'page_documents', 'images')},
{NATIVE_SQL}, {OCR_SQL}
SELECT document_id, 'TEXT_EXTRACTION' AS stage, verdict_status,
  CASE WHEN error_message IS NOT NULL THEN 'PROCESSING_ERROR' END AS error_category,
  error_message, {_KEY} FROM native WHERE verdict_status <> 'OCR_REQUIRED'
UNION ALL
SELECT document_id, stage, verdict_status, error_category, error_message, {_KEY} FROM ocr""",
    "text_stage_outcome_without_ocr": f"""WITH {ctes('pages', 'page_documents')}, {NATIVE_SQL}
SELECT document_id, 'TEXT_EXTRACTION' AS stage, verdict_status,
  CASE WHEN error_message IS NOT NULL THEN 'PROCESSING_ERROR' END AS error_category,
  error_message, {_KEY} FROM native""",
}
