"""Queries over findings, and their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger import fixed
from docledger.operators import findings
from docledger.plans.standins import ctes, frame


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return frame(spark, sf_dir, "invoices"), frame(spark, sf_dir, "lines")


def findings_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.missing_fields(frame(spark, sf_dir, "invoices"))


def findings_no_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.no_line_findings(*_both(spark, sf_dir))


def findings_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.total_mismatches(frame(spark, sf_dir, "invoices"))


def findings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.line_mismatches(frame(spark, sf_dir, "lines"))


def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.all_findings(*_both(spark, sf_dir))


def invoice_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.verdicts(*_both(spark, sf_dir))


def nested_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested lines shown as text, so that both engines can be compared."""
    nested = findings.nested_invoices(*_both(spark, sf_dir))

    def shown(x):
        return F.concat_ws(
            ":", x["line_index"].cast("string"), x["description"], x["quantity"].cast("string"),
            x["unit_price"].cast("string"), F.coalesce(x["amount"].cast("string"), F.lit("-")),
        )

    return nested.select(
        "invoice_id", "part_no", "vendor_name", F.col("total").cast("string").alias("total"),
        F.size("line_items").cast("bigint").alias("n_lines"),
        F.array_join(F.transform("line_items", shown), ";").alias("line_items"),
    )


def validation_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = frame(spark, sf_dir, "queue").where(F.col("status") == "VALIDATING_RESULT")
    drafts = frame(spark, sf_dir, "invoices").where("rejection_reason IS NULL")
    return findings.validation_stage(waiting, drafts).select(
        "document_id", "verdict_status", "job_status", "error_category", "error_message"
    )


def missing_sql(source: str = "invoices", key: str = "invoice_id") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {key}, 'WARNING' AS severity, CAST({i} AS BIGINT) AS ord, '{n}' AS field, "
        f"'FIELD_MISSING' AS code, '{n}{fixed.MISSING_SUFFIX}' AS message "
        f"FROM {source} WHERE {n} IS NULL"
        for i, n in enumerate(fixed.HEADER_FIELDS)
    )


NO_LINES_SQL = f"""
SELECT invoice_id, 'WARNING' AS severity, CAST(11 AS BIGINT) AS ord, 'line_items' AS field,
  'NO_LINE_ITEMS' AS code, '{fixed.NO_LINES_MESSAGE}' AS message
FROM invoices i WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.invoice_id = i.invoice_id)"""

TOTAL_SQL = """
SELECT invoice_id, 'ERROR' AS severity, CAST(0 AS BIGINT) AS ord, 'total' AS field,
  'TOTAL_MISMATCH' AS code,
  'subtotal (' || subtotal || ') + tax (' || tax || ') = ' || (subtotal + tax)
    || ', which does not match total (' || total || ').' AS message
FROM invoices WHERE abs(subtotal + tax - total) > 0.01"""

NUMBERED_SQL = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line_order, line_id) - 1
    AS line_index FROM lines
)"""

LINES_SQL = """
SELECT invoice_id, 'ERROR' AS severity, line_index + 1 AS ord,
  'line_items[' || line_index || '].amount' AS field,
  'LINE_ITEM_AMOUNT_MISMATCH' AS code,
  'line_items[' || line_index || ']: quantity (' || quantity || ') × unit_price ('
    || unit_price || ') = ' || (quantity * unit_price)
    || ', which does not match amount (' || amount || ').' AS message
FROM numbered WHERE abs(quantity * unit_price - amount) > 0.01"""

VERDICT_SQL = f"""
counted AS (
  SELECT invoice_id, count(*) AS n_lines,
    count(*) FILTER (WHERE abs(quantity * unit_price - amount) > 0.01) AS n_bad
  FROM lines GROUP BY invoice_id
),
verdicts AS (
  SELECT i.invoice_id, i.document_id,
    CAST(coalesce(n_bad, 0) + CASE WHEN abs(subtotal + tax - total) > 0.01 THEN 1 ELSE 0 END
      AS BIGINT) AS n_errors,
    CAST({" + ".join(f"CASE WHEN {n} IS NULL THEN 1 ELSE 0 END" for n in fixed.HEADER_FIELDS)}
      + CASE WHEN n_lines IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_warnings
  FROM invoices i LEFT JOIN counted c ON c.invoice_id = i.invoice_id
)"""

QUERIES = {
    "findings_missing": findings_missing,
    "findings_no_lines": findings_no_lines,
    "findings_total": findings_total,
    "findings_lines": findings_lines,
    "findings_all": findings_all,
    "invoice_verdict": invoice_verdict,
    "nested_invoice": nested_invoice,
    "validation_stage": validation_stage,
}

ORACLES = {
    "findings_missing": f"WITH {ctes('invoices')} {missing_sql()}",
    "findings_no_lines": f"WITH {ctes('invoices', 'lines')} {NO_LINES_SQL}",
    "findings_total": f"WITH {ctes('invoices')} {TOTAL_SQL}",
    "findings_lines": f"WITH {ctes('lines')}, {NUMBERED_SQL} {LINES_SQL}",
    "findings_all": f"WITH {ctes('invoices', 'lines')}, {NUMBERED_SQL} "
                    + "\nUNION ALL\n".join([missing_sql(), NO_LINES_SQL, TOTAL_SQL, LINES_SQL]),
    "invoice_verdict": f"""WITH {ctes('invoices', 'lines')}, {VERDICT_SQL}
SELECT invoice_id, n_errors, n_warnings, n_errors = 0 AS is_valid,
  n_errors > 0 OR n_warnings > 0 AS requires_review FROM verdicts""",
    "nested_invoice": f"""WITH {ctes('invoices', 'lines')}, {NUMBERED_SQL},
listed AS (
  SELECT invoice_id, count(*) AS n_lines, string_agg(line_index || ':' || description || ':'
    || quantity || ':' || unit_price || ':' || coalesce(CAST(amount AS VARCHAR), '-'), ';'
    ORDER BY line_index) AS line_items
  FROM numbered GROUP BY invoice_id
)
SELECT i.invoice_id, 0 AS part_no, vendor_name, CAST(total AS VARCHAR) AS total,
  coalesce(n_lines, 0) AS n_lines,
  coalesce(line_items, '') AS line_items
FROM invoices i LEFT JOIN listed l ON l.invoice_id = i.invoice_id""",
    "validation_stage": f"""WITH {ctes('queue', 'invoices')},
drafts AS (SELECT * FROM invoices WHERE rejection_reason IS NULL),
j AS (SELECT q.document_id, d.document_id IS NULL AS missing
  FROM queue q LEFT JOIN drafts d ON d.document_id = q.document_id
  WHERE q.status = 'VALIDATING_RESULT')
SELECT document_id, CASE WHEN missing THEN 'FAILED' ELSE 'REVIEW_REQUIRED' END AS verdict_status,
  CASE WHEN missing THEN 'FAILED' ELSE 'SUCCESS' END AS job_status,
  CASE WHEN missing THEN 'PROCESSING_ERROR' END AS error_category,
  CASE WHEN missing THEN '{fixed.NO_DRAFT}' END AS error_message FROM j""",
}
