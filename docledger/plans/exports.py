"""Queries over exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docledger import fixed
from docledger.operators import export
from docledger.plans.shown import shown, text_sql
from docledger.plans.standins import ctes, frame


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = export.approved_invoices(
        frame(spark, sf_dir, "documents"), frame(spark, sf_dir, "invoices")
    )
    return export.flatten(approved, frame(spark, sf_dir, "lines"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.cells(_flat(spark, sf_dir))


def approved_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = export.approved_list(
        frame(spark, sf_dir, "documents"), frame(spark, sf_dir, "invoices")
    )
    return shown(listed.select(
        "organization_id", "invoice_id", "vendor_name", "total", "approved_at"
    ))


def export_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    return shown(flat.select("organization_id", *fixed.EXPORT_COLUMNS))


def export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select(*fixed.EXPORT_COLUMNS)


def export_all_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenant's export in one job, laid out for the per-tenant write."""
    laid_out = export.for_writing(_cells(spark, sf_dir))
    return laid_out.select("organization_id", *fixed.EXPORT_COLUMNS)


def export_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = frame(spark, sf_dir, "commands").select(
        "command_id", "document_id", "organization_id"
    )
    return export.requested(
        requests, frame(spark, sf_dir, "documents"), frame(spark, sf_dir, "drafts")
    )


def export_requested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = frame(spark, sf_dir, "commands").select(
        "command_id", "document_id", "organization_id")
    rows = export.requested_rows(
        requests, frame(spark, sf_dir, "documents"), frame(spark, sf_dir, "drafts"),
        frame(spark, sf_dir, "lines"))
    return rows.select("command_id", "file_name", *fixed.EXPORT_COLUMNS)


def export_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = export.csv_rows(_cells(spark, sf_dir), frame(spark, sf_dir, "organizations"))
    return lines.select("organization_id", "is_body", "value")


def _cell(name: str) -> str:
    """One export cell as text in DuckDB."""
    if name == "approved_at":
        text = ("CASE WHEN approved_at = date_trunc('second', approved_at) "
                "THEN strftime(approved_at, '%Y-%m-%dT%H:%M:%S') "
                "ELSE strftime(approved_at, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'")
    else:
        text = f"CAST({name} AS VARCHAR)"
    return f"coalesce({text}, '')"


def _quoted(name: str) -> str:
    return (f"CASE WHEN regexp_matches({name}, '[,\"\\r\\n]') "
            f"THEN '\"' || replace({name}, '\"', '\"\"') || '\"' ELSE {name} END")


FLAT_SQL = f"""{ctes('documents', 'invoices', 'lines')},
flat AS (
  SELECT d.organization_id, i.*, l.description AS line_item_description,
    l.quantity AS line_item_quantity, l.unit_price AS line_item_unit_price,
    l.amount AS line_item_amount
  FROM docs d JOIN invoices i ON i.document_id = d.document_id
  LEFT JOIN lines l ON l.invoice_id = i.invoice_id
  WHERE d.status = 'APPROVED'
),
cells AS (
  SELECT organization_id, {", ".join(f"{_cell(n)} AS {n}" for n in fixed.EXPORT_COLUMNS)}
  FROM flat
)"""

_TEXTS = ("invoice_date", "due_date", "subtotal", "tax", "total", "approved_at",
          "line_item_quantity", "line_item_unit_price", "line_item_amount")

QUERIES = {
    "approved_list": approved_list,
    "export_flatten": export_flatten,
    "export_cells": export_cells,
    "export_all_tenants": export_all_tenants,
    "export_requested": export_requested,
    "export_requested_rows": export_requested_rows,
    "export_csv_lines": export_csv_lines,
}

ORACLES = {
    "approved_list": f"""WITH {ctes('documents', 'invoices')}
SELECT organization_id, invoice_id, vendor_name, {text_sql('total', 'approved_at')}
FROM invoices i JOIN docs d ON d.document_id = i.document_id WHERE d.status = 'APPROVED'""",
    "export_flatten": f"""WITH {FLAT_SQL}
SELECT organization_id, {text_sql(*_TEXTS)},
  {", ".join(n for n in fixed.EXPORT_COLUMNS if n not in _TEXTS)} FROM flat""",
    "export_cells": f"WITH {FLAT_SQL} SELECT {', '.join(fixed.EXPORT_COLUMNS)} FROM cells",
    "export_all_tenants": f"WITH {FLAT_SQL} SELECT * FROM cells",
    "export_requested": f"""WITH {ctes('commands', 'documents', 'drafts')},
judged AS (
  SELECT command_id, c.document_id, c.organization_id, i.invoice_id,
    CASE WHEN d.document_id IS NULL THEN 'NOT_FOUND'
      WHEN d.status <> 'APPROVED' OR i.invoice_id IS NULL THEN 'NOT_APPROVED' ELSE 'OK' END
      AS outcome
  FROM commands c LEFT JOIN docs d
    ON d.document_id = c.document_id AND d.organization_id = c.organization_id
  LEFT JOIN drafts i ON i.document_id = d.document_id
)
SELECT command_id, document_id, organization_id, outcome,
  CASE WHEN outcome = 'OK' THEN invoice_id END AS invoice_id,
  CASE WHEN outcome = 'OK' THEN 'invoice-' || invoice_id || '.csv' END AS file_name FROM judged""",
    "export_requested_rows": f"""WITH {ctes('commands')},
{FLAT_SQL.replace(ctes('documents', 'invoices', 'lines'), ctes('documents', 'drafts', 'lines'))
         .replace("JOIN invoices i", "JOIN drafts i")}
SELECT command_id, 'invoice-' || x.invoice_id || '.csv' AS file_name,
  {", ".join(f"x.{n}" for n in fixed.EXPORT_COLUMNS)}
FROM commands c JOIN cells x ON x.document_id = CAST(c.document_id AS VARCHAR)
  AND x.organization_id = c.organization_id""",
    "export_csv_lines": f"""WITH {FLAT_SQL}
SELECT organization_id, 1 AS is_body,
  {" || ',' || ".join(_quoted(n) for n in fixed.EXPORT_COLUMNS)} AS value FROM cells
UNION ALL
SELECT n_nationkey, 0, '{",".join(fixed.EXPORT_COLUMNS)}' FROM nation""",
}
