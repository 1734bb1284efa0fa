"""Export of approved invoices: selection, flattening, cells, CSV lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import fixed
from docledger.functions.cells import cell_text, csv_line
from docledger.operators.findings import without_lines

LINE_COLUMNS = {
    "description": "line_item_description",
    "quantity": "line_item_quantity",
    "unit_price": "line_item_unit_price",
    "amount": "line_item_amount",
}


def export_order() -> list[Column]:
    """Order inside a tenant's file; invoices without approval time come last."""
    return [
        F.col("_approved_at").asc_nulls_last(), F.col("_invoice_id").asc(),
        F.col("_line_order").asc(), F.col("_line_id").asc(),
    ]


def approved_invoices(documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoices of APPROVED documents with their tenant.

    Eligibility is the document status alone; `approved_at` may be empty.
    """
    approved = documents.where(F.col("status") == "APPROVED").select(
        "document_id", "organization_id"
    )
    return invoices.join(approved, "document_id")


def approved_list(documents: DataFrame, invoices: DataFrame) -> DataFrame:
    return approved_invoices(documents, invoices).orderBy(
        F.col("organization_id"), F.col("approved_at").asc_nulls_last(), F.col("invoice_id")
    )


def flatten(approved: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per line, or one row with blank line cells.

    Lines join inner, with the lines as the side that skew handling can split;
    invoices without lines are added separately. A single outer join would tie
    all lines of one invoice to one task.
    """
    details = lines.select(
        "invoice_id", "line_order", "line_id",
        *[F.col(a).alias(b) for a, b in LINE_COLUMNS.items()],
    )
    filled = details.join(approved, "invoice_id")
    schema = details.schema
    bare = without_lines(approved, lines).withColumns({
        n: F.lit(None).cast(schema[n].dataType)
        for n in ("line_order", "line_id", *LINE_COLUMNS.values())
    })
    return filled.unionByName(bare).select(
        "organization_id",
        F.col("approved_at").alias("_approved_at"),
        F.col("invoice_id").alias("_invoice_id"),
        F.col("line_order").alias("_line_order"),
        F.col("line_id").alias("_line_id"),
        *fixed.EXPORT_COLUMNS,
    )


def cells(flat: DataFrame) -> DataFrame:
    """The 19 columns as text, keeping the tenant and the sort keys."""
    keys = [c for c in flat.columns if c not in fixed.EXPORT_COLUMNS]
    return flat.select(*keys, *[cell_text(flat, n).alias(n) for n in fixed.EXPORT_COLUMNS])


def for_writing(rows: DataFrame) -> DataFrame:
    """Lay rows out for a per-tenant write.

    Ranges over (tenant, order) give sorted files whose names follow the order,
    and split a tenant of any size over many tasks.
    """
    keys = [F.col("organization_id"), *export_order()]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def csv_rows(cell_rows: DataFrame, tenants: DataFrame) -> DataFrame:
    """CSV lines per tenant with one header line for every requested tenant."""
    body = cell_rows.join(tenants.select("organization_id"), "organization_id", "left_semi")
    body = body.select(
        "organization_id", F.lit(1).alias("is_body"),
        *[c for c in cell_rows.columns if c.startswith("_")],
        csv_line(fixed.EXPORT_COLUMNS).alias("value"),
    )
    header = tenants.select("organization_id").distinct().select(
        "organization_id", F.lit(0).alias("is_body"),
        *[F.lit(None).cast(body.schema[c].dataType).alias(c)
          for c in body.columns if c.startswith("_")],
        F.lit(",".join(fixed.EXPORT_COLUMNS)).alias("value"),
    )
    return body.unionByName(header)


def requested_rows(
    requests: DataFrame, documents: DataFrame, invoices: DataFrame, lines: DataFrame,
) -> DataFrame:
    """The cells of every granted single-invoice export: command_id, file_name, the
    sort keys and the 19 columns. Refused requests have none."""
    granted = requested(requests, documents, invoices).where(F.col("outcome") == "OK").select(
        "command_id", "file_name", F.col("invoice_id").alias("_invoice_id"))
    asked = granted.select(F.col("_invoice_id").alias("invoice_id")).distinct()
    own = approved_invoices(documents, invoices).join(asked, "invoice_id", "left_semi")
    flat = flatten(own, lines.join(asked, "invoice_id", "left_semi"))
    return cells(flat).join(granted, "_invoice_id")


def requested(requests: DataFrame, documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """Gate for single-invoice exports: tenant, then status, then a draft."""
    known = documents.select(
        "document_id", F.col("organization_id").alias("_owner"), F.col("status").alias("_status")
    )
    drafts = invoices.select("document_id", "invoice_id")
    found = F.coalesce(F.col("_owner") == F.col("organization_id"), F.lit(False))
    ready = (F.col("_status") == "APPROVED") & F.col("invoice_id").isNotNull()
    outcome = F.when(~found, "NOT_FOUND").when(~ready, "NOT_APPROVED").otherwise("OK")
    return (
        requests.join(known.join(drafts, "document_id", "left"), "document_id", "left")
        .withColumn("outcome", outcome)
        .withColumn("file_name", F.when(
            F.col("outcome") == "OK",
            F.concat(F.lit("invoice-"), F.col("invoice_id").cast("string"), F.lit(".csv")),
        ))
        .withColumn("invoice_id", F.when(F.col("outcome") == "OK", F.col("invoice_id")))
        .drop("_owner", "_status")
    )
