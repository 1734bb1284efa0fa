"""Spark schemas of the tables and of the frames that cross stage borders.

Written as DDL strings, which `spark.read.schema`, `createDataFrame` and
`mapInPandas` all accept.
"""

from __future__ import annotations

_STAMPS = "created_at timestamp, updated_at timestamp"

ORGANIZATIONS = f"organization_id string, name string, {_STAMPS}"

USERS = (
    "user_id string, organization_id string, email string, is_active boolean, "
    f"{_STAMPS}"
)

DOCUMENTS = (
    "document_id string, organization_id string, uploaded_by_user_id string, "
    "original_filename string, storage_key string, content_type string, "
    "file_size_bytes bigint, status string, extracted_text_storage_key string, "
    f"{_STAMPS}"
)

INVOICES = (
    "invoice_id string, document_id string, vendor_name string, vendor_address string, "
    "customer_name string, invoice_number string, invoice_date date, due_date date, "
    "currency string, subtotal decimal(14,2), tax decimal(14,2), total decimal(14,2), "
    "payment_terms string, approved_at timestamp, approved_by_user_id string, "
    "rejected_at timestamp, rejected_by_user_id string, rejection_reason string, "
    f"{_STAMPS}"
)

LINES = (
    "line_id string, invoice_id string, line_order int, description string, "
    "quantity decimal(14,4), unit_price decimal(14,2), amount decimal(14,2), "
    f"{_STAMPS}"
)

JOBS = (
    "job_id string, document_id string, stage string, status string, "
    "started_at timestamp, completed_at timestamp, duration_ms int, "
    "error_category string, error_message string, cost_usd decimal(10,6), "
    f"provider_name string, {_STAMPS}"
)

UPLOADS = (
    "upload_id string, organization_id string, user_id string, filename string, "
    "content_type string, size_bytes bigint, header binary"
)

PAGES = "document_id string, page_no int, text string, page_error boolean"

PAGE_IMAGES = "document_id string, page_no int, image binary, page_error boolean"

COMMANDS = (
    "command_id string, document_id string, organization_id string, user_id string, "
    "kind string, issued_at timestamp, patch string, reason string"
)

TABLES = {
    "organizations": ORGANIZATIONS,
    "users": USERS,
    "documents": DOCUMENTS,
    "invoices": INVOICES,
    "invoice_line_items": LINES,
    "processing_jobs": JOBS,
}
