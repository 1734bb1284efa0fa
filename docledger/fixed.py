"""Values fixed by the data contract.

Everything in this file must keep exactly this spelling, because stored rows,
exported files and messages shown to reviewers depend on it.
"""

from __future__ import annotations

# enumerations
DOCUMENT_STATUSES = (
    "UPLOADED", "VALIDATING", "STORED", "EXTRACTING_TEXT", "TEXT_EXTRACTED",
    "OCR_REQUIRED", "OCR_PROCESSING", "AI_PROCESSING", "VALIDATING_RESULT",
    "REVIEW_REQUIRED", "APPROVED", "REJECTED", "FAILED",
)
STAGES = ("VALIDATION", "TEXT_EXTRACTION", "OCR", "AI_EXTRACTION", "RESULT_VALIDATION")
JOB_STATUSES = ("PENDING", "RUNNING", "SUCCESS", "FAILED")
ERROR_CATEGORIES = (
    "USER_ERROR", "VALIDATION_ERROR", "PROCESSING_ERROR", "OCR_ERROR",
    "AI_PROVIDER_ERROR", "DATABASE_ERROR", "UNEXPECTED_ERROR",
)

# Invoice header fields, in the order findings list them
HEADER_FIELDS = (
    "vendor_name", "vendor_address", "customer_name", "invoice_number",
    "invoice_date", "due_date", "currency", "subtotal", "tax", "total",
    "payment_terms",
)
TEXT_FIELDS = (
    "vendor_name", "vendor_address", "customer_name", "invoice_number",
    "currency", "payment_terms",
)
DATE_FIELDS = ("invoice_date", "due_date")
MONEY_FIELDS = ("subtotal", "tax", "total")
LINE_NUMBER_FIELDS = ("quantity", "unit_price", "amount")

# Column limits
TEXT_LIMITS = {
    "vendor_name": 255, "vendor_address": 1024, "customer_name": 255,
    "invoice_number": 128, "currency": 8, "payment_terms": 255,
}
LINE_DESCRIPTION_LIMIT = 1024
MONEY_TYPE = "decimal(14,2)"
QUANTITY_TYPE = "decimal(14,4)"
LINE_TYPES = {"quantity": QUANTITY_TYPE, "unit_price": MONEY_TYPE, "amount": MONEY_TYPE}
TOLERANCE = "0.01"

# Upload gate
PDF_MAGIC = b"%PDF-"
MAX_FILENAME_LENGTH = 255
MAX_UPLOAD_BYTES = 15 * 1024 * 1024
UPLOAD_EXTENSIONS = (".pdf",)
DEFAULT_CONTENT_TYPE = "application/octet-stream"
NAME_REQUIRED = "Filename is required."
NAME_TOO_LONG = "Filename is too long."
NAME_UNSAFE = "Filename contains unsafe characters."
TYPE_UNSUPPORTED = "Unsupported file type. Only PDF is currently supported."
FILE_EMPTY = "Uploaded file is empty."
FILE_OVERSIZED = "File exceeds the maximum allowed size."
CONTENT_INVALID = "File content does not match a valid PDF."
REASON_CLASSES = {
    NAME_REQUIRED: "USER_ERROR",
    NAME_TOO_LONG: "USER_ERROR",
    NAME_UNSAFE: "USER_ERROR",
    TYPE_UNSUPPORTED: "USER_ERROR",
    FILE_EMPTY: "USER_ERROR",
    FILE_OVERSIZED: "USER_ERROR",
    CONTENT_INVALID: "VALIDATION_ERROR",
}

# Text stage
PAGE_SEPARATOR = "\n\n"
MIN_TEXT_CHARS = 20
TEXT_ARTIFACT_NAME = "extracted_text.txt"
# The 29 characters Python's str.split() treats as white space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
READ_FAILED = "Stored file could not be read."
OPEN_FAILED = "The stored file could not be read as a PDF."
RENDER_FAILED = "The stored file could not be rendered for OCR."
ENGINE_FAILED = "OCR processing failed."
NO_USABLE_TEXT = "OCR completed but no usable text was found."

# Field extraction
PROMPT_PREFIX = "Extract the structured invoice data from the following document text:\n\n"
TOOL_NAME = "record_extracted_invoice"
PROVIDER_NAME = "anthropic"
NO_TEXT = "No extracted text is available for this document."
TEXT_UNREADABLE = "Stored extracted text could not be read."
PROVIDER_ERRORS = {
    "timeout": "AI extraction timed out.",
    "auth": "AI provider is not configured correctly.",
    "response": "AI provider returned an unusable response.",
    "other": "AI extraction failed.",
}
SCHEMA_MISMATCH = "AI provider returned data that did not match the expected schema."
SAVE_FAILED = "Failed to save extraction result."
NO_DRAFT = "No extracted invoice data is available to validate."

# findings
MISSING_SUFFIX = " was not found in the extracted document."
NO_LINES_MESSAGE = "No line items were extracted from the document."

# review
MAX_REASON_LENGTH = 2000

# export
EXPORT_COLUMNS = (
    "invoice_id", "document_id", "vendor_name", "vendor_address", "customer_name",
    "invoice_number", "invoice_date", "due_date", "currency", "subtotal", "tax",
    "total", "payment_terms", "approved_at", "approved_by_user_id",
    "line_item_description", "line_item_quantity", "line_item_unit_price",
    "line_item_amount",
)
