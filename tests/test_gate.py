from __future__ import annotations

import pytest
from builders import build

from docledger import fixed, schemas
from docledger.operators import gate

GOOD = {"upload_id": "1", "organization_id": "a", "user_id": "u", "filename": "invoice.pdf",
        "content_type": "application/pdf", "size_bytes": 100, "header": b"%PDF-1.4 rest"}


@pytest.mark.parametrize(("change", "reason"), [
    ({}, None),
    ({"content_type": "application/x-odd"}, None),
    ({"content_type": None}, None),
    ({"filename": "INVOICE.PDF"}, None),
    ({"filename": "a" * 251 + ".pdf"}, None),
    ({"filename": None}, fixed.NAME_REQUIRED),
    ({"filename": ""}, fixed.NAME_REQUIRED),
    ({"filename": " \t\x1c  "}, fixed.NAME_REQUIRED),
    ({"filename": "a" * 252 + ".pdf"}, fixed.NAME_TOO_LONG),
    ({"filename": "../x.pdf"}, fixed.NAME_UNSAFE),
    ({"filename": "..\\x.pdf"}, fixed.NAME_UNSAFE),
    ({"filename": "a/x.pdf"}, fixed.NAME_UNSAFE),
    ({"filename": "a\0.pdf"}, fixed.NAME_UNSAFE),
    ({"filename": "a..pdf"}, fixed.NAME_UNSAFE),
    ({"filename": "x.txt"}, fixed.TYPE_UNSUPPORTED),
    ({"size_bytes": 0}, fixed.FILE_EMPTY),
    ({"size_bytes": None}, fixed.FILE_EMPTY),
    ({"size_bytes": 1024}, None),
    ({"size_bytes": 1025}, fixed.FILE_OVERSIZED),
    ({"header": b"MZ"}, fixed.CONTENT_INVALID),
    ({"header": b""}, fixed.CONTENT_INVALID),
    ({"header": None}, fixed.CONTENT_INVALID),
    ({"filename": "x.txt", "size_bytes": 0}, fixed.TYPE_UNSUPPORTED),
    ({"size_bytes": 0, "header": b""}, fixed.FILE_EMPTY),
])
def test_first_failing_rule(spark, change, reason):
    uploads = build(spark, schemas.UPLOADS, [{**GOOD, **change}])
    assert gate.gate(uploads, max_bytes=1024).first()["reject_reason"] == reason


def test_accepted_uploads_become_documents(spark):
    uploads = build(spark, schemas.UPLOADS, [
        {**GOOD, "content_type": ""}, {**GOOD, "upload_id": "2", "size_bytes": 0},
    ])
    rows = gate.accepted_documents(gate.gate(uploads)).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row["content_type"] == "application/octet-stream"
    assert row["status"] == "UPLOADED"
    assert row["storage_key"].startswith("a/") and row["storage_key"].endswith(".pdf")
    again = gate.accepted_documents(gate.gate(uploads)).first()
    assert again["document_id"] == row["document_id"]


def test_error_classes(spark):
    uploads = build(spark, schemas.UPLOADS, [
        {**GOOD, "header": b"MZ"}, {**GOOD, "size_bytes": 0}, {**GOOD, "size_bytes": -1},
    ])
    rows = {r["reject_reason"]: (r["n_files"], r["error_class"])
            for r in gate.reject_counts(gate.gate(uploads)).collect()}
    assert rows == {fixed.CONTENT_INVALID: (1, "VALIDATION_ERROR"),
                    fixed.FILE_EMPTY: (2, "USER_ERROR")}
