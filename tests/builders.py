"""Small frames in the shape of the library's tables."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from docledger import schemas

T0 = datetime(2024, 1, 1, 12, 0, 0)


def _columns(ddl: str) -> list[str]:
    depth, names, part = 0, [], ""
    for char in ddl + ",":
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            names.append(part.split()[0])
            part = ""
        else:
            part += char
    return names


def build(spark, ddl: str, rows: list[dict]):
    names = _columns(ddl)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def invoice(key: str = "i1", **values) -> dict:
    row = {
        "invoice_id": key, "document_id": values.pop("document_id", key.replace("i", "d")),
        "vendor_name": "Acme", "vendor_address": "1 Road", "customer_name": "Bob",
        "invoice_number": "INV-1", "invoice_date": date(2024, 1, 1),
        "due_date": date(2024, 2, 1), "currency": "USD", "subtotal": Decimal("100.00"),
        "tax": Decimal("15.00"), "total": Decimal("115.00"), "payment_terms": "Net 30",
    }
    return {**row, **values}


def line(key: str, invoice_id: str = "i1", order: int = 0, quantity="5", price="20.00",
         amount="100.00", **values) -> dict:
    def number(text):
        return None if text is None else Decimal(text)

    return {
        "line_id": key, "invoice_id": invoice_id, "line_order": order, "description": "Item",
        "quantity": number(quantity), "unit_price": number(price), "amount": number(amount),
        **values,
    }


def document(key: str = "d1", tenant: str = "a", status: str = "REVIEW_REQUIRED", **values):
    return {"document_id": key, "organization_id": tenant, "status": status, **values}


def invoices(spark, *rows):
    return build(spark, schemas.INVOICES, list(rows))


def lines(spark, *rows):
    return build(spark, schemas.LINES, list(rows))


def documents(spark, *rows):
    return build(spark, schemas.DOCUMENTS, list(rows))


def commands(spark, *rows):
    return build(spark, schemas.COMMANDS, [
        {"organization_id": "a", "user_id": "u", "document_id": "d1", **r} for r in rows
    ])
