from __future__ import annotations

import csv
import io
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from builders import T0, document, documents, invoice, invoices, line, lines

from docledger import fixed
from docledger.operators import export
from docledger.sources.sinks import write_cell_export, write_csv_export, write_text_artifacts

VENDOR = 'Vendor, "Quoted" Inc.\nSecond line'


def sample(spark):
    docs = documents(
        spark, document("d1", "a", "APPROVED"), document("d2", "a", "APPROVED"),
        document("d3", "a", "REVIEW_REQUIRED"), document("d4", "b", "APPROVED"),
        document("d5", "a", "APPROVED"))
    heads = invoices(
        spark, invoice("i1", approved_at=T0, vendor_name=VENDOR),
        invoice("i2", approved_at=T0 - timedelta(days=1), subtotal=Decimal("100.10"),
                due_date=None), invoice("i3", approved_at=T0), invoice("i4", approved_at=None),
        invoice("i5", approved_at=None))
    items = lines(spark, line("l2", "i1", 1, description="second"),
                  line("l1", "i1", 0, description="first"), line("l3", "i3"))
    return docs, heads, items


def exported(spark):
    docs, heads, items = sample(spark)
    return export.cells(export.flatten(export.approved_invoices(docs, heads), items))


def test_one_row_per_line_and_one_for_none(spark):
    rows = sorted((r["invoice_id"], r["line_item_description"]) for r in exported(spark).collect())
    assert rows == [("i1", "first"), ("i1", "second"), ("i2", ""), ("i4", ""), ("i5", "")]


def test_cells_are_exact_text(spark):
    rows = {r["invoice_id"]: r for r in exported(spark).collect()}
    assert rows["i2"]["subtotal"] == "100.10" and rows["i2"]["due_date"] == ""
    assert rows["i2"]["approved_at"] == "2023-12-31T12:00:00+00:00"
    assert rows["i1"]["line_item_quantity"] == "5.0000"
    assert rows["i4"]["approved_at"] == ""


def test_fraction_is_shown_only_when_present(spark):
    from docledger.functions.cells import iso_timestamp
    from pyspark.sql import functions as F

    times = [datetime(2024, 1, 1, 1, 2, 3), datetime(2024, 1, 1, 1, 2, 3, 450)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp")
    assert [r[0] for r in df.select(iso_timestamp(F.col("t"))).collect()] == [
        "2024-01-01T01:02:03+00:00", "2024-01-01T01:02:03.000450+00:00"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_are_utc_in_any_session(spark, zone):
    from docledger.functions.cells import iso_timestamp
    from pyspark.sql import functions as F

    df = spark.sql(
        "SELECT explode(array(TIMESTAMP'2024-03-10T07:30:00Z', TIMESTAMP'2024-11-03T05:30:00.5Z',"
        " TIMESTAMP'1969-12-31T23:59:59.25Z')) AS t")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert [r[0] for r in df.select(iso_timestamp(F.col("t"))).collect()] == [
            "2024-03-10T07:30:00+00:00", "2024-11-03T05:30:00.500000+00:00",
            "1969-12-31T23:59:59.250000+00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rows_of_a_single_export(spark):
    docs, heads, items = sample(spark)
    known = heads.join(docs, "document_id").where("status = 'APPROVED'").first()
    asked = spark.createDataFrame(
        [("c1", known["document_id"], known["organization_id"]), ("c2", known["document_id"], "zz")],
        "command_id string, document_id string, organization_id string")
    rows = export.requested_rows(asked, docs, heads, items).collect()
    mine = items.where(f"invoice_id = '{known['invoice_id']}'").count()
    assert len(rows) == max(mine, 1)
    assert {(r["command_id"], r["invoice_id"]) for r in rows} == {("c1", known["invoice_id"])}


def test_list_puts_missing_approval_times_last(spark):
    docs, heads, _ = sample(spark)
    rows = export.approved_list(docs, heads).where("organization_id = 'a'").collect()
    assert [r["invoice_id"] for r in rows] == ["i2", "i1", "i5"]


def _read(folder: Path) -> list[list[str]]:
    data = "".join(p.read_bytes().decode() for p in sorted(folder.glob("part-*")))
    assert data.endswith("\r\n")
    return list(csv.reader(io.StringIO(data, newline="")))


def test_csv_files_per_tenant(spark, tmp_path):
    tenants = spark.createDataFrame([("a",), ("b",), ("empty",)], "organization_id string")
    path = str(tmp_path / "csv")
    write_csv_export(export.csv_rows(exported(spark), tenants), path)
    a = _read(Path(path) / "organization_id=a")
    assert a[0] == list(fixed.EXPORT_COLUMNS)
    assert [(r[0], r[15]) for r in a[1:]] == [
        ("i2", ""), ("i1", "first"), ("i1", "second"), ("i5", "")]
    assert a[2][2] == VENDOR
    assert _read(Path(path) / "organization_id=empty") == [list(fixed.EXPORT_COLUMNS)]
    assert len(_read(Path(path) / "organization_id=b")) == 2


def test_csv_bytes_equal_pythons_writer(spark):
    tenants = spark.createDataFrame([("a",), ("b",)], "organization_id string")
    cells = exported(spark)
    got = sorted(r["value"] for r in export.csv_rows(cells, tenants).where("is_body = 1").collect())
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\0")
    for row in cells.collect():
        writer.writerow([row[c] for c in fixed.EXPORT_COLUMNS])
    assert got == sorted(buffer.getvalue().split("\0")[:-1])


def test_cell_table_and_text_artifacts(spark, tmp_path):
    path = str(tmp_path / "cells")
    write_cell_export(exported(spark), path)
    back = spark.read.parquet(path).where("organization_id = 'a'")
    assert back.count() == 4 and set(back.columns) == {"organization_id", *fixed.EXPORT_COLUMNS}
    parts = spark.createDataFrame([("a", "d1", 0, "k", "text"), ("b", "d2", 0, "k", "text")],
                                  "organization_id string, document_id string, part_no int, "
                                  "storage_key string, part_text string")
    write_text_artifacts(parts, str(tmp_path / "texts"))
    assert spark.read.parquet(str(tmp_path / "texts")).count() == 2


def test_single_export_gate(spark):
    docs, heads, _ = sample(spark)
    requests = spark.createDataFrame(
        [("r1", "d1", "a"), ("r2", "d1", "b"), ("r3", "d3", "a"), ("r4", "nope", "a")],
        "request string, document_id string, organization_id string")
    rows = {r["request"]: (r["outcome"], r["file_name"])
            for r in export.requested(requests, docs, heads).collect()}
    assert rows == {"r1": ("OK", "invoice-i1.csv"), "r2": ("NOT_FOUND", None),
                    "r3": ("NOT_APPROVED", None), "r4": ("NOT_FOUND", None)}
