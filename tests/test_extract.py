from __future__ import annotations

import json
import sys
from datetime import date
from decimal import Decimal

import pytest
from builders import document, documents, invoice, invoices
from pyspark import cloudpickle

from docledger import fixed
from docledger.operators import extract
from docledger.operators.hooks import ExtractorError, run_extractor

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def parse(spark, payloads, **options):
    rows = [(i, p if isinstance(p, str) or p is None else json.dumps(p))
            for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "document_id int, raw string")
    parsed = extract.parse_payload(df, "raw", **options).orderBy("document_id")
    return parsed.collect()


NUMBERS = ["1__0", "_1", "1_", " 12 ", "1e3", ".5", "5.", "+5", "-0", "--5", "1e400", "1 0",
           "0x10", "", " ", 1.005, 1e300, True, 10**40, "1e-7", "Infinity", "NaN", "1.2.3", "1e",
           "\t5\n", "1,234.5", [1], {"a": 1}, None, 0, -3, 2.5]
DATES = ["2026-08-20", "2026-08-20T00:00:00", "2026-08-20 00:00", "2026-08-20T00:00:00Z",
         "2026-08-20T00:00:00+02:00", "2026-08-20T00:00:00.000", "2026-08-20t00:00",
         "2026-08-20_00:00", "2026-08-20T01:00", "2026-08-20T00", "2026-8-2", " 2026-08-20",
         "2026-02-30", "0000-01-01", "0001-01-01", "9999-12-31", 86400, 86401, "86400", "86401",
         86400.0, 86400.5, "86400.0", -86400, "-86400", 0, "0", 20000000000, 20000044800,
         1700000000000, 1700006400000, "+86400", True, "20260820", "20260820T000000", "1e5",
         "86400 ", "2026/08/20", "2026-08-20T00:00Z", "", "2026-08-20 junk", [1], None,
         "2026-08-20T24:00", -20000044800000, 19999958400]
TEXTS = ["x", "", 1, 1.5, True, [], {}, None]


def _accepted(kind, value):
    """Acceptance by an independent validator with the same declared rules."""
    pydantic = pytest.importorskip("pydantic")
    fields = {"n": (Decimal | None, None), "d": (date | None, None), "s": (str | None, None)}
    model = pydantic.create_model("Model", **fields)
    try:
        return True, getattr(model.model_validate({kind: value}), kind)
    except pydantic.ValidationError:
        return False, None


@pytest.mark.parametrize(("field", "kind", "values"), [
    ("subtotal", "n", NUMBERS), ("due_date", "d", DATES), ("vendor_name", "s", TEXTS),
])
def test_fields_are_read_strictly(spark, field, kind, values):
    rows = parse(spark, [{field: v} for v in values])
    for value, row in zip(values, rows, strict=True):
        good, expected = _accepted(kind, value)
        assert row["schema_bad"] is (not good), value
        if not good:
            continue
        if kind == "n" and expected is not None:
            if abs(expected) >= Decimal(10) ** 12:
                assert row["limits_bad"], value
                continue
            expected = expected.quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
        assert row[field] == expected, value
        assert row["limits_bad"] is False, value


@pytest.mark.parametrize(("payload", "bad"), [
    ({}, False), ([], True), ("oops", True), (None, True), ("3", True), ("null", True),
    ({"line_items": None}, True), ({"line_items": []}, False), ({"line_items": [3]}, True),
    ({"line_items": [None]}, True), ({"line_items": [{}]}, False), ({"line_items": {}}, True),
    ({"line_items": "seven lines"}, True),
    ({"line_items": [{"quantity": "x"}]}, True), ({"line_items": [{"quantity": None}]}, False),
    ({"line_items": [{"description": 1}]}, True), ({"unknown": [1]}, False),
    ({"vendor_name": 70}, True),
])
def test_document_shape(spark, payload, bad):
    assert parse(spark, [payload])[0]["schema_bad"] is bad


def test_null_list_is_fine_in_an_edit(spark):
    assert parse(spark, [{"line_items": None}], null_lines_ok=True)[0]["schema_bad"] is False


@pytest.mark.parametrize(("payload", "bad"), [
    ({"vendor_name": "x" * 255}, False), ({"vendor_name": "x" * 256}, True),
    ({"currency": "x" * 9}, True), ({"vendor_name": "a\0b"}, True),
    ({"total": "999999999999.99"}, False), ({"total": "999999999999.995"}, True),
    ({"line_items": [{"description": "x" * 1025}]}, True),
    ({"line_items": [{"quantity": "12345678901"}]}, True),
    ({"line_items": [{"quantity": "1234567890.12345"}]}, False),
])
def test_column_limits(spark, payload, bad):
    row = parse(spark, [payload])[0]
    assert (row["schema_bad"], row["limits_bad"]) == (False, bad)


def test_values_are_rounded_half_away_from_zero(spark):
    row = parse(spark, [{"total": 1.005, "tax": "-1.005",
                         "line_items": [{"quantity": 0.00005, "amount": "2.675"}]}])[0]
    assert (row["total"], row["tax"]) == (Decimal("1.01"), Decimal("-1.01"))
    assert row["line_items"][0]["quantity"] == Decimal("0.0001")
    assert row["line_items"][0]["amount"] == Decimal("2.68")


def test_candidates_and_resume(spark):
    docs = documents(spark, document("d1", status="TEXT_EXTRACTED"),
                     document("d2", status="TEXT_EXTRACTED"),
                     document("d3", status="VALIDATING_RESULT"),
                     document("d4", status="VALIDATING_RESULT"))
    held = invoices(spark, invoice("i1"), invoice("i3"))
    assert [r["document_id"] for r in extract.candidates(docs, held).collect()] == ["d2"]
    assert [r["document_id"] for r in extract.resumable(docs, held).collect()] == ["d3"]


def test_blank_text_never_reaches_the_extractor(spark):
    texts = spark.createDataFrame(
        [("a", "k", "text"), ("b", None, "text"), ("c", "k", None), ("d", "k", " 　\x1f")],
        "document_id string, extracted_text_storage_key string, text string")
    assert [r["document_id"] for r in extract.requests(texts).collect()] == ["a"]
    messages = {r["document_id"]: r["error_message"]
                for r in extract.with_text_failure(texts).collect()}
    assert messages == {"a": None, "b": fixed.NO_TEXT, "c": fixed.TEXT_UNREADABLE,
                        "d": fixed.NO_TEXT}


class Fussy:
    def extract(self, text):
        if text in ("timeout", "auth", "response"):
            raise ExtractorError(text)
        if text == "crash":
            raise RuntimeError("secret detail")
        return {"vendor_name": text} if text != "wrong" else {"vendor_name": 1}


def test_extractor_outcomes(spark):
    texts = ["timeout", "auth", "response", "crash", "wrong", "x" * 300, "fine"]
    df = spark.createDataFrame([(t[:8], t) for t in texts],
                               "document_id string, request_text string")
    parsed = extract.parse_payload(run_extractor(df, Fussy), "raw_json")
    rows = {r["document_id"]: (r["error_category"], r["error_message"])
            for r in extract.with_extraction_outcome(parsed).collect()}
    assert rows == {
        "timeout": ("AI_PROVIDER_ERROR", "AI extraction timed out."),
        "auth": ("AI_PROVIDER_ERROR", "AI provider is not configured correctly."),
        "response": ("AI_PROVIDER_ERROR", "AI provider returned an unusable response."),
        "crash": ("AI_PROVIDER_ERROR", "AI extraction failed."),
        "wrong": ("AI_PROVIDER_ERROR", fixed.SCHEMA_MISMATCH),
        "x" * 8: ("DATABASE_ERROR", fixed.SAVE_FAILED),
        "fine": (None, None),
    }


def test_drafts_number_lines_in_array_order(spark):
    df = spark.createDataFrame([("d1", json.dumps({"line_items": [
        {"description": "b"}, {"description": "a"}]}))], "document_id string, raw string")
    parsed = extract.parse_payload(df, "raw")
    rows = sorted((r["line_order"], r["description"])
                  for r in extract.draft_lines(parsed).collect())
    assert rows == [(0, "b"), (1, "a")]
    head = extract.draft_headers(parsed).first()
    assert head["approved_at"] is None and head["document_id"] == "d1"


def test_filters_after_the_parse_do_not_repeat_it(spark):
    df = spark.createDataFrame([("d1", "{}")], "document_id string, raw string")
    good = extract.parse_payload(df, "raw").where("NOT schema_bad AND NOT limits_bad")
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_final_status_of_a_rerun(spark):
    texts = spark.createDataFrame(
        [("d1", "TEXT_EXTRACTED"), ("d2", "TEXT_EXTRACTED"), ("d3", "TEXT_EXTRACTED"),
         ("d4", "FAILED"), ("d5", "OCR_REQUIRED"), ("d6", "TEXT_EXTRACTED")],
        "document_id string, verdict_status string")
    answers = spark.createDataFrame([("d2", None), ("d3", "failed")],
                                    "document_id string, error_message string")
    rows = extract.final_status(texts, invoices(spark, invoice("i1")), answers).collect()
    assert dict(map(tuple, rows)) == {
        "d1": "TEXT_EXTRACTED", "d2": "REVIEW_REQUIRED", "d3": "FAILED", "d4": "FAILED",
        "d5": "OCR_REQUIRED", "d6": "TEXT_EXTRACTED"}
