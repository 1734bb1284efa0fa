from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from builders import invoice, invoices, line, lines

from docledger import fixed
from docledger.operators import findings


def found(spark, header, *items):
    rows = findings.all_findings(invoices(spark, header), lines(spark, *items)).collect()
    return sorted((r["severity"], r["ord"], r["field"], r["code"]) for r in rows)


def verdict(spark, header, *items):
    return findings.verdicts(invoices(spark, header), lines(spark, *items)).first()


def test_complete_invoice_has_no_findings(spark):
    assert found(spark, invoice(), line("l1")) == []
    row = verdict(spark, invoice(), line("l1"))
    assert (row["is_valid"], row["requires_review"]) == (True, False)


def test_one_missing_field_is_a_warning(spark):
    assert found(spark, invoice(due_date=None), line("l1")) == [
        ("WARNING", 5, "due_date", "FIELD_MISSING")
    ]
    row = verdict(spark, invoice(due_date=None), line("l1"))
    assert (row["is_valid"], row["requires_review"]) == (True, True)


def test_empty_string_is_not_missing(spark):
    assert found(spark, invoice(vendor_name=""), line("l1")) == []


def test_everything_missing_gives_twelve_warnings_in_field_order(spark):
    empty = invoice(**dict.fromkeys(fixed.HEADER_FIELDS))
    rows = found(spark, empty)
    assert [r[2] for r in rows] == [*fixed.HEADER_FIELDS, "line_items"]
    assert {r[0] for r in rows} == {"WARNING"}
    assert verdict(spark, empty)["n_warnings"] == 12


@pytest.mark.parametrize("field", ["subtotal", "tax", "total"])
def test_total_check_is_skipped_when_an_operand_is_missing(spark, field):
    codes = [r[3] for r in found(spark, invoice(total=Decimal(1), **{field: None})
                                 if field != "total" else invoice(total=None), line("l1"))]
    assert codes == ["FIELD_MISSING"]


@pytest.mark.parametrize(("total", "wrong"), [
    ("115.00", False), ("115.01", False), ("114.99", False), ("115.02", True), ("114.98", True),
])
def test_tolerance_is_strict(spark, total, wrong):
    rows = found(spark, invoice(total=Decimal(total)), line("l1"))
    assert bool(rows) is wrong


def test_decimal_sum_is_exact(spark):
    header = invoice(subtotal=Decimal("0.10"), tax=Decimal("0.20"), total=Decimal("0.30"))
    assert found(spark, header, line("l1")) == []


def test_line_messages_use_rank_not_stored_order(spark):
    items = [line("a", order=4), line("b", order=7, amount="999.00"), line("c", order=9)]
    rows = findings.line_mismatches(lines(spark, *items)).collect()
    assert [(r["field"], r["ord"]) for r in rows] == [("line_items[1].amount", 2)]
    assert rows[0]["message"] == (
        "line_items[1]: quantity (5.0000) × unit_price (20.00) = 100.000000, "
        "which does not match amount (999.00)."
    )


def test_total_message(spark):
    row = findings.total_mismatches(invoices(spark, invoice(total=Decimal("999.00")))).first()
    assert row["message"] == (
        "subtotal (100.00) + tax (15.00) = 115.00, which does not match total (999.00)."
    )


def test_line_with_missing_numbers_is_not_checked(spark):
    assert found(spark, invoice(), line("l1", quantity=None, price=None, amount=None)) == []


def test_two_errors(spark):
    header = invoice(total=Decimal("1.00"))
    assert [r[3] for r in found(spark, header, line("l1", amount="1.00"))] == [
        "TOTAL_MISMATCH", "LINE_ITEM_AMOUNT_MISMATCH",
    ]
    row = verdict(spark, header, line("l1", amount="1.00"))
    assert (row["n_errors"], row["is_valid"], row["requires_review"]) == (2, False, True)


def _many(spark, n):
    """One invoice with a third of all lines, unordered, with equal line orders."""
    rows = [line(f"h{(i * 7919) % n:05d}", "i1", i % 3, amount="1.00" if i % 5 == 0 else "100.00")
            for i in range(n)]
    rows += [line(f"c{i:05d}", f"i{2 + i // 4}", i % 4, amount="1.00" if i % 3 == 0 else "100.00")
             for i in range(2 * n)]
    return lines(spark, *rows)


def test_huge_invoice_is_numbered_across_tasks(spark):
    items = _many(spark, 600)
    plain = {(r["invoice_id"], r["line_id"]): r["line_index"]
             for r in findings.number_lines(items).collect()}
    split = {(r["invoice_id"], r["line_id"]): r["line_index"]
             for r in findings.number_lines(items, min_rows=100).collect()}
    assert len(plain) == 1800
    assert plain == split
    expected = sorted((r["line_order"], r["line_id"]) for r in
                      items.where("invoice_id = 'i1'").collect())
    assert [split[("i1", key)] for _, key in expected] == list(range(600))


def test_heavy_keys_names_only_the_heavy_one(spark):
    from docledger.functions.groups import heavy_keys

    rows = heavy_keys(_many(spark, 600), "invoice_id", 100).collect()
    assert [r[0] for r in rows] == ["i1"]
    assert heavy_keys(_many(spark, 600), "invoice_id").collect() == []


def test_many_heavy_keys_and_a_heavy_null_are_split(spark):
    from docledger.functions.groups import number_in_group

    df = spark.range(6000).selectExpr("IF(id % 3 = 0, NULL, id % 1500) AS k", "id AS o")
    plain = number_in_group(df, "k", [F.col("o")], "n").collect()
    split = number_in_group(df, "k", [F.col("o")], "n", min_rows=2).collect()
    assert sorted(map(str, plain)) == sorted(map(str, split))
    assert max(r["n"] for r in split if r["k"] is None) == 1999


def test_findings_are_only_of_the_invoices_asked_for(spark):
    items = lines(spark, line("l1", "i1", amount="1.00"), line("l2", "i2", amount="2.00"))
    rows = findings.all_findings(invoices(spark, invoice("i1")), items).collect()
    assert [(r["invoice_id"], r["code"]) for r in rows] == [("i1", "LINE_ITEM_AMOUNT_MISMATCH")]


def test_nested_invoices_split_into_parts_and_keep_every_line(spark):
    items = _many(spark, 60)
    heads = invoices(spark, invoice("i1"), invoice("i2"), invoice("i9999"))
    rows = findings.nested_invoices(heads, items, lines_per_part=25).collect()
    parts = sorted((r["invoice_id"], r["part_no"], len(r["line_items"])) for r in rows)
    assert parts == [("i1", 0, 25), ("i1", 1, 25), ("i1", 2, 10), ("i2", 0, 4), ("i9999", 0, 0)]
    first = next(r for r in rows if (r["invoice_id"], r["part_no"]) == ("i1", 0))
    assert [x["line_index"] for x in first["line_items"]] == list(range(25))


def test_validation_stage_always_goes_to_review(spark):
    from builders import document, documents

    docs = documents(spark, document("d1"), document("d2"))
    rows = {r["document_id"]: r for r in
            findings.validation_stage(docs, invoices(spark, invoice("i1", total=None))).collect()}
    assert rows["d1"]["verdict_status"] == "REVIEW_REQUIRED"
    assert (rows["d2"]["verdict_status"], rows["d2"]["error_category"]) == (
        "FAILED", "PROCESSING_ERROR")


def test_kept_counts_equal_counting_again_after_any_edits(spark):
    r = random.Random(9)
    def some(key, i):
        return line(f"{key}-{i}", key, i, quantity="1", price="1.00", amount=r.choice(["1.00", "5.00", None]))

    keys = [f"i{i}" for i in range(6)]
    now = {k: [some(k, i) for i in range(r.randint(0, 4))] for k in keys}
    counts = findings.line_totals(lines(spark, *[x for v in now.values() for x in v]))
    for _ in range(3):
        replaced = {k: [some(k, i) for i in range(r.randint(0, 4))] for k in r.sample(keys, 3)}
        removed = lines(spark, *[x for k in replaced for x in now[k]])
        added = lines(spark, *[x for v in replaced.values() for x in v])
        new = findings.changed_counts(counts, findings.count_changes(removed, added))
        assert {x["invoice_id"] for x in new.collect()} <= set(replaced)
        counts = counts.join(new, "invoice_id", "left_anti").unionByName(new)
        counts = spark.createDataFrame(counts.collect(), counts.schema)
        now.update(replaced)
    heads = invoices(spark, *[invoice(k) for k in keys])
    again = findings.with_verdict(heads, lines(spark, *[x for v in now.values() for x in v]))
    kept = findings.with_counted_verdict(heads, counts)
    assert sorted(map(str, kept.collect())) == sorted(map(str, again.collect()))


def test_lines_are_ranked_before_they_meet_their_invoices(spark):
    items = lines(spark, line("l1", amount="1.00"), line("l2", order=1), line("l3", "i9", amount="1.00"))
    assert "Join" not in findings.line_mismatches(items)._jdf.queryExecution().optimizedPlan().toString()
    found = findings.all_findings(invoices(spark, invoice("i1")), items).collect()
    assert [r["field"] for r in found if r["severity"] == "ERROR"] == ["line_items[0].amount"]
