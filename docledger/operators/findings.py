"""Findings: missing fields and arithmetic mismatches, never stored."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import fixed
from docledger.functions.groups import HEAVY_ROWS, number_in_group

LINES_PER_PART = 1_000


def _off(expected: Column, stated: Column) -> Column:
    """Strictly more than the tolerance apart; NULL operands give NULL."""
    return F.abs(expected - stated) > F.lit(Decimal(fixed.TOLERANCE))


def total_off(subtotal: Column, tax: Column, total: Column) -> Column:
    return _off(subtotal + tax, total)


def line_off(quantity: Column, unit_price: Column, amount: Column) -> Column:
    return _off(quantity * unit_price, amount)


def _finding(ordinal: int, severity: str, field: str, code: str, message: str) -> str:
    """A finding as an SQL struct; `message` is an SQL expression."""
    return (
        f"named_struct('severity', '{severity}', 'ord', {ordinal}L, 'field', '{field}', "
        f"'code', '{code}', 'message', {message})"
    )


def _missing(ordinal: int, name: str) -> str:
    message = f"'{name}{fixed.MISSING_SUFFIX}'"
    finding = _finding(ordinal, "WARNING", name, "FIELD_MISSING", message)
    return f"CASE WHEN {name} IS NULL THEN {finding} END"


def _total_mismatch() -> str:
    message = (
        "concat('subtotal (', subtotal, ') + tax (', tax, ') = ', subtotal + tax, "
        "', which does not match total (', total, ').')"
    )
    finding = _finding(0, "ERROR", "total", "TOTAL_MISMATCH", message)
    return (
        f"CASE WHEN abs(subtotal + tax - total) > {fixed.TOLERANCE} THEN {finding} END"
    )


def _unfold(invoices: DataFrame, findings: list[str]) -> DataFrame:
    """One row per finding. A generator over the candidate findings and a filter
    behind it stay inside one generated stage."""
    return invoices.selectExpr(
        "invoice_id", f"inline(array({', '.join(findings)}))"
    ).where("code IS NOT NULL")


def missing_fields(invoices: DataFrame) -> DataFrame:
    return _unfold(invoices, [_missing(i, n) for i, n in enumerate(fixed.HEADER_FIELDS)])


def total_mismatches(invoices: DataFrame) -> DataFrame:
    return _unfold(invoices, [_total_mismatch()])


def header_findings(invoices: DataFrame) -> DataFrame:
    """Missing fields and total mismatch in one pass over the headers."""
    return _unfold(
        invoices,
        [_missing(i, n) for i, n in enumerate(fixed.HEADER_FIELDS)] + [_total_mismatch()],
    )


def without_lines(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoices that have no line; distinct keys keep a huge invoice small."""
    return invoices.join(lines.select("invoice_id").distinct(), "invoice_id", "left_anti")


def no_line_findings(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    finding = _finding(
        len(fixed.HEADER_FIELDS), "WARNING", "line_items", "NO_LINE_ITEMS",
        f"'{fixed.NO_LINES_MESSAGE}'",
    )
    return _unfold(without_lines(invoices.select("invoice_id"), lines), [finding])


def number_lines(
    lines: DataFrame, min_rows: int = HEAVY_ROWS, probe: DataFrame | None = None
) -> DataFrame:
    """Add `line_index`, the 0-based rank by stored order, not the order itself.

    `probe` is a cheaper frame of the same or more lines in which to look for
    invoices with very many lines.
    """
    return number_in_group(
        lines, "invoice_id", [F.col("line_order"), F.col("line_id")], "line_index", min_rows, probe
    )


def line_mismatches(
    lines: DataFrame, min_rows: int = HEAVY_ROWS, probe: DataFrame | None = None
) -> DataFrame:
    quantity, unit_price, amount = F.col("quantity"), F.col("unit_price"), F.col("amount")
    # Numbers travel, as text, only with the mismatching lines; the others are shuffled
    # and sorted as bare keys, once, because their rank still counts.
    text = F.concat(
        F.lit("quantity ("), quantity.cast("string"), F.lit(") × unit_price ("),
        unit_price.cast("string"), F.lit(") = "), (quantity * unit_price).cast("string"),
        F.lit(", which does not match amount ("), amount.cast("string"), F.lit(")."),
    )
    slim = lines.select(
        "invoice_id", "line_order", "line_id",
        F.when(line_off(quantity, unit_price, amount), text).alias("_text"),
    )
    place = F.concat(F.lit("line_items["), F.col("line_index").cast("string"), F.lit("]"))
    numbered = number_lines(slim, min_rows, lines if probe is None else probe)
    return numbered.where(F.col("_text").isNotNull()).select(
        "invoice_id",
        F.lit("ERROR").alias("severity"),
        (F.col("line_index") + 1).alias("ord"),
        F.concat(place, F.lit(".amount")).alias("field"),
        F.lit("LINE_ITEM_AMOUNT_MISMATCH").alias("code"),
        F.concat(place, F.lit(": "), F.col("_text")).alias("message"),
    )


def all_findings(
    invoices: DataFrame, lines: DataFrame, min_rows: int = HEAVY_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Every finding of `invoices`; (severity, ord) orders them within an invoice.

    Lines of other invoices are left out.
    """
    # The lines' ranks are in order of the invoices, so that the join behind them neither
    # shuffles nor sorts again; before them it would sort all lines once more.
    off = line_mismatches(lines.where(F.col("invoice_id").isNotNull()), min_rows,
                          lines if probe is None else probe)
    return (
        header_findings(invoices)
        .unionByName(no_line_findings(invoices, lines))
        .unionByName(off.join(invoices.select("invoice_id"), "invoice_id", "left_semi"))
    )


def line_totals(lines: DataFrame) -> DataFrame:
    """Lines and mismatching lines per invoice, combined map-side."""
    off = line_off(F.col("quantity"), F.col("unit_price"), F.col("amount"))
    return lines.groupBy("invoice_id").agg(
        F.count("*").alias("n_lines"), F.count_if(off).alias("n_bad_lines")
    )


def count_changes(removed: DataFrame, added: DataFrame) -> DataFrame:
    """By how much lines that go and lines that come change the counts of their invoices."""
    off = line_off(F.col("quantity"), F.col("unit_price"), F.col("amount"))
    columns = ("invoice_id", "quantity", "unit_price", "amount")
    signed = added.select(*columns, F.lit(1).alias("sign")).unionByName(
        removed.select(*columns, F.lit(-1).alias("sign")))
    return signed.groupBy("invoice_id").agg(
        F.sum("sign").alias("n_lines"),
        F.sum(F.when(off, F.col("sign")).otherwise(0)).alias("n_bad_lines"))


def changed_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """The counts of the invoices in `changes`, after them; others need no new row.

    `counts` comes from `line_totals` or from here. No line is read but those that go
    and come.
    """
    old = counts.withColumnsRenamed({"n_lines": "_lines", "n_bad_lines": "_bad"})
    return changes.join(old, "invoice_id", "left").select(
        "invoice_id",
        (F.col("n_lines") + F.coalesce("_lines", F.lit(0))).alias("n_lines"),
        (F.col("n_bad_lines") + F.coalesce("_bad", F.lit(0))).alias("n_bad_lines"))


def with_verdict(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Add finding counts and the two verdicts to each invoice."""
    return with_counted_verdict(invoices, line_totals(lines))


def with_counted_verdict(invoices: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from kept counts of lines; an invoice without a row there has no lines."""
    missing = sum(F.col(n).isNull().cast("bigint") for n in fixed.HEADER_FIELDS)
    bad_total = F.coalesce(
        total_off(F.col("subtotal"), F.col("tax"), F.col("total")), F.lit(False)
    )
    n_lines = F.coalesce("n_lines", F.lit(0))
    return (
        invoices.join(counts, "invoice_id", "left")
        .withColumns({
            "n_errors": F.coalesce("n_bad_lines", F.lit(0)) + bad_total.cast("bigint"),
            "n_warnings": missing + (n_lines == 0).cast("bigint"),
        })
        .withColumns({
            "is_valid": F.col("n_errors") == 0,
            "requires_review": (F.col("n_errors") > 0) | (F.col("n_warnings") > 0),
        })
        .drop("n_lines", "n_bad_lines")
    )


def verdicts(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    return with_verdict(invoices, lines).select(
        "invoice_id", "n_errors", "n_warnings", "is_valid", "requires_review"
    )


def nested_invoices(
    invoices: DataFrame, lines: DataFrame, lines_per_part: int = LINES_PER_PART,
    min_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Headers with their ordered lines nested.

    One row per invoice and part of `lines_per_part` lines; an ordinary invoice
    has part 0 only, an invoice without lines has part 0 with an empty list.
    """
    part = F.floor(F.col("line_index") / lines_per_part).cast("int")
    parts = (
        number_lines(lines, min_rows)
        .groupBy("invoice_id", part.alias("part_no"))
        .agg(
            F.array_sort(F.collect_list(F.struct(
                "line_index", "description", "quantity", "unit_price", "amount"
            ))).alias("line_items")
        )
    )
    filled = parts.join(invoices, "invoice_id")
    empty = F.array().cast(parts.schema["line_items"].dataType)
    bare = without_lines(invoices, lines).withColumns(
        {"part_no": F.lit(0), "line_items": empty}
    )
    return filled.unionByName(bare)


def validation_stage(documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """Outcome of validating drafts: always to review, unless there is no draft."""
    drafts = invoices.select("document_id", F.lit(True).alias("_draft"))
    missing = F.col("_draft").isNull()
    return documents.join(drafts, "document_id", "left").withColumns({
        "stage": F.lit("RESULT_VALIDATION"),
        "verdict_status": F.when(missing, "FAILED").otherwise("REVIEW_REQUIRED"),
        "job_status": F.when(missing, "FAILED").otherwise("SUCCESS"),
        "error_category": F.when(missing, F.lit("PROCESSING_ERROR")),
        "error_message": F.when(missing, F.lit(fixed.NO_DRAFT)),
    }).drop("_draft")
