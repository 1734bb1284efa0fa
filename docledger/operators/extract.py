"""Field extraction: whom to ask, reading the answer, drafting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import fixed
from docledger.functions import strict
from docledger.functions.ids import derived_id
from docledger.functions.text import is_blank


def candidates(documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """Documents at TEXT_EXTRACTED without an invoice: never pay twice."""
    ready = documents.where(F.col("status") == "TEXT_EXTRACTED")
    return ready.join(invoices.select("document_id"), "document_id", "left_anti")


def resumable(documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """Documents whose draft exists but whose validation never finished."""
    waiting = documents.where(F.col("status") == "VALIDATING_RESULT")
    return waiting.join(invoices.select("document_id"), "document_id", "left_semi")


def text_failure() -> Column:
    """Why a candidate cannot be sent, from its artifact key and its text."""
    no_key = F.col("extracted_text_storage_key").isNull() | (
        F.col("extracted_text_storage_key") == ""
    )
    return (
        F.when(no_key, fixed.NO_TEXT)
        .when(F.col("text").isNull(), fixed.TEXT_UNREADABLE)
        .when(is_blank("text"), fixed.NO_TEXT)
    )


def with_text_failure(texts: DataFrame) -> DataFrame:
    message = text_failure()
    return texts.withColumns({
        "error_category": F.when(message.isNotNull(), F.lit("PROCESSING_ERROR")),
        "error_message": message,
    })


def prompt(text: Column) -> Column:
    return F.concat(F.lit(fixed.PROMPT_PREFIX), text)


def requests(texts: DataFrame) -> DataFrame:
    """Requests for the extractor; blank or missing text never gets there."""
    return texts.where(text_failure().isNull()).select(
        "document_id", F.col("text").alias("request_text")
    )


def provider_failure(kind: Column) -> Column:
    """Safe message of a provider error kind; NULL when there was none."""
    pairs = [F.lit(x) for pair in fixed.PROVIDER_ERRORS.items() for x in pair]
    known = F.try_element_at(F.create_map(*pairs), kind)
    return F.when(
        kind.isNotNull(), F.coalesce(known, F.lit(fixed.PROVIDER_ERRORS["other"]))
    )


def tool_input(blocks: Column) -> Column:
    """Input of the first block that calls the extraction tool, else NULL."""
    calls = F.filter(
        blocks, lambda b: (b["type"] == "tool_use") & (b["name"] == fixed.TOOL_NAME)
    )
    return F.get(calls, F.lit(0))["input"]


def _value(variant: str, name: str, text: str) -> str:
    if name in fixed.DATE_FIELDS:
        return strict.date_value(text)
    if name in fixed.MONEY_FIELDS or name in fixed.LINE_NUMBER_FIELDS:
        return strict.number_value(text)
    return strict.string_value(variant, f"$.{name}", text)


_OBJECT_START = r"^[ \t\r\n]*\{"
_LINE_FIELDS = ("description", *fixed.LINE_NUMBER_FIELDS)


def _lines_expr() -> str:
    """Line structs as stored, each with `bad` (malformed) and `fits`.

    Three steps per line, so that nothing is read twice: texts, then values,
    then typed values.
    """
    texts = ", ".join(
        ["'item', i"]
        + [f"'text_{n}', {strict.json_text('i', f'$.{n}')}" for n in _LINE_FIELDS]
    )
    values = ", ".join(
        ["'kind', schema_of_variant(t.item)"]
        + [f"'text_{n}', t.text_{n}" for n in _LINE_FIELDS]
        + [f"'{n}', {_value('t.item', n, f't.text_{n}')}" for n in _LINE_FIELDS]
    )
    bad = " OR ".join(
        ["NOT coalesce(startswith(v.kind, 'OBJECT'), false)"]
        + [strict.rejected(f"v.text_{n}", f"v.{n}") for n in _LINE_FIELDS]
    )
    fits = " AND ".join(
        [strict.text_fits("v.description", fixed.LINE_DESCRIPTION_LIMIT)]
        + [strict.fits(f"v.{n}", t) for n, t in fixed.LINE_TYPES.items()]
    )
    typed = ", ".join(
        ["'description', v.description"]
        + [f"'{n}', try_cast(v.{n} AS {t})" for n, t in fixed.LINE_TYPES.items()]
        + [f"'bad', {bad}", f"'fits', {fits}"]
    )
    return (
        f"transform(transform(transform(_items, i -> named_struct({texts})), "
        f"t -> named_struct({values})), v -> named_struct({typed}))"
    )


def parse_payload(df: DataFrame, payload: str, null_lines_ok: bool = False) -> DataFrame:
    """Read a JSON text column into typed columns plus two verdicts.

    Adds the 11 header fields, `line_items`, `schema_bad` (any malformed field
    rejects the whole document) and `limits_bad` (well formed, but some value
    cannot be stored in its column). Values are rounded to column scale.
    `null_lines_ok` accepts an explicit null list, as edits do.
    """
    names, kept = fixed.HEADER_FIELDS, [f"`{c}`" for c in df.columns]
    raw = df.withColumn("_doc", F.try_parse_json(payload)).selectExpr(
        *kept, "_doc",
        *[f"{strict.json_text('_doc', f'$.{n}')} AS _text_{n}" for n in names],
        "try_variant_get(_doc, '$.line_items', 'array<variant>') AS _items",
    )
    # Texts, values and verdicts are separate steps, so that each is computed once.
    values = raw.selectExpr(
        *kept,
        f"_doc IS NOT NULL AND `{payload}` RLIKE r'{_OBJECT_START}' AS _is_object",
        f"CASE WHEN _items IS NULL THEN {strict.json_type('_doc', '$.line_items')} END "
        "AS _other_list",
        f"{_lines_expr()} AS _lines",
        *[f"_text_{n}" for n in names],
        *[f"{_value('_doc', n, f'_text_{n}')} AS _v_{n}" for n in names],
    )
    list_bad = "_other_list IS NOT NULL"
    if null_lines_ok:
        list_bad += " AND _other_list <> 'VOID'"
    schema_bad = [
        "NOT coalesce(_is_object, false)",
        f"({list_bad})",
        "coalesce(exists(_lines, x -> x.bad), false)",
        *[strict.rejected(f"_text_{n}", f"_v_{n}") for n in names],
    ]
    unfit = [
        "coalesce(exists(_lines, x -> NOT x.fits), false)",
        *[f"NOT {strict.fits(f'_v_{n}', fixed.MONEY_TYPE)}" for n in fixed.MONEY_FIELDS],
        *[f"NOT {strict.text_fits(f'_v_{n}', limit)}" for n, limit in fixed.TEXT_LIMITS.items()],
    ]
    judged = values.selectExpr(
        *kept,
        *[f"try_cast(_v_{n} AS {fixed.MONEY_TYPE}) AS {n}" if n in fixed.MONEY_FIELDS
          else f"_v_{n} AS {n}" for n in names],
        "_lines",
        f"{' OR '.join(schema_bad)} AS schema_bad",
        f"{' OR '.join(unfit)} AS _unfit",
    )
    # A generator keeps later filters on the verdicts above the parse: pushed
    # below, they would repeat the whole of it.
    line = ", ".join(f"'{n}', x.{n}" for n in _LINE_FIELDS)
    return judged.selectExpr(
        *kept, *names, "_lines", "inline(array(struct(schema_bad, _unfit)))"
    ).selectExpr(
        *kept, *names,
        f"transform(coalesce(_lines, array()), x -> named_struct({line})) AS line_items",
        "schema_bad",
        "NOT schema_bad AND _unfit AS limits_bad",
    )


def with_extraction_outcome(parsed: DataFrame) -> DataFrame:
    """Error category and message of answers read by `parse_payload`.

    Input also carries `error_kind` from the extractor call.
    """
    message = (
        F.when(F.col("error_kind").isNotNull(), provider_failure(F.col("error_kind")))
        .when(F.col("schema_bad"), fixed.SCHEMA_MISMATCH)
        .when(F.col("limits_bad"), fixed.SAVE_FAILED)
    )
    category = F.when(message == fixed.SAVE_FAILED, F.lit("DATABASE_ERROR")).when(
        message.isNotNull(), F.lit("AI_PROVIDER_ERROR")
    )
    return parsed.withColumns({"error_category": category, "error_message": message})


def final_status(texts: DataFrame, existing: DataFrame, answers: DataFrame) -> DataFrame:
    """Status of each document after a whole run.

    `texts` has the outcome of the text stages, `existing` the invoices from
    before the run, `answers` the extraction outcomes (none when there is no
    extractor). The text stages ask for no starting status, so a document that
    already has an invoice, even an approved one, ends at TEXT_EXTRACTED: its
    text was read again and its draft was left alone.
    """
    had = existing.select("document_id", F.lit(True).alias("_had"))
    asked = answers.select(
        "document_id", F.lit(True).alias("_asked"), F.col("error_message").alias("_error")
    )
    text_status = F.col("verdict_status")
    return (
        texts.select("document_id", "verdict_status")
        .join(had, "document_id", "left")
        .join(asked, "document_id", "left")
        .select(
            "document_id",
            F.when(text_status != "TEXT_EXTRACTED", text_status)
            .when(F.col("_had").isNotNull() | F.col("_asked").isNull(), text_status)
            .when(F.col("_error").isNotNull(), "FAILED")
            .otherwise("REVIEW_REQUIRED").alias("status"),
        )
    )


def draft_headers(good: DataFrame) -> DataFrame:
    """Draft invoices; approval and rejection stay empty."""
    return good.select(
        derived_id("invoice", "document_id").alias("invoice_id"),
        "document_id",
        *fixed.HEADER_FIELDS,
        F.lit(None).cast("timestamp").alias("approved_at"),
        F.lit(None).cast("string").alias("approved_by_user_id"),
        F.lit(None).cast("timestamp").alias("rejected_at"),
        F.lit(None).cast("string").alias("rejected_by_user_id"),
        F.lit(None).cast("string").alias("rejection_reason"),
    )


def draft_lines(good: DataFrame) -> DataFrame:
    """Draft line items numbered from 0 in the order of the array."""
    exploded = good.select(
        derived_id("invoice", "document_id").alias("invoice_id"),
        F.posexplode("line_items").alias("line_order", "item"),
    )
    return exploded.select(
        derived_id("line", "invoice_id", "line_order").alias("line_id"),
        "invoice_id", "line_order", "item.description", "item.quantity",
        "item.unit_price", "item.amount",
    )
