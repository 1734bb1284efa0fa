"""Queries over field extraction and draft loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger import fixed
from docledger.operators import extract
from docledger.operators.hooks import run_extractor
from docledger.plans.samples import LengthExtractor
from docledger.plans.shown import shown, text_sql
from docledger.plans.standins import ctes, driver_table, frame
from docledger.plans.uploads import chars_sql, id_sql
from docledger.sources.workspace import persisted


def _queue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents in processing, and the invoices that exist for some of them."""
    invoices = frame(spark, sf_dir, "invoices").where("approved_by_user_id IS NOT NULL")
    return frame(spark, sf_dir, "queue"), invoices


def extraction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.candidates(*_queue(spark, sf_dir))


def extraction_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.resumable(*_queue(spark, sf_dir))


def extraction_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = extract.with_text_failure(frame(spark, sf_dir, "texts"))
    return checked.where(F.col("error_message").isNotNull()).select(
        "document_id", "error_category", "error_message"
    )


def prompt_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.requests(frame(spark, sf_dir, "texts")).select(
        "document_id", extract.prompt(F.col("request_text")).alias("request")
    )


def extraction_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call the extractor once per document, keep the answers, then use them."""
    requests = extract.requests(frame(spark, sf_dir, "texts"))
    answers = persisted(run_extractor(requests, LengthExtractor), "answers")
    parsed = extract.parse_payload(answers, "raw_json")
    return shown(extract.with_extraction_outcome(parsed)).select(
        "document_id", "error_kind", "error_category", "error_message", "vendor_name",
        "subtotal", "total", F.size("line_items").cast("bigint").alias("n_lines"),
    )


def extraction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = frame(spark, sf_dir, "payloads").where("error_kind IS NOT NULL")
    return failed.select(
        "document_id", "error_kind",
        extract.provider_failure(F.col("error_kind")).alias("error_message"),
    )


def tool_block_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of several blocks, built from the order rows."""
    def block(kind: str, name: str, text: str):
        return F.struct(
            F.expr(kind).alias("type"), F.expr(name).alias("name"), F.expr(text).alias("input")
        )

    tool = f"'{fixed.TOOL_NAME}'"
    blocks = F.array(
        block("'text'", tool, "'commentary'"),
        block("'tool_use'", f"CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE {tool} END",
              "o_orderpriority"),
        block("CASE WHEN o_orderkey % 2 = 0 THEN 'text' ELSE 'tool_use' END", tool,
              "o_orderstatus"),
    )
    answers = driver_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), blocks.alias("blocks")
    )
    return answers.select("document_id", extract.tool_input(F.col("blocks")).alias("tool_input"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.parse_payload(frame(spark, sf_dir, "payloads"), "raw_json")


def extraction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir)
    kept = [F.when(~F.col("schema_bad"), F.col(n)).alias(n) for n in fixed.HEADER_FIELDS]
    return shown(parsed.select(
        "document_id", "schema_bad", *kept,
        F.when(~F.col("schema_bad"), F.size("line_items")).cast("bigint").alias("n_lines"),
    ))


def draft_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = extract.with_extraction_outcome(_parsed(spark, sf_dir))
    return parsed.select("document_id", "limits_bad", "error_category", "error_message")


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = extract.with_extraction_outcome(_parsed(spark, sf_dir))
    return parsed.where(F.col("error_message").isNull())


def draft_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(extract.draft_headers(_good(spark, sf_dir)))


def draft_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(extract.draft_lines(_good(spark, sf_dir)))


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _type(doc: str, name: str) -> str:
    return f"json_type({doc}, '$.{name}')"


def _given(doc: str, name: str) -> str:
    return f"coalesce({_type(doc, name)}, 'NULL') <> 'NULL'"


def _number_text(doc: str, name: str) -> str:
    return f"replace(trim(json_extract_string({doc}, '$.{name}')), '_', '')"


def _bad_string(doc: str, name: str) -> str:
    return f"({_given(doc, name)} AND {_type(doc, name)} <> 'VARCHAR')"


def _bad_number(doc: str, name: str) -> str:
    return (
        f"({_given(doc, name)} AND ({_type(doc, name)} IN ('BOOLEAN', 'ARRAY', 'OBJECT') OR "
        f"NOT regexp_matches({_number_text(doc, name)}, '{_NUMBER}')))"
    )


def _date(doc: str, name: str) -> str:
    text = f"json_extract_string({doc}, '$.{name}')"
    day = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    return (
        f"CASE WHEN {_type(doc, name)} IN ('BOOLEAN', 'ARRAY', 'OBJECT') THEN NULL "
        f"WHEN regexp_matches({text}, '{day}([Tt _]00:00(:00(\\.0+)?)?)?$') "
        f"THEN TRY_CAST(left({text}, 10) AS DATE) "
        f"WHEN regexp_matches({text}, '^[+-]?[0-9]+$') AND TRY_CAST({text} AS BIGINT) % 86400 = 0 "
        f"THEN DATE '1970-01-01' + CAST(TRY_CAST({text} AS BIGINT) // 86400 AS INTEGER) END"
    )


def parsed_sql(source: str, column: str, key: str, null_lines_ok: bool = False) -> str:
    """CTEs `raw`, `parsed_items`, `parsed` reading a JSON column strictly."""
    bad, values, fits = [], [], []
    for n in fixed.HEADER_FIELDS:
        if n in fixed.TEXT_FIELDS:
            bad.append(_bad_string("j", n))
            values.append(f"CASE WHEN {_type('j', n)} = 'VARCHAR' "
                          f"THEN json_extract_string(j, '$.{n}') END AS {n}")
            fits.append(f"coalesce(length({n}) > {fixed.TEXT_LIMITS[n]}, false)")
        elif n in fixed.DATE_FIELDS:
            values.append(f"{_date('j', n)} AS {n}")
            bad.append(f"({_given('j', n)} AND ({_date('j', n)}) IS NULL)")
        else:
            bad.append(_bad_number("j", n))
            values.append(f"{_number_text('j', n)} AS {n}")
            fits.append(f"({n} IS NOT NULL AND TRY_CAST({n} AS DECIMAL(14,2)) IS NULL)")
    listed = "json_type(j, '$.line_items')"
    bad_list = f"{listed} IS NOT NULL AND {listed} <> 'ARRAY'"
    if null_lines_ok:
        bad_list += f" AND {listed} <> 'NULL'"
    line_bad = " OR ".join(
        ["json_type(item) <> 'OBJECT'", _bad_string("item", "description")]
        + [_bad_number("item", n) for n in fixed.LINE_NUMBER_FIELDS]
    )
    line_values = ", ".join(
        ["json_extract_string(item, '$.description') AS description"]
        + [f"TRY_CAST({_number_text('item', n)} AS {fixed.LINE_TYPES[n]}) AS {n}"
           for n in fixed.LINE_NUMBER_FIELDS]
    )
    line_unfit = " OR ".join(
        ["coalesce(length(json_extract_string(item, '$.description')) > 1024, false)"]
        + [f"({_number_text('item', n)} IS NOT NULL AND "
           f"TRY_CAST({_number_text('item', n)} AS {fixed.LINE_TYPES[n]}) IS NULL)"
           for n in fixed.LINE_NUMBER_FIELDS]
    )
    keep = ", ".join(
        f"TRY_CAST({n} AS DECIMAL(14,2)) AS {n}" if n in fixed.MONEY_FIELDS else n
        for n in fixed.HEADER_FIELDS
    )
    return f"""raw AS (
  SELECT *, CASE WHEN json_valid({column}) THEN CAST({column} AS JSON) END AS j FROM {source}
),
parsed_items AS (
  SELECT raw_id, line_order, {line_values}, coalesce({line_bad}, true) AS bad,
    {line_unfit} AS unfit
  FROM (SELECT {key} AS raw_id, unnest(items) AS item,
      CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS line_order
    FROM (SELECT *, CASE WHEN {listed} = 'ARRAY'
      THEN CAST(json_extract(j, '$.line_items') AS JSON[]) ELSE [] END AS items FROM raw))
),
item_flags AS (
  SELECT raw_id, count(*) AS n_lines, bool_or(bad) AS bad, bool_or(unfit) AS unfit
  FROM parsed_items GROUP BY raw_id
),
header_values AS (
  SELECT * EXCLUDE (j), {", ".join(values)},
    coalesce(json_type(j) <> 'OBJECT', true) OR ({bad_list}) OR {" OR ".join(bad)} AS header_bad
  FROM raw
),
parsed AS (
  SELECT h.* EXCLUDE (header_bad, {", ".join(fixed.HEADER_FIELDS)}), {keep},
    coalesce(f.n_lines, 0) AS n_lines,
    coalesce(header_bad, false) OR coalesce(f.bad, false) AS schema_bad,
    NOT (coalesce(header_bad, false) OR coalesce(f.bad, false))
      AND ({" OR ".join(fits)} OR coalesce(f.unfit, false)) AS limits_bad
  FROM header_values h LEFT JOIN item_flags f ON f.raw_id = h.{key}
)"""


PARSED_SQL = parsed_sql("payloads", "raw_json", "document_id")

MESSAGE_SQL = f"""CASE
  WHEN error_kind = 'timeout' THEN '{fixed.PROVIDER_ERRORS['timeout']}'
  WHEN error_kind = 'auth' THEN '{fixed.PROVIDER_ERRORS['auth']}'
  WHEN error_kind = 'response' THEN '{fixed.PROVIDER_ERRORS['response']}'
  WHEN error_kind IS NOT NULL THEN '{fixed.PROVIDER_ERRORS['other']}'"""

OUTCOME_SQL = f"""judged AS (
  SELECT *, {MESSAGE_SQL}
  WHEN schema_bad THEN '{fixed.SCHEMA_MISMATCH}'
  WHEN limits_bad THEN '{fixed.SAVE_FAILED}' END AS error_message,
  CASE WHEN error_kind IS NULL AND NOT schema_bad AND limits_bad THEN 'DATABASE_ERROR'
  WHEN error_kind IS NOT NULL OR schema_bad THEN 'AI_PROVIDER_ERROR' END AS error_category
  FROM parsed
)"""

TEXT_FAILURE_SQL = f"""CASE WHEN extracted_text_storage_key IS NULL THEN '{fixed.NO_TEXT}'
  WHEN text IS NULL THEN '{fixed.TEXT_UNREADABLE}'
  WHEN {chars_sql('text')} = 0 THEN '{fixed.NO_TEXT}' END"""

_QUEUE_SQL = f"""WITH {ctes('queue', 'invoices')},
existing AS (SELECT document_id FROM invoices WHERE approved_by_user_id IS NOT NULL)"""

_NULLS = (
    "NULL AS approved_at, NULL AS approved_by_user_id, NULL AS rejected_at, "
    "NULL AS rejected_by_user_id, NULL AS rejection_reason"
)

QUERIES = {
    "extraction_candidates": extraction_candidates,
    "extraction_resume": extraction_resume,
    "extraction_blank": extraction_blank,
    "prompt_column": prompt_column,
    "extraction_run": extraction_run,
    "extraction_errors": extraction_errors,
    "tool_block_pick": tool_block_pick,
    "extraction_parse": extraction_parse,
    "draft_limits": draft_limits,
    "draft_header": draft_header,
    "draft_lines": draft_lines,
}

_RUN_SIZE = "length(text)"

ORACLES = {
    "extraction_candidates": f"""{_QUEUE_SQL}
SELECT document_id, organization_id, status FROM queue WHERE status = 'TEXT_EXTRACTED'
  AND document_id NOT IN (SELECT document_id FROM existing)""",
    "extraction_resume": f"""{_QUEUE_SQL}
SELECT document_id, organization_id, status FROM queue WHERE status = 'VALIDATING_RESULT'
  AND document_id IN (SELECT document_id FROM existing)""",
    "extraction_blank": f"""WITH {ctes('texts')}
SELECT document_id, 'PROCESSING_ERROR' AS error_category, {TEXT_FAILURE_SQL} AS error_message
FROM texts WHERE {TEXT_FAILURE_SQL} IS NOT NULL""",
    "prompt_column": f"""WITH {ctes('texts')}
SELECT document_id, '{fixed.PROMPT_PREFIX.strip()}' || chr(10) || chr(10) || text AS request
FROM texts WHERE {TEXT_FAILURE_SQL} IS NULL""",
    "extraction_run": f"""WITH {ctes('texts')},
sized AS (SELECT document_id, CAST({_RUN_SIZE} AS BIGINT) AS n FROM texts
  WHERE {TEXT_FAILURE_SQL} IS NULL),
kinds AS (SELECT *, CASE WHEN n % 19 = 0 THEN CASE n % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'auth'
  ELSE 'response' END WHEN n % 23 = 0 THEN 'other' END AS error_kind FROM sized),
states AS (SELECT *, error_kind IS NULL AND n % 29 = 0 AS wrong FROM kinds)
SELECT document_id, error_kind,
  CASE WHEN error_kind IS NOT NULL OR wrong THEN 'AI_PROVIDER_ERROR' END AS error_category,
  {MESSAGE_SQL} WHEN wrong THEN '{fixed.SCHEMA_MISMATCH}' END AS error_message,
  CASE WHEN error_kind IS NULL AND NOT wrong THEN 'Vendor ' || (n % 100) END AS vendor_name,
  CASE WHEN error_kind IS NULL AND NOT wrong THEN n || '.00' END AS subtotal,
  CASE WHEN error_kind IS NULL AND NOT wrong THEN (n + 1 + n % 2) || '.50' END AS total,
  CAST(CASE WHEN error_kind IS NULL AND NOT wrong THEN 1 ELSE 0 END AS BIGINT) AS n_lines
FROM states""",
    "extraction_errors": f"""WITH {ctes('payloads')}
SELECT document_id, error_kind, {MESSAGE_SQL} END AS error_message
FROM payloads WHERE error_kind IS NOT NULL""",
    "tool_block_pick": """SELECT o_orderkey AS document_id,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority
    WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS tool_input FROM orders""",
    "extraction_parse": f"""WITH {ctes('payloads')}, {PARSED_SQL}
SELECT document_id, schema_bad,
  {", ".join(f"CASE WHEN NOT schema_bad THEN CAST({n} AS VARCHAR) END AS {n}"
             for n in fixed.HEADER_FIELDS)},
  CASE WHEN NOT schema_bad THEN n_lines END AS n_lines FROM parsed""",
    "draft_limits": f"""WITH {ctes('payloads')}, {PARSED_SQL}, {OUTCOME_SQL}
SELECT document_id, limits_bad, error_category, error_message FROM judged""",
    "draft_header": f"""WITH {ctes('payloads')}, {PARSED_SQL}, {OUTCOME_SQL}
SELECT {id_sql('invoice', 'document_id')} AS invoice_id, document_id,
  {text_sql(*fixed.HEADER_FIELDS)}, {_NULLS} FROM judged WHERE error_message IS NULL""",
    "draft_lines": f"""WITH {ctes('payloads')}, {PARSED_SQL}, {OUTCOME_SQL},
good AS (SELECT {id_sql('invoice', 'document_id')} AS invoice_id, i.* FROM judged g
  JOIN parsed_items i ON i.raw_id = g.document_id WHERE error_message IS NULL)
SELECT {id_sql('line', 'invoice_id', 'line_order')} AS line_id, invoice_id, line_order,
  description, {text_sql('quantity', 'unit_price', 'amount')} FROM good""",
}
