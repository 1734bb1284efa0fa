"""The driver's tables seen as invoice-workflow tables.

Every mapping is a list of expressions that Spark and DuckDB both understand,
so a query and the SQL it is checked against start from the same rows. Where
the two dialects differ an expression is a (Spark, DuckDB) pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

TRUE_PRICE = "CAST(o_totalprice AS DECIMAL(14,2))"
STATED_TAX = f"CAST({TRUE_PRICE} * 0.08 AS DECIMAL(14,2))"

ORGANIZATIONS = {"organization_id": "n_nationkey", "name": "n_name"}

USERS = {
    "user_id": "c_custkey",
    "organization_id": "c_nationkey",
    "email": "CASE WHEN c_custkey % 50 = 0 THEN concat(lower(c_mktsegment), '@example.com') "
             "ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END",
    "is_active": "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal < 9000 END",
}

DOCUMENTS = {
    "document_id": "o_orderkey",
    "organization_id": "c_nationkey",
    "uploaded_by_user_id": "o_custkey",
    "original_filename": "concat('invoice ', CAST(o_orderkey AS STRING), '.pdf')",
    "storage_key": "concat('files/', CAST(CASE WHEN o_orderkey % 97 = 1 THEN o_orderkey - 1 "
                   "ELSE o_orderkey END AS STRING), '.pdf')",
    "file_size_bytes": f"CAST({TRUE_PRICE} * 100 AS BIGINT)",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'REVIEW_REQUIRED' "
              "ELSE 'REJECTED' END",
    "created_at": "CAST(o_orderdate AS TIMESTAMP)",
}

# The same orders while they are still being processed
QUEUE = {
    "document_id": "o_orderkey",
    "organization_id": "o_custkey",
    "status": "CASE o_orderpriority WHEN '1-URGENT' THEN 'TEXT_EXTRACTED' "
              "WHEN '2-HIGH' THEN 'VALIDATING_RESULT' WHEN '3-MEDIUM' THEN 'OCR_REQUIRED' "
              "WHEN '5-LOW' THEN 'FAILED' ELSE 'UPLOADED' END",
}

INVOICES = {
    "invoice_id": "o_orderkey",
    "document_id": "o_orderkey",
    "vendor_name": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 23 = 0 "
                   "THEN 'Vendor, \"Quoted\" Inc.' ELSE c_mktsegment END",
    "vendor_address": "CASE WHEN o_orderkey % 6 = 0 THEN NULL "
                      "ELSE concat(CAST(c_nationkey AS STRING), ' Main Street') END",
    "customer_name": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE c_name END",
    "invoice_number": "CASE WHEN o_orderkey % 9 = 0 THEN NULL "
                      "ELSE concat('INV-', CAST(o_orderkey AS STRING)) END",
    "invoice_date": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "due_date": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 30 END",
    "currency": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'USD' END",
    "subtotal": f"CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE {TRUE_PRICE} END",
    "tax": f"CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE {STATED_TAX} END",
    "total": f"CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE CAST({TRUE_PRICE} + {STATED_TAX} + "
             "CASE o_orderkey % 7 WHEN 0 THEN 0.02 WHEN 1 THEN 0.01 ELSE 0.00 END "
             "AS DECIMAL(14,2)) END",
    "payment_terms": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Net 30' END",
    "approved_at": "CASE WHEN o_orderstatus <> 'F' OR o_orderkey % 17 = 0 THEN NULL "
                   "WHEN o_orderkey % 3 = 0 THEN CAST(concat(CAST(CAST(o_orderdate AS DATE) "
                   "AS STRING), ' 10:11:12.000345') AS TIMESTAMP) "
                   "ELSE CAST(o_orderdate AS TIMESTAMP) END",
    "approved_by_user_id": "CASE WHEN o_orderstatus = 'F' THEN o_custkey + "
                           "CASE WHEN o_orderkey % 37 = 0 THEN 100000000000 ELSE 0 END END",
    "rejected_by_user_id": "CASE WHEN o_orderstatus = 'P' THEN o_custkey END",
    "rejection_reason": "CASE WHEN o_orderstatus = 'P' THEN concat('Priority ', o_orderpriority) "
                        "END",
}

LINES = {
    "line_id": "l_partkey * 100000000 + "
               "CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 100 AS BIGINT)",
    "invoice_id": "l_orderkey",
    "line_order": "l_linenumber - 1",
    "description": "concat('Part ', CAST(l_partkey AS STRING))",
    "quantity": "CAST(l_quantity AS DECIMAL(14,4))",
    "unit_price": "CAST(l_extendedprice AS DECIMAL(14,2))",
    "amount": "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS DECIMAL(14,4)) "
              "* CAST(l_extendedprice AS DECIMAL(14,2)) + CASE l_partkey % 10 WHEN 0 THEN 0.02 "
              "WHEN 1 THEN 0.01 ELSE 0.00 END AS DECIMAL(14,2)) END",
}

VALUE_TEXT = "CAST(CAST(value AS DECIMAL(14,2)) AS STRING)"

COMMANDS = {
    "command_id": "event_id",
    "document_id": "CASE WHEN event_id % 101 = 0 THEN -1 - event_id "
                   "ELSE event_id - event_id % 4 END",
    "user_id": "user_id",
    "kind": "CASE event_type WHEN 'purchase' THEN 'APPROVE' WHEN 'signup' THEN 'APPROVE' "
            "WHEN 'error' THEN 'REJECT' ELSE 'EDIT' END",
    "issued_at": "CAST(ts AS TIMESTAMP)",
    "patch": "CASE WHEN event_type NOT IN ('view', 'click') THEN NULL "
             "ELSE CASE event_id % 9 "
             f"WHEN 0 THEN concat('{{\"vendor_name\": \"Edited ', {VALUE_TEXT}, '\"}}') "
             "WHEN 1 THEN '{\"total\": null}' "
             "WHEN 2 THEN '{\"subtotal\": \"100.00\", \"tax\": \"15.00\", \"total\": 115}' "
             "WHEN 3 THEN '{\"line_items\": [{\"description\": \"x\", \"quantity\": 2, "
             "\"unit_price\": \"5.00\", \"amount\": \"10.00\"}, {\"amount\": 1.5}]}' "
             "WHEN 4 THEN '{\"line_items\": null, \"tax\": 0}' "
             "WHEN 5 THEN '{\"currency\": \"TOO-LONG-CURRENCY\"}' "
             "WHEN 6 THEN '{\"subtotal\": \"abc\"}' "
             "WHEN 7 THEN '{\"line_items\": [{\"quantity\": 3, \"unit_price\": 2, "
             "\"amount\": 7}], \"due_date\": \"2026-08-20\"}' "
             f"ELSE concat('{{\"total\": ', {VALUE_TEXT}, ', \"payment_terms\": null}}') END END",
    "reason": "CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 7 = 0 THEN '' "
              "WHEN event_id % 7 = 1 THEN '  ' WHEN event_id % 7 = 2 THEN repeat('x', 2001) "
              f"ELSE concat('value ', {VALUE_TEXT}) END",
}
# A few commands come from a user of another tenant
COMMAND_TENANT = (
    "coalesce(CASE WHEN command_id % 29 = 0 THEN owner_id + 1 ELSE owner_id END, 0)"
)

PAYLOADS = {
    "document_id": "o_orderkey",
    "error_kind": "CASE o_orderkey % 51 WHEN 3 THEN 'timeout' WHEN 4 THEN 'auth' "
                  "WHEN 5 THEN 'response' WHEN 6 THEN 'other' WHEN 7 THEN 'unknown' END",
    "raw_json": "CASE o_orderkey % 16 "
                "WHEN 0 THEN concat('{\"vendor_name\": \"V ', CAST(o_custkey AS STRING), "
                "'\", \"invoice_date\": \"', CAST(CAST(o_orderdate AS DATE) AS STRING), "
                f"'\", \"subtotal\": \"', CAST({TRUE_PRICE} AS STRING), "
                "'\", \"tax\": 1.25, \"total\": 1000, \"line_items\": [{\"description\": \"a\", "
                "\"quantity\": 2, \"unit_price\": \"5.00\", \"amount\": 10}]}') "
                "WHEN 1 THEN '{}' "
                "WHEN 2 THEN '{\"vendor_name\": 70}' "
                "WHEN 3 THEN '{\"subtotal\": \"not-a-number\"}' "
                "WHEN 4 THEN '{\"line_items\": \"seven lines\"}' "
                "WHEN 5 THEN '{\"line_items\": null}' "
                "WHEN 6 THEN '{\"invoice_date\": \"2026-8-2\"}' "
                "WHEN 7 THEN '{\"invoice_date\": \"2026-08-20T00:00:00\", \"due_date\": 86400}' "
                "WHEN 8 THEN '{\"currency\": \"TOO-LONG-CURRENCY\"}' "
                "WHEN 9 THEN '{\"total\": \"123456789012345.67\"}' "
                "WHEN 10 THEN '{\"subtotal\": \"1_000.005\", \"tax\": \" 2.675 \", "
                "\"vendor_name\": null}' "
                "WHEN 11 THEN '{\"total\": true}' "
                "WHEN 12 THEN CASE WHEN o_custkey % 2 = 0 THEN 'oops' ELSE '[1]' END "
                "WHEN 13 THEN '{\"line_items\": [{\"quantity\": \"x\"}]}' "
                "WHEN 14 THEN '{\"line_items\": [{\"quantity\": 1.00005, \"unit_price\": 2, "
                "\"amount\": -2.005}, {}], \"extra\": 1}' "
                "ELSE '{\"line_items\": [3]}' END",
}

UPLOADS = {
    "upload_id": "doc_id",
    "organization_id": "source",
    "user_id": "doc_id % 50",
    "filename": "CASE doc_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '   ' "
                "WHEN 2 THEN concat(repeat('a', 300), '.pdf') WHEN 3 THEN '../etc.pdf' "
                "WHEN 4 THEN 'a..b.pdf' WHEN 5 THEN concat(source, '/x.pdf') "
                "WHEN 6 THEN concat(lang, '.txt') "
                "ELSE concat('Scan ', CAST(doc_id AS STRING), '.PDF') END",
    "content_type": "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'text/html' END",
    "size_bytes": "CASE doc_id % 11 WHEN 0 THEN 0 WHEN 1 THEN 15728641 WHEN 2 THEN 15728640 "
                  "ELSE n_chars END",
    "header": "CASE WHEN doc_id % 7 = 0 THEN CAST('MZ' AS BINARY) "
              "ELSE CAST(concat('%PDF-', lang) AS BINARY) END",
}

# Prose as already extracted text
TEXTS = {
    "document_id": "doc_id",
    "organization_id": "source",
    "extracted_text_storage_key": "CASE WHEN doc_id % 31 = 0 THEN NULL "
                                  "ELSE concat(source, '/', CAST(doc_id AS STRING), "
                                  "'/extracted_text.txt') END",
    "text": "CASE WHEN doc_id % 37 = 1 THEN NULL WHEN doc_id % 41 = 2 "
            "THEN concat(chr(160), '  ') ELSE text END",
}

PAGES = {
    "document_id": "conv_id",
    "page_no": "CAST(turn AS INT)",
    "page_error": "(conv_id + turn) % 17 = 0",
    "text": "CASE WHEN (conv_id + turn) % 17 = 0 THEN NULL WHEN conv_id % 3 = 0 THEN ' ' "
            "ELSE text END",
}

IMAGE_TEXT = (
    "CASE WHEN conv_id % 15 = 6 THEN ' ' WHEN conv_id % 15 = 9 THEN 'unreadable' ELSE text END"
)

IMAGES = {
    "document_id": "conv_id",
    "page_no": "CAST(turn AS INT)",
    "page_error": "(conv_id * 7 + turn) % 41 = 0",
    "image": (
        f"CAST({IMAGE_TEXT} AS BINARY)",
        f"encode({IMAGE_TEXT})",
    ),
}

PAGE_DOCUMENTS = {
    "document_id": "conv_id",
    "organization_id": "conv_id % 20",
    "read_failed": "conv_id % 23 = 5",
    "open_failed": "conv_id % 29 = 7",
}

STORED = {"storage_key": "concat('html/', CAST(page_id * 3 AS STRING))",
          "length": ("octet_length(html)", "octet_length(encode(html))")}

JOBS = {
    "job_id": "event_id",
    "document_id": "CASE WHEN event_id % 89 = 5 THEN -event_id ELSE event_id - event_id % 4 END",
    "stage": "CASE event_type WHEN 'view' THEN 'TEXT_EXTRACTION' WHEN 'click' THEN 'OCR' "
             "WHEN 'purchase' THEN 'AI_EXTRACTION' WHEN 'signup' THEN 'RESULT_VALIDATION' "
             "ELSE 'CLEANUP' END",
    "status": "CASE WHEN value > 60 THEN 'FAILED' WHEN value < 1 THEN NULL ELSE 'SUCCESS' END",
    "error_category": "CASE WHEN value > 90 THEN 'NETWORK_ERROR' WHEN value > 60 "
                      "THEN 'PROCESSING_ERROR' END",
    "started_at": "CAST(ts AS TIMESTAMP)",
    "completed_at": (
        "timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) + "
        "CAST(CAST(value AS DECIMAL(14,2)) * 100 AS BIGINT) * 12347)",
        "make_timestamp(epoch_us(ts) + CAST(CAST(value AS DECIMAL(14,2)) * 100 AS BIGINT) * 12347)",
    ),
    "created_at": "CAST(ts AS TIMESTAMP)",
}


def spark_list(columns: dict) -> list[str]:
    return [f"{e[0] if isinstance(e, tuple) else e} AS {n}" for n, e in columns.items()]


def sql_list(columns: dict) -> str:
    return ",\n  ".join(
        f"{e[1] if isinstance(e, tuple) else e} AS {n}" for n, e in columns.items()
    )


def driver_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Scan one of the driver's tables with its known schema."""
    return spark.read.schema(DRIVER_TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def _scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return driver_table(spark, sf_dir, table)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _scan(spark, sf_dir, "orders")
    customers = _scan(spark, sf_dir, "customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left")


_SINGLE = {
    "organizations": ("nation", ORGANIZATIONS),
    "users": ("customer", USERS),
    "queue": ("orders", QUEUE),
    "lines": ("lineitem", LINES),
    "payloads": ("orders", PAYLOADS),
    "uploads": ("documents", UPLOADS),
    "texts": ("documents", TEXTS),
    "pages": ("conversations", PAGES),
    "images": ("conversations", IMAGES),
    "stored": ("pages", STORED),
    "jobs": ("events", JOBS),
}
_ORDERS_JOIN = "orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table as a DataFrame."""
    if name in _SINGLE:
        table, columns = _SINGLE[name]
        return _scan(spark, sf_dir, table).selectExpr(*spark_list(columns))
    if name == "documents":
        return _orders(spark, sf_dir).selectExpr(*spark_list(DOCUMENTS))
    if name == "invoices":
        return _orders(spark, sf_dir).selectExpr(*spark_list(INVOICES))
    if name in ("drafts", "owned_drafts"):
        # Orders of low priority have not been extracted yet
        drafted = _orders(spark, sf_dir).where("o_orderpriority <> '5-LOW'")
        owner = {"organization_id": DOCUMENTS["organization_id"]} if name != "drafts" else {}
        return drafted.selectExpr(*spark_list(INVOICES | owner))
    if name == "commands":
        raw = _scan(spark, sf_dir, "events").selectExpr(*spark_list(COMMANDS))
        owners = frame(spark, sf_dir, "documents").selectExpr(
            "document_id", "organization_id AS owner_id"
        )
        return raw.join(owners, "document_id", "left").selectExpr(
            *COMMANDS, f"{COMMAND_TENANT} AS organization_id"
        )
    if name == "page_documents":
        return _scan(spark, sf_dir, "conversations").select("conv_id").distinct().selectExpr(
            *spark_list(PAGE_DOCUMENTS)
        )
    raise KeyError(name)


def ctes(*names: str) -> str:
    """The same tables as a WITH list for the checking SQL (without WITH)."""
    out = []
    for name in names:
        if name in _SINGLE:
            table, columns = _SINGLE[name]
            body = f"SELECT {sql_list(columns)} FROM {table}"
        elif name == "documents":
            body = f"SELECT {sql_list(DOCUMENTS)} FROM {_ORDERS_JOIN}"
        elif name == "invoices":
            body = f"SELECT {sql_list(INVOICES)} FROM {_ORDERS_JOIN}"
        elif name == "drafts":
            body = f"SELECT {sql_list(INVOICES)} FROM {_ORDERS_JOIN} " \
                   "WHERE o_orderpriority <> '5-LOW'"
        elif name == "commands":
            picked = ", ".join(f"r.{n}" for n in COMMANDS)
            body = (
                f"SELECT {picked}, {COMMAND_TENANT} AS organization_id FROM "
                f"(SELECT {sql_list(COMMANDS)} FROM events) r LEFT JOIN "
                "(SELECT o_orderkey AS document_id, c_nationkey AS owner_id "
                f"FROM {_ORDERS_JOIN}) d ON d.document_id = r.document_id"
            )
        elif name == "page_documents":
            body = f"SELECT {sql_list(PAGE_DOCUMENTS)} FROM (SELECT DISTINCT conv_id " \
                   "FROM conversations)"
        else:
            raise KeyError(name)
        out.append(f"{_SQL_NAMES.get(name, name)} AS (\n  {body}\n)")
    return ",\n".join(out)


# Names that would hide one of the driver's tables inside their own definition
_SQL_NAMES = {"documents": "docs", "pages": "page_rows"}
