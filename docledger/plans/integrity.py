"""Queries over integrity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger import fixed
from docledger.operators import integrity
from docledger.plans.shown import shown, text_sql
from docledger.plans.standins import ctes, frame
from docledger.plans.uploads import id_sql

RUN_TIME = "2024-06-01 12:00:00"
REMOVED_TENANTS = (3, 7, 11)
TENANT = 4


def dup_storage_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicates(frame(spark, sf_dir, "documents"), "storage_key")


def first_storage_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay when a storage key may be used once."""
    documents = frame(spark, sf_dir, "documents")
    first = integrity.keep_first(documents, "storage_key", ["created_at", "document_id"])
    return first.select("document_id", "storage_key", "status")


def _per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice rows competing for one document per customer."""
    return frame(spark, sf_dir, "documents").select(
        F.col("uploaded_by_user_id").alias("document_id"),
        F.col("document_id").alias("invoice_id"), "created_at",
    )


def dup_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _per_customer(spark, sf_dir)
    first = integrity.keep_first(rows, "document_id", ["created_at", "invoice_id"])
    return integrity.duplicates(rows, "document_id").join(
        first.select("document_id", F.col("invoice_id").alias("kept_invoice_id")), "document_id"
    )


def dup_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicates(frame(spark, sf_dir, "users"), "email")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {n: frame(spark, sf_dir, n) for n in ("organizations", "users", "documents")}
    tables["invoices"] = frame(spark, sf_dir, "invoices")
    tables["invoice_line_items"] = frame(spark, sf_dir, "lines")
    tables["processing_jobs"] = frame(spark, sf_dir, "jobs")
    return tables


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    users, documents, invoices = t["users"], t["documents"], t["invoices"]
    return integrity.orphan_report({
        "user organization": (users, "user_id", "organization_id",
                              t["organizations"], "organization_id"),
        "document organization": (documents, "document_id", "organization_id",
                                  t["organizations"], "organization_id"),
        "document uploader": (documents, "document_id", "uploaded_by_user_id", users, "user_id"),
        "invoice document": (invoices, "invoice_id", "document_id", documents, "document_id"),
        "invoice approver": (invoices, "invoice_id", "approved_by_user_id", users, "user_id"),
        "invoice rejecter": (invoices, "invoice_id", "rejected_by_user_id", users, "user_id"),
        "line invoice": (t["invoice_line_items"], "line_id", "invoice_id",
                         invoices, "invoice_id"),
        "job document": (t["processing_jobs"], "job_id", "document_id",
                         documents, "document_id"),
    })


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    removed = t["organizations"].where(F.col("organization_id").isin(*REMOVED_TENANTS))
    left = integrity.cascade(removed, t)
    counts = [
        rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, rows in left.items()
    ]
    out = counts[0]
    for count in counts[1:]:
        out = out.unionByName(count)
    return out


def restrict_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.restricted_users(
        frame(spark, sf_dir, "users"), frame(spark, sf_dir, "documents"),
        frame(spark, sf_dir, "invoices"),
    )


def enum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.enum_violations(
        frame(spark, sf_dir, "jobs"), "job_id", integrity.job_enum_columns(),
        required=("stage", "status"),
    )


def document_enum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued documents under a status that is no document status."""
    rows = frame(spark, sf_dir, "queue").withColumn(
        "status", F.when(F.col("document_id") % 50 == 0, F.lower("status"))
        .when(F.col("document_id") % 50 != 1, F.col("status")))
    return integrity.enum_violations(
        rows, "document_id", integrity.document_enum_columns(), required=("status",))


def null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required values that are missing, over tables with gaps."""
    jobs = frame(spark, sf_dir, "jobs")
    users = frame(spark, sf_dir, "users")
    uploads = frame(spark, sf_dir, "uploads").select(
        F.col("upload_id").alias("document_id"), "organization_id",
        F.col("user_id").alias("uploaded_by_user_id"),
        F.col("filename").alias("original_filename"),
        F.col("filename").alias("storage_key"), "content_type",
        F.col("size_bytes").alias("file_size_bytes"), F.lit("UPLOADED").alias("status"))
    out = None
    for name, rows, key in (("processing_jobs", jobs, "job_id"), ("users", users, "user_id"),
                            ("documents", uploads, "document_id")):
        found = integrity.not_null_violations(rows, key, integrity.REQUIRED[name]).select(
            F.lit(name).alias("table_name"), "row_id", "column_name")
        out = found if out is None else out.unionByName(found)
    return out


def column_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = integrity.with_defaults(frame(spark, sf_dir, "jobs"), "processing_jobs")
    users = integrity.with_defaults(frame(spark, sf_dir, "users"), "users")
    return jobs.select(
        F.lit("job").alias("kind"), F.col("job_id").alias("row_id"),
        F.col("status").alias("value"),
    ).unionByName(users.select(
        F.lit("user").alias("kind"), F.col("user_id").alias("row_id"),
        F.col("is_active").cast("string").alias("value"),
    ))


def tenant_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = integrity.for_tenant(frame(spark, sf_dir, "documents"), TENANT)
    return own.select("document_id", "organization_id", "status")


def stamped_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after every rejected one was reopened for review."""
    old = frame(spark, sf_dir, "documents").withColumn("updated_at", F.col("created_at"))
    status = F.when(F.col("status") == "REJECTED", "REVIEW_REQUIRED").otherwise(F.col("status"))
    new = old.select("document_id", status.alias("status"))
    now = F.lit(RUN_TIME).cast("timestamp")
    return shown(integrity.stamped(old, new, "document_id", ["status"], now))


def register_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up events ask for emails, some known, many asked for repeatedly."""
    asked = frame(spark, sf_dir, "commands").select(
        F.concat(F.lit("user"), (F.col("user_id") * 20).cast("string"), F.lit("@example.com"))
        .alias("email"),
        F.col("issued_at").alias("requested_at"),
        F.col("command_id").alias("request_id"),
    )
    return integrity.register(asked, frame(spark, sf_dir, "users"))


def _orphan_sql(
    link: str, child: str, child_id: str, key: str, parent: str, parent_key: str
) -> str:
    return (
        f"SELECT '{link}' AS link, CAST({child_id} AS VARCHAR) AS child_id, "
        f"CAST({key} AS VARCHAR) AS missing_key FROM {child} c WHERE {key} IS NOT NULL AND "
        f"NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{key})"
    )


_GONE = ", ".join(str(t) for t in REMOVED_TENANTS)
_FIRST = "row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n"

QUERIES = {
    "dup_storage_key": dup_storage_key,
    "first_storage_key": first_storage_key,
    "dup_invoice": dup_invoice,
    "dup_email": dup_email,
    "orphans": orphans,
    "cascade_delete": cascade_delete,
    "restrict_delete": restrict_delete,
    "enum_violations": enum_violations,
    "document_enum_violations": document_enum_violations,
    "null_violations": null_violations,
    "column_defaults": column_defaults,
    "tenant_isolation": tenant_isolation,
    "stamped_updates": stamped_updates,
    "register_batch": register_batch,
}

ORACLES = {
    "dup_storage_key": f"""WITH {ctes('documents')}
SELECT storage_key, count(*) AS n_rows FROM docs GROUP BY storage_key HAVING count(*) > 1""",
    "first_storage_key": f"""WITH {ctes('documents')}
SELECT document_id, storage_key, status FROM (SELECT *,
  {_FIRST.format(key='storage_key', order='created_at, document_id')} FROM docs) WHERE n = 1""",
    "dup_invoice": f"""WITH {ctes('documents')}
SELECT uploaded_by_user_id AS document_id, count(*) AS n_rows,
  arg_min(document_id, (created_at, document_id)) AS kept_invoice_id
FROM docs GROUP BY uploaded_by_user_id HAVING count(*) > 1""",
    "dup_email": f"""WITH {ctes('users')}
SELECT email, count(*) AS n_rows FROM users GROUP BY email HAVING count(*) > 1""",
    "orphans": f"WITH {ctes('organizations', 'users', 'documents', 'invoices', 'lines', 'jobs')} "
    + "\nUNION ALL\n".join([
        _orphan_sql("user organization", "users", "user_id", "organization_id",
                    "organizations", "organization_id"),
        _orphan_sql("document organization", "docs", "document_id", "organization_id",
                    "organizations", "organization_id"),
        _orphan_sql("document uploader", "docs", "document_id", "uploaded_by_user_id",
                    "users", "user_id"),
        _orphan_sql("invoice document", "invoices", "invoice_id", "document_id",
                    "docs", "document_id"),
        _orphan_sql("invoice approver", "invoices", "invoice_id", "approved_by_user_id",
                    "users", "user_id"),
        _orphan_sql("invoice rejecter", "invoices", "invoice_id", "rejected_by_user_id",
                    "users", "user_id"),
        _orphan_sql("line invoice", "lines", "line_id", "invoice_id", "invoices", "invoice_id"),
        _orphan_sql("job document", "jobs", "job_id", "document_id", "docs", "document_id"),
    ]),
    "cascade_delete": f"""WITH {ctes('organizations', 'users', 'documents', 'invoices', 'lines',
                                     'jobs')},
lost AS (SELECT document_id FROM docs WHERE organization_id IN ({_GONE})),
lost_invoices AS (SELECT invoice_id FROM invoices WHERE document_id IN (FROM lost))
SELECT 'organizations' AS table_name, count(*) AS n_rows FROM organizations
  WHERE organization_id NOT IN ({_GONE})
UNION ALL SELECT 'users', count(*) FROM users WHERE organization_id NOT IN ({_GONE})
UNION ALL SELECT 'documents', count(*) FROM docs WHERE organization_id NOT IN ({_GONE})
UNION ALL SELECT 'invoices', count(*) FROM invoices WHERE document_id NOT IN (FROM lost)
UNION ALL SELECT 'processing_jobs', count(*) FROM jobs WHERE document_id NOT IN (FROM lost)
UNION ALL SELECT 'invoice_line_items', count(*) FROM lines
  WHERE invoice_id NOT IN (FROM lost_invoices)""",
    "restrict_delete": f"""WITH {ctes('users', 'documents', 'invoices')},
uses AS (
  SELECT uploaded_by_user_id AS user_id, 1 AS u, 0 AS a, 0 AS r FROM docs
  UNION ALL SELECT approved_by_user_id, 0, 1, 0 FROM invoices
  UNION ALL SELECT rejected_by_user_id, 0, 0, 1 FROM invoices
)
SELECT user_id, CAST(sum(u) AS BIGINT) AS n_uploaded, CAST(sum(a) AS BIGINT) AS n_approved,
  CAST(sum(r) AS BIGINT) AS n_rejected
FROM uses WHERE user_id IN (SELECT user_id FROM users) GROUP BY user_id""",
    "enum_violations": f"""WITH {ctes('jobs')}
SELECT job_id AS row_id, 'stage' AS column_name, stage AS value FROM jobs
  WHERE stage IS NULL OR stage NOT IN {fixed.STAGES}
UNION ALL SELECT job_id, 'status', status FROM jobs
  WHERE status IS NULL OR status NOT IN {fixed.JOB_STATUSES}
UNION ALL SELECT job_id, 'error_category', error_category FROM jobs
  WHERE error_category NOT IN {fixed.ERROR_CATEGORIES}""",
    "document_enum_violations": f"""WITH {ctes('queue')},
rows AS (SELECT document_id, CASE WHEN document_id % 50 = 0 THEN lower(status)
  WHEN document_id % 50 <> 1 THEN status END AS value FROM queue)
SELECT document_id AS row_id, 'status' AS column_name, value FROM rows
WHERE value IS NULL OR value NOT IN ('UPLOADED', 'VALIDATING', 'STORED', 'EXTRACTING_TEXT',
  'TEXT_EXTRACTED', 'OCR_REQUIRED', 'OCR_PROCESSING', 'AI_PROCESSING', 'VALIDATING_RESULT',
  'REVIEW_REQUIRED', 'APPROVED', 'REJECTED', 'FAILED')""",
    "null_violations": f"""WITH {ctes('jobs', 'users', 'uploads')},
found AS (
  SELECT 'processing_jobs' AS table_name, job_id AS row_id, unnest(['job_id', 'document_id', 'stage',
    'status']) AS column_name, unnest([job_id IS NULL, document_id IS NULL, stage IS NULL,
    status IS NULL]) AS missing FROM jobs
  UNION ALL SELECT 'users', user_id, unnest(['user_id', 'organization_id', 'email', 'is_active']),
    unnest([user_id IS NULL, organization_id IS NULL, email IS NULL, is_active IS NULL]) FROM users
  UNION ALL SELECT 'documents', upload_id, unnest(['document_id', 'organization_id',
    'uploaded_by_user_id', 'original_filename', 'storage_key', 'content_type', 'file_size_bytes']),
    unnest([upload_id IS NULL, organization_id IS NULL, user_id IS NULL, filename IS NULL,
    filename IS NULL, content_type IS NULL, size_bytes IS NULL]) FROM uploads
)
SELECT table_name, row_id, column_name FROM found WHERE missing""",
    "column_defaults": f"""WITH {ctes('jobs', 'users')}
SELECT 'job' AS kind, job_id AS row_id, coalesce(status, 'PENDING') AS value FROM jobs
UNION ALL SELECT 'user', user_id, CAST(coalesce(is_active, true) AS VARCHAR) FROM users""",
    "tenant_isolation": f"""WITH {ctes('documents')}
SELECT document_id, organization_id, status FROM docs WHERE organization_id = {TENANT}""",
    "stamped_updates": f"""WITH {ctes('documents')}
SELECT document_id, CASE status WHEN 'REJECTED' THEN 'REVIEW_REQUIRED' ELSE status END AS status,
  {text_sql('created_at')}, CASE status WHEN 'REJECTED' THEN '{RUN_TIME}'
    ELSE CAST(created_at AS VARCHAR) END AS updated_at FROM docs""",
    "register_batch": f"""WITH {ctes('commands', 'users')},
asked AS (SELECT concat('user', CAST(user_id * 20 AS VARCHAR), '@example.com') AS email,
  issued_at, command_id FROM commands)
SELECT {id_sql('organization', 'email')} AS organization_id,
  email || '''s Organization' AS organization_name, {id_sql('user', 'email')} AS user_id,
  email, true AS is_active, arg_min(command_id, (issued_at, command_id)) AS request_id
FROM asked WHERE email NOT IN (SELECT email FROM users) GROUP BY email""",
}
