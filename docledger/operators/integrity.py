"""Integrity rules as violation reports and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import fixed
from docledger.functions.ids import derived_id


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; NULL keys never clash."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key; rows with a NULL key never clash and all stay. The minimum
    combines map-side, so a key with very many copies costs one row per task."""
    rest = [c for c in df.columns if c not in (key, *order)]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    firsts = (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(first)
        .select(key, "_first.*").select(*df.columns)
    )
    return firsts.unionByName(df.where(F.col(key).isNull()))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    present = child.where(F.col(key).isNotNull())
    parents = parent.select(F.col(parent_key).alias(key))
    return present.join(parents, key, "left_anti")


def orphan_report(links: dict[str, tuple[DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Rows (link, child_id, missing_key) over named foreign keys.

    Each link is (child, child id, key, parent, parent key).
    """
    out = None
    for name, (child, child_id, key, parent, parent_key) in links.items():
        rows = orphans(child.select(
            F.col(child_id).cast("string").alias("child_id"), F.col(key).alias("_key")
        ), "_key", parent, parent_key).select(
            F.lit(name).alias("link"), "child_id", F.col("_key").cast("string").alias("missing_key")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def cascade(removed_tenants: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What remains after deleting tenants, following ownership downwards."""
    gone = removed_tenants.select("organization_id")

    def without(child: DataFrame, key: str, keys: DataFrame) -> DataFrame:
        return child.join(keys.select(key), key, "left_anti")

    def lost(child: DataFrame, key: str, keys: DataFrame) -> DataFrame:
        return child.join(keys.select(key), key, "left_semi")

    documents = tables["documents"]
    lost_documents = lost(documents, "organization_id", gone)
    lost_invoices = lost(tables["invoices"], "document_id", lost_documents)
    return {
        "organizations": without(tables["organizations"], "organization_id", gone),
        "users": without(tables["users"], "organization_id", gone),
        "documents": without(documents, "organization_id", gone),
        "invoices": without(tables["invoices"], "document_id", lost_documents),
        "processing_jobs": without(tables["processing_jobs"], "document_id", lost_documents),
        "invoice_line_items": without(
            tables["invoice_line_items"], "invoice_id", lost_invoices
        ),
    }


def restricted_users(users: DataFrame, documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """Users that cannot be removed, with the counts that hold them."""
    def uses(df: DataFrame, column: str, role: str) -> DataFrame:
        return (
            df.where(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("user_id"))
            .agg(F.count("*").alias("n"))
            .withColumn("role", F.lit(role))
        )

    counts = (
        uses(documents, "uploaded_by_user_id", "uploaded")
        .unionByName(uses(invoices, "approved_by_user_id", "approved"))
        .unionByName(uses(invoices, "rejected_by_user_id", "rejected"))
        .groupBy("user_id")
        .agg(*[
            F.sum(F.when(F.col("role") == r, F.col("n")).otherwise(0)).cast("bigint")
            .alias(f"n_{r}")
            for r in ("uploaded", "approved", "rejected")
        ])
    )
    return users.select("user_id").join(counts, "user_id")


def enum_violations(rows: DataFrame, row_id: str, columns: dict[str, tuple[str, ...]],
                    required: tuple[str, ...]) -> DataFrame:
    """(row_id, column_name, value) where a value is outside its set or missing."""
    tests = []
    for name, allowed in columns.items():
        bad = ~F.col(name).isin(*allowed)
        if name in required:
            bad = F.col(name).isNull() | bad
        tests.append(F.when(bad, F.struct(
            F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value")
        )))
    return rows.select(
        F.col(row_id).alias("row_id"),
        F.inline(F.filter(F.array(*tests), lambda t: t.isNotNull())),
    )


def not_null_violations(rows: DataFrame, row_id: str, required: tuple[str, ...]) -> DataFrame:
    """(row_id, column_name) of every required value that is missing."""
    tests = [F.when(F.col(n).isNull(), F.lit(n)) for n in required]
    return rows.select(
        F.col(row_id).alias("row_id"),
        F.explode(F.array_compact(F.array(*tests))).alias("column_name"),
    )


REQUIRED = {
    "organizations": ("organization_id", "name"),
    "users": ("user_id", "organization_id", "email", "is_active"),
    "documents": ("document_id", "organization_id", "uploaded_by_user_id", "original_filename",
                  "storage_key", "content_type", "file_size_bytes", "status"),
    "invoices": ("invoice_id", "document_id"),
    "invoice_line_items": ("line_id", "invoice_id", "line_order"),
    "processing_jobs": ("job_id", "document_id", "stage", "status"),
}


DEFAULTS = {
    "documents": {"status": "UPLOADED"},
    "processing_jobs": {"status": "PENDING"},
    "invoice_line_items": {"line_order": 0},
    "users": {"is_active": True},
}


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill the column defaults of a table."""
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) for name, value in DEFAULTS[table].items()
    })


def for_tenant(documents: DataFrame, tenant: object) -> DataFrame:
    """Documents one tenant may see; prunes to its partition."""
    return documents.where(F.col("organization_id") == tenant)


def stamped(old: DataFrame, new: DataFrame, key: str, columns: list[str], now: Column) -> DataFrame:
    """Rows of `new` with created_at kept and updated_at moved where data changed.

    Rows unknown to `old` get both stamps. `now` is a literal of the run.
    """
    before = old.select(
        key,
        F.struct(*columns).alias("_before"),
        F.col("created_at").alias("_created"),
        F.col("updated_at").alias("_updated"),
    )
    same = F.col("_before").isNotNull() & F.struct(*columns).eqNullSafe(F.col("_before"))
    return new.join(before, key, "left").withColumns({
        "created_at": F.coalesce("_created", now),
        "updated_at": F.when(same, F.col("_updated")).otherwise(now),
    }).drop("_before", "_created", "_updated")


def register(requests: DataFrame, users: DataFrame) -> DataFrame:
    """New tenants and users for emails not yet registered, first request wins.

    `requests` has (email, requested_at, request_id). Refused emails are left
    out; an email asked for many times is registered once.
    """
    new = requests.join(users.select("email"), "email", "left_anti")
    first = new.groupBy("email").agg(
        F.min(F.struct("requested_at", "request_id"))["request_id"].alias("request_id")
    )
    return first.select(
        derived_id("organization", "email").alias("organization_id"),
        F.concat(F.col("email"), F.lit("'s Organization")).alias("organization_name"),
        derived_id("user", "email").alias("user_id"),
        "email",
        F.lit(True).alias("is_active"),
        "request_id",
    )


def document_enum_columns() -> dict[str, tuple[str, ...]]:
    return {"status": fixed.DOCUMENT_STATUSES}


def job_enum_columns() -> dict[str, tuple[str, ...]]:
    return {
        "stage": fixed.STAGES,
        "status": fixed.JOB_STATUSES,
        "error_category": fixed.ERROR_CATEGORIES,
    }
