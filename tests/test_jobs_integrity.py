from __future__ import annotations

from datetime import timedelta

import pytest
from builders import T0, build, document, documents, invoice, invoices, line, lines
from pyspark.sql import functions as F

from docledger import schemas
from docledger.operators import integrity, jobs
from docledger.sources.tables import append_table, read_table, replace_table


@pytest.mark.parametrize("micros", [0, 999, 1000, 1_234_567, 4_350_000, 57_010_000, 1_001_000,
                                    290_000, 580_000, 86_400_000_001])
def test_duration_is_cut_like_python(spark, micros):
    df = spark.createDataFrame([(T0, T0 + timedelta(microseconds=micros))],
                               "a timestamp, b timestamp")
    got = df.select(jobs.duration_ms(F.col("a"), F.col("b"))).first()[0]
    assert got == int(timedelta(microseconds=micros).total_seconds() * 1000)


def test_stage_jobs_and_failures_agree(spark):
    df = spark.createDataFrame(
        [("d1", "AI_EXTRACTION", None, None), ("d2", "AI_EXTRACTION", "AI_PROVIDER_ERROR", "m"),
         ("d3", "OCR", None, None)],
        "document_id string, stage string, error_category string, error_message string")
    start, end = F.lit(T0), F.lit(T0 + timedelta(seconds=2))
    log = jobs.stage_jobs(df, "run", start, end)
    rows = {r["document_id"]: r for r in log.collect()}
    assert rows["d1"]["provider_name"] == "anthropic" and rows["d1"]["status"] == "SUCCESS"
    assert rows["d2"]["provider_name"] is None and rows["d2"]["status"] == "FAILED"
    assert rows["d3"]["provider_name"] is None and rows["d3"]["duration_ms"] == 2000
    assert rows["d1"]["cost_usd"] is None
    failed = jobs.failed_documents(log).collect()
    assert [(r["document_id"], r["document_status"]) for r in failed] == [("d2", "FAILED")]
    again = jobs.stage_jobs(df, "run", start, end)
    assert {r["job_id"] for r in again.collect()} == {r["job_id"] for r in rows.values()}


def test_history_order(spark):
    rows = [{"job_id": k, "document_id": d, "created_at": T0 + timedelta(minutes=m)}
            for k, d, m in [("j3", "d1", 5), ("j2", "d1", 1), ("j1", "d1", 5), ("j0", "d2", 0)]]
    got = jobs.history(build(spark, schemas.JOBS, rows)).collect()
    assert [r["job_id"] for r in got] == ["j2", "j1", "j3", "j0"]


def test_duplicates_and_keep_first(spark):
    docs = documents(spark, *[
        document(k, storage_key=s, created_at=T0 + timedelta(minutes=m))
        for k, s, m in [("d1", "k", 5), ("d2", "k", 1), ("d3", "other", 0), ("d4", None, 0),
                        ("d5", None, 0)]])
    assert [tuple(r) for r in integrity.duplicates(docs, "storage_key").collect()] == [("k", 2)]
    kept = integrity.keep_first(docs, "storage_key", ["created_at", "document_id"])
    assert sorted(r["document_id"] for r in kept.collect()) == ["d2", "d3", "d4", "d5"]


def _tables(spark):
    return {
        "organizations": build(spark, schemas.ORGANIZATIONS, [
            {"organization_id": "a"}, {"organization_id": "b"}]),
        "users": build(spark, schemas.USERS, [
            {"user_id": "u1", "organization_id": "a", "email": "x@e"},
            {"user_id": "u2", "organization_id": "b", "email": "y@e"}]),
        "documents": documents(spark, document("d1", "a", uploaded_by_user_id="u1"),
                               document("d2", "b", uploaded_by_user_id="u9")),
        "invoices": invoices(spark, invoice("i1", approved_by_user_id="u1"), invoice("i2")),
        "invoice_line_items": lines(spark, line("l1", "i1"), line("l2", "i2"), line("l3", "i7")),
        "processing_jobs": build(spark, schemas.JOBS, [
            {"job_id": "j1", "document_id": "d1"}, {"job_id": "j2", "document_id": "d2"}]),
    }


def test_cascade_follows_ownership(spark):
    t = _tables(spark)
    left = integrity.cascade(t["organizations"].where("organization_id = 'a'"), t)
    assert {n: df.count() for n, df in left.items()} == {
        "organizations": 1, "users": 1, "documents": 1, "invoices": 1, "processing_jobs": 1,
        "invoice_line_items": 2}


def test_orphans_ignore_null_references(spark):
    t = _tables(spark)
    rows = integrity.orphan_report({
        "uploader": (t["documents"], "document_id", "uploaded_by_user_id", t["users"], "user_id"),
        "approver": (t["invoices"], "invoice_id", "approved_by_user_id", t["users"], "user_id"),
        "line": (t["invoice_line_items"], "line_id", "invoice_id", t["invoices"], "invoice_id"),
    }).collect()
    assert sorted(tuple(r) for r in rows) == [("line", "l3", "i7"), ("uploader", "d2", "u9")]


def test_restricted_users(spark):
    t = _tables(spark)
    rows = integrity.restricted_users(t["users"], t["documents"], t["invoices"]).collect()
    assert [tuple(r) for r in rows] == [("u1", 1, 1, 0)]


def test_enums_and_defaults(spark):
    rows = build(spark, schemas.JOBS, [
        {"job_id": "j1", "document_id": "d", "stage": "OCR", "status": None},
        {"job_id": "j2", "document_id": "d", "stage": "ocr", "status": "FAILED",
         "error_category": "OTHER"}])
    bad = integrity.enum_violations(rows, "job_id", integrity.job_enum_columns(),
                                    required=("stage", "status")).collect()
    assert sorted((r["row_id"], r["column_name"], r["value"]) for r in bad) == [
        ("j1", "status", None), ("j2", "error_category", "OTHER"), ("j2", "stage", "ocr")]
    filled = integrity.with_defaults(rows, "processing_jobs").collect()
    assert {r["status"] for r in filled} == {"PENDING", "FAILED"}


def test_missing_values_are_named(spark):
    rows = documents(spark, document("d1", storage_key="k"), document("d2", None, status=None))
    found = integrity.not_null_violations(
        rows, "document_id", ("organization_id", "status", "storage_key")).collect()
    assert sorted(tuple(r) for r in found) == [
        ("d2", "organization_id"), ("d2", "status"), ("d2", "storage_key")]


def test_a_table_is_replaced_by_rows_read_from_it(spark, tmp_path):
    root = str(tmp_path)
    docs = documents(spark, document("d1", "a"), document("d2", "b", status="FAILED"))
    replace_table(docs, root, "documents")
    stored = read_table(spark, root, "documents")
    replace_table(stored.withColumn("status", F.lit("APPROVED")), root, "documents")
    again = read_table(spark, root, "documents").select("document_id", "status").collect()
    assert sorted(map(tuple, again)) == [("d1", "APPROVED"), ("d2", "APPROVED")]
    assert [p.name for p in tmp_path.iterdir()] == ["documents"]


def test_stamps_move_only_with_the_data(spark):
    old = documents(spark, document("d1", created_at=T0, updated_at=T0),
                    document("d2", created_at=T0, updated_at=T0))
    new = spark.createDataFrame([("d1", "REVIEW_REQUIRED"), ("d2", "APPROVED"), ("d3", "FAILED")],
                                "document_id string, status string")
    now = T0 + timedelta(days=1)
    rows = {r["document_id"]: (r["created_at"], r["updated_at"]) for r in integrity.stamped(
        old, new, "document_id", ["status"], F.lit(now)).collect()}
    assert rows == {"d1": (T0, T0), "d2": (T0, now), "d3": (now, now)}


def test_register_once_per_new_email(spark):
    asked = spark.createDataFrame(
        [("x@e", 1, "r1"), ("n@e", 3, "r2"), ("n@e", 2, "r3")],
        "email string, requested_at int, request_id string")
    rows = integrity.register(asked, _tables(spark)["users"]).collect()
    assert [(r["email"], r["request_id"], r["organization_name"]) for r in rows] == [
        ("n@e", "r3", "n@e's Organization")]


def test_tenant_reads_prune_their_partition(spark, tmp_path):
    append_table(_tables(spark)["documents"], str(tmp_path), "documents")
    docs = read_table(spark, str(tmp_path), "documents")
    own = integrity.for_tenant(docs, "a").where("status = 'REVIEW_REQUIRED'")
    assert [r["document_id"] for r in own.collect()] == ["d1"]
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(organization_id" in plan
    assert "EqualTo(status,REVIEW_REQUIRED)" in plan
