"""Queries over review commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger import fixed
from docledger.operators import findings, review
from docledger.plans.extraction import parsed_sql
from docledger.plans.findings import (
    LINES_SQL,
    NO_LINES_SQL,
    NUMBERED_SQL,
    TOTAL_SQL,
    VERDICT_SQL,
    missing_sql,
)
from docledger.plans.shown import shown, text_sql
from docledger.plans.standins import ctes, frame
from docledger.plans.uploads import chars_sql, id_sql
from docledger.sources.workspace import persisted


def _frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: frame(spark, sf_dir, n) for n in ("commands", "documents", "drafts", "lines")}


def _outcomes(
    spark: SparkSession, sf_dir: str, keep: bool = False
) -> tuple[DataFrame, dict[str, DataFrame]]:
    f = _frames(spark, sf_dir)
    outcomes = review.command_outcomes(f["commands"], f["documents"], f["drafts"], f["lines"])
    return (persisted(outcomes, "outcomes") if keep else outcomes), f


def tenant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    return review.tenant_lookup(f["commands"], f["documents"]).select(
        "command_id", "document_id", "lookup", "status"
    )


def review_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    return shown(review.review_view(f["documents"], f["drafts"], f["lines"]).select(
        "document_id", "organization_id", "status", "view", *fixed.HEADER_FIELDS,
        "approved_at", "n_errors", "n_warnings", "is_valid", "requires_review",
    ))


def review_view_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    return shown(review.review_lines(f["documents"], f["drafts"], f["lines"]).select(
        "document_id", "organization_id", "line_index", "line_id", "line_order", "description",
        "quantity", "unit_price", "amount"))


def review_view_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    return review.review_findings(f["documents"], f["drafts"], f["lines"])


def command_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a whole batch of commands decides, per document."""
    outcomes, _ = _outcomes(spark, sf_dir)
    return shown(review.decisions(outcomes))


def command_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, _ = _outcomes(spark, sf_dir)
    return outcomes.select("command_id", "document_id", "kind", "outcome")


def patch_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, f = _outcomes(spark, sf_dir)
    return shown(review.patched_headers(f["drafts"], outcomes).select(
        "invoice_id", *fixed.HEADER_FIELDS
    ))


def patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, f = _outcomes(spark, sf_dir, keep=True)
    return shown(review.patched_lines(f["lines"], f["drafts"], outcomes))


def patch_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, f = _outcomes(spark, sf_dir, keep=True)
    headers = review.patched_headers(f["drafts"], outcomes)
    lines = review.patched_lines(f["lines"], f["drafts"], outcomes)
    edited = review.saved_edits(outcomes).select("document_id").distinct()
    rated = findings.with_verdict(headers.join(edited, "document_id", "left_semi"), lines)
    return rated.select("invoice_id", "n_errors", "n_warnings", "is_valid", "requires_review")


def patch_findings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the edited drafts after the edits."""
    outcomes, f = _outcomes(spark, sf_dir, keep=True)
    edited = review.saved_edits(outcomes).select("document_id").distinct()
    drafts = persisted(f["drafts"].join(edited, "document_id", "left_semi"), "edited-drafts")
    own = f["lines"].join(drafts.select("invoice_id"), "invoice_id", "left_semi")
    headers = persisted(review.patched_headers(drafts, outcomes), "patched")
    lines = persisted(review.patched_lines(own, drafts, outcomes), "patched")
    return findings.all_findings(headers, lines)


def patch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all drafts after two batches of edits, from counts that are kept.

    Lines are counted once, before the edits; after that only the lines that an edit
    takes away or brings are looked at. Drafts that no command names stay as they are.
    """
    f = _frames(spark, sf_dir)
    counts = persisted(findings.line_totals(f["lines"]), "counts")
    named = persisted(f["commands"].select("document_id").distinct(), "named")
    documents = persisted(f["documents"].join(named, "document_id", "left_semi").select(
        "document_id", "organization_id", "status"), "named-documents")
    # Only drafts under review can be edited.
    waiting = documents.where(F.col("status") == review.OPEN_STATUS)
    headers = persisted(f["drafts"].join(waiting, "document_id", "left_semi").select(
        "invoice_id", "document_id", *fixed.HEADER_FIELDS), "named-drafts")
    own = persisted(headers.select("invoice_id"), "named-invoices")
    lines = persisted(f["lines"].join(own, "invoice_id", "left_semi"), "named-lines")
    first, last = f["commands"].agg(F.min("issued_at"), F.max("issued_at")).first()
    late = F.col("issued_at") > F.lit(first and first + (last - first) / 2).cast("timestamp")
    changes = []
    for batch in (f["commands"].where(~late), f["commands"].where(late)):
        outcomes = persisted(review.command_outcomes(batch, documents, headers, lines), "outcomes")
        removed, added = (persisted(x, "lines") for x in review.line_changes(lines, headers, outcomes))
        changes.append(findings.count_changes(removed, added))
        lines = persisted(review.patched_lines(lines, headers, outcomes), "patched")
        headers = persisted(review.patched_headers(headers, outcomes), "patched")
        documents = persisted(review.decided_documents(documents, outcomes), "decided")
    summed = persisted(changes[0].unionByName(changes[1]).groupBy("invoice_id").agg(
        F.sum("n_lines").alias("n_lines"), F.sum("n_bad_lines").alias("n_bad_lines")), "changes")
    new = findings.changed_counts(counts, summed)
    counts = counts.join(summed, "invoice_id", "left_anti").unionByName(new)
    untouched = f["drafts"].join(own, "invoice_id", "left_anti").select(*headers.columns)
    return findings.with_counted_verdict(untouched.unionByName(headers), counts).select(
        "invoice_id", "n_errors", "n_warnings", "is_valid", "requires_review")


def decided_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, f = _outcomes(spark, sf_dir)
    return shown(review.decided_invoices(f["drafts"], outcomes).select(
        "invoice_id", "approved_at", "approved_by_user_id", "rejected_at",
        "rejected_by_user_id", "rejection_reason"))


def _of_kind(
    spark: SparkSession, sf_dir: str, kind: str, keep: bool = False
) -> tuple[DataFrame, dict[str, DataFrame]]:
    f = _frames(spark, sf_dir)
    batch = f["commands"].where(F.col("kind") == kind)
    outcomes = review.command_outcomes(batch, f["documents"], f["drafts"], f["lines"])
    return (persisted(outcomes, "outcomes") if keep else outcomes), f


def approve_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, _ = _of_kind(spark, sf_dir, "APPROVE")
    return shown(review.decisions(outcomes).select(
        "document_id", "status", "approved_at", "approved_by_user_id"
    ))


def approve_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of each blocked approval, of the draft as it met it."""
    outcomes, f = _outcomes(spark, sf_dir, keep=True)
    return review.blocked_command_findings(outcomes, f["drafts"], f["lines"])


def approve_blocked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the first blocked approval of each document."""
    outcomes, f = _outcomes(spark, sf_dir, keep=True)
    return review.blocked_findings(outcomes, f["drafts"], f["lines"])


def reject_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, _ = _of_kind(spark, sf_dir, "REJECT", keep=True)
    return shown(outcomes.join(
        review.decisions(outcomes).select(
            "document_id", "rejected_at", "rejected_by_user_id", "rejection_reason"
        ),
        "document_id", "left",
    ).select(
        "command_id", "document_id", "outcome", "rejected_at", "rejected_by_user_id",
        "rejection_reason",
    ))


def outcomes_sql(kinds: str = "'EDIT', 'APPROVE', 'REJECT'") -> str:
    """CTEs up to `outcomes`, carrying edited amounts along each document."""
    parsed = parsed_sql("batch", "patch", "command_id", null_lines_ok=True)
    def carried(name: str, value: str) -> str:
        return f"last_value({value} IGNORE NULLS) OVER w AS {name}"

    def named(name: str) -> str:
        return (f"CASE WHEN saves AND list_contains(keys, '{name}') "
                f"THEN struct_pack(v := {name}) END")

    carry = ", ".join([carried(f"set_{n}", named(n)) for n in fixed.MONEY_FIELDS])
    now = {n: f"CASE WHEN set_{n} IS NOT NULL THEN set_{n}.v ELSE base_{n} END"
           for n in fixed.MONEY_FIELDS}
    return f"""{ctes('commands', 'documents', 'drafts', 'lines')},
batch AS (SELECT * FROM commands WHERE kind IN ({kinds})),
{parsed},
new_lines AS (
  SELECT raw_id, bool_or(coalesce(abs(quantity * unit_price - amount) > 0.01, false)) AS off
  FROM parsed_items GROUP BY raw_id
),
base AS (
  SELECT d.document_id, d.organization_id AS owner, d.status, i.invoice_id,
    i.subtotal AS base_subtotal, i.tax AS base_tax, i.total AS base_total,
    coalesce(b.n_bad, 0) > 0 AS base_off
  FROM docs d LEFT JOIN drafts i ON i.document_id = d.document_id
  LEFT JOIN (SELECT invoice_id, count(*) AS n_bad FROM lines
    WHERE abs(quantity * unit_price - amount) > 0.01 GROUP BY invoice_id) b
    ON b.invoice_id = i.invoice_id
),
checked AS (
  SELECT p.*, b.owner, b.status, b.invoice_id, base_subtotal, base_tax, base_total, base_off,
    coalesce(n.off, false) AS new_off,
    CASE WHEN json_valid(patch) AND json_type(CAST(patch AS JSON)) = 'OBJECT'
      THEN json_keys(CAST(patch AS JSON)) ELSE [] END AS keys,
    (kind = 'EDIT' AND schema_bad) OR (kind = 'REJECT' AND (reason IS NULL
      OR length(reason) < 1 OR length(reason) > 2000 OR {chars_sql('reason')} = 0)) AS invalid,
    kind = 'EDIT' AND limits_bad AS unfit,
    coalesce(b.owner = p.organization_id, false) AS found
  FROM parsed p LEFT JOIN base b ON b.document_id = p.document_id
  LEFT JOIN new_lines n ON n.raw_id = p.command_id
),
able AS (
  SELECT *, NOT invalid AND found AND status = 'REVIEW_REQUIRED' AND invoice_id IS NOT NULL
    AS eligible,
    NOT invalid AND found AND status = 'REVIEW_REQUIRED' AND invoice_id IS NOT NULL
      AND kind = 'EDIT' AND NOT unfit AS saves
  FROM checked
),
moved AS (
  SELECT *, {carry},
    last_value(CASE WHEN saves AND list_contains(keys, 'line_items') THEN new_off END
      IGNORE NULLS) OVER w AS set_off
  FROM able
  WINDOW w AS (PARTITION BY document_id ORDER BY issued_at, command_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
rated AS (
  SELECT *, coalesce(abs({now['subtotal']} + {now['tax']} - ({now['total']})) > 0.01, false)
    OR coalesce(set_off, base_off, false) AS has_errors FROM moved
),
first_decision AS (
  SELECT document_id, min((issued_at, command_id)) AS decided FROM rated
  WHERE eligible AND (kind = 'REJECT' OR (kind = 'APPROVE' AND NOT has_errors))
  GROUP BY document_id
),
outcomes AS (
  SELECT r.*, CASE WHEN invalid THEN 'INVALID' WHEN NOT found THEN 'NOT_FOUND'
    WHEN status <> 'REVIEW_REQUIRED' OR coalesce((issued_at, command_id) > f.decided, false)
      THEN 'CONFLICT'
    WHEN invoice_id IS NULL THEN 'MISSING_DRAFT'
    WHEN kind = 'APPROVE' AND has_errors THEN 'BLOCKED'
    WHEN unfit THEN 'SAVE_FAILED' ELSE 'OK' END AS outcome
  FROM rated r LEFT JOIN first_decision f ON f.document_id = r.document_id
)"""


_LAST_SET = """last_sets AS (
  SELECT document_id, {fields} FROM outcomes WHERE outcome = 'OK' AND kind = 'EDIT'
  GROUP BY document_id
),
patched AS (
  SELECT i.invoice_id, i.document_id, {picks}
  FROM drafts i LEFT JOIN last_sets s ON s.document_id = i.document_id
)""".format(
    fields=", ".join(
        f"arg_max(struct_pack(v := {n}), (issued_at, command_id)) "
        f"FILTER (WHERE list_contains(keys, '{n}')) AS last_{n}" for n in fixed.HEADER_FIELDS
    ),
    picks=", ".join(
        f"CASE WHEN last_{n} IS NOT NULL THEN last_{n}.v ELSE i.{n} END AS {n}"
        for n in fixed.HEADER_FIELDS
    ),
)

_NEW_LINES = f"""replaced AS (
  SELECT o.document_id, i.invoice_id, arg_max(command_id, (issued_at, command_id)) AS command_id
  FROM outcomes o JOIN drafts i ON i.document_id = o.document_id
  WHERE outcome = 'OK' AND kind = 'EDIT' AND list_contains(keys, 'line_items')
  GROUP BY o.document_id, i.invoice_id
),
patched_lines AS (
  SELECT CAST(line_id AS VARCHAR) AS line_id, invoice_id, line_order, description, quantity,
    unit_price, amount FROM lines
  WHERE invoice_id NOT IN (SELECT invoice_id FROM replaced)
  UNION ALL
  SELECT {id_sql('edited-line', 'invoice_id', 'line_order')}, invoice_id, line_order,
    description, quantity, unit_price, amount
  FROM replaced r JOIN parsed_items p ON p.raw_id = r.command_id
)"""

_DECISIONS = """decisions AS (
  SELECT document_id, CASE kind WHEN 'APPROVE' THEN 'APPROVED' ELSE 'REJECTED' END AS status,
    CASE WHEN kind = 'APPROVE' THEN issued_at END AS approved_at,
    CASE WHEN kind = 'APPROVE' THEN user_id END AS approved_by_user_id,
    CASE WHEN kind = 'REJECT' THEN issued_at END AS rejected_at,
    CASE WHEN kind = 'REJECT' THEN user_id END AS rejected_by_user_id,
    CASE WHEN kind = 'REJECT' THEN reason END AS rejection_reason
  FROM outcomes WHERE outcome = 'OK' AND kind <> 'EDIT'
)"""

_ALL_FINDINGS = "\nUNION ALL\n".join([missing_sql(), NO_LINES_SQL, TOTAL_SQL, LINES_SQL])

QUERIES = {
    "tenant_lookup": tenant_lookup,
    "review_view": review_view,
    "command_fold": command_fold,
    "command_outcome": command_outcome,
    "patch_scalars": patch_scalars,
    "patch_lines": patch_lines,
    "patch_findings": patch_findings,
    "patch_verdicts": patch_verdicts,
    "patch_findings_rows": patch_findings_rows,
    "review_view_lines": review_view_lines,
    "review_view_findings": review_view_findings,
    "decided_invoices": decided_invoices,
    "approve_batch": approve_batch,
    "approve_blocked": approve_blocked,
    "approve_blocked_documents": approve_blocked_documents,
    "reject_batch": reject_batch,
}

DECISIONS_SQL = f"""WITH {outcomes_sql()}, {_DECISIONS}
SELECT document_id, status, {text_sql('approved_at')}, approved_by_user_id,
  {text_sql('rejected_at')}, rejected_by_user_id, rejection_reason FROM decisions"""

ORACLES = {
    "tenant_lookup": f"""WITH {ctes('commands', 'documents')}
SELECT command_id, c.document_id, CASE WHEN d.document_id IS NULL THEN 'NOT_FOUND' ELSE 'OK' END
  AS lookup, d.status FROM commands c LEFT JOIN docs d
  ON d.document_id = c.document_id AND d.organization_id = c.organization_id""",
    "review_view": f"""WITH {ctes('documents', 'drafts', 'lines')},
{VERDICT_SQL.replace("FROM invoices i", "FROM drafts i")}
SELECT d.document_id, d.organization_id, d.status,
  CASE WHEN i.invoice_id IS NULL THEN 'MISSING_DRAFT' ELSE 'OK' END AS "view",
  {text_sql(*[f'i.{n}' for n in fixed.HEADER_FIELDS], 'i.approved_at')},
  n_errors, n_warnings, n_errors = 0 AS is_valid,
  n_errors > 0 OR n_warnings > 0 AS requires_review
FROM docs d LEFT JOIN drafts i ON i.document_id = d.document_id
LEFT JOIN verdicts v ON v.invoice_id = i.invoice_id""",
    "command_fold": DECISIONS_SQL,
    "command_outcome": f"""WITH {outcomes_sql()}
SELECT command_id, document_id, kind, outcome FROM outcomes""",
    "patch_scalars": f"""WITH {outcomes_sql()}, {_LAST_SET}
SELECT invoice_id, {text_sql(*fixed.HEADER_FIELDS)} FROM patched""",
    "patch_lines": f"""WITH {outcomes_sql()}, {_NEW_LINES}
SELECT line_id, invoice_id, line_order, description,
  {text_sql('quantity', 'unit_price', 'amount')} FROM patched_lines""",
    "patch_findings": f"""WITH {outcomes_sql()}, {_LAST_SET}, {_NEW_LINES},
edited AS (SELECT * FROM patched WHERE document_id IN (SELECT document_id FROM last_sets)),
{VERDICT_SQL.replace("FROM invoices i", "FROM edited i").replace("FROM lines", "FROM patched_lines")}
SELECT invoice_id, n_errors, n_warnings, n_errors = 0 AS is_valid,
  n_errors > 0 OR n_warnings > 0 AS requires_review FROM verdicts""",
    "patch_verdicts": f"""WITH {outcomes_sql()}, {_LAST_SET}, {_NEW_LINES},
{VERDICT_SQL.replace("FROM invoices i", "FROM patched i").replace("FROM lines", "FROM patched_lines")}
SELECT invoice_id, n_errors, n_warnings, n_errors = 0 AS is_valid,
  n_errors > 0 OR n_warnings > 0 AS requires_review FROM verdicts""",
    "patch_findings_rows": f"""WITH {outcomes_sql()}, {_LAST_SET}, {_NEW_LINES},
invoices AS (SELECT * FROM patched WHERE document_id IN (SELECT document_id FROM last_sets)),
{NUMBERED_SQL.replace("FROM lines", "FROM patched_lines WHERE invoice_id IN (SELECT invoice_id FROM invoices)")}
{_ALL_FINDINGS.replace("FROM lines", "FROM patched_lines")}""",
    "review_view_lines": f"""WITH {ctes('documents', 'drafts', 'lines')}, {NUMBERED_SQL}
SELECT d.document_id, d.organization_id, line_index, line_id, line_order, description,
  {text_sql('quantity', 'unit_price', 'amount')}
FROM numbered n JOIN drafts i ON i.invoice_id = n.invoice_id
JOIN docs d ON d.document_id = i.document_id""",
    "review_view_findings": f"""WITH {ctes('documents', 'drafts', 'lines')},
invoices AS (SELECT * FROM drafts),
{NUMBERED_SQL.replace("FROM lines", "FROM lines WHERE invoice_id IN (SELECT invoice_id FROM drafts)")},
found AS ({_ALL_FINDINGS})
SELECT f.*, d.document_id, d.organization_id FROM found f
JOIN drafts i ON i.invoice_id = f.invoice_id JOIN docs d ON d.document_id = i.document_id""",
    "decided_invoices": f"""WITH {outcomes_sql()}, {_DECISIONS}
SELECT i.invoice_id, CAST(coalesce(d.approved_at, i.approved_at) AS VARCHAR) AS approved_at,
  coalesce(d.approved_by_user_id, i.approved_by_user_id) AS approved_by_user_id,
  {text_sql('d.rejected_at')},
  coalesce(d.rejected_by_user_id, i.rejected_by_user_id) AS rejected_by_user_id,
  coalesce(d.rejection_reason, i.rejection_reason) AS rejection_reason
FROM drafts i LEFT JOIN decisions d ON d.document_id = i.document_id""",
    "approve_batch": f"""WITH {outcomes_sql("'APPROVE'")}, {_DECISIONS}
SELECT document_id, status, {text_sql('approved_at')}, approved_by_user_id FROM decisions""",
    "approve_blocked": f"""WITH {outcomes_sql()},
tried AS (SELECT command_id AS met_id, document_id, issued_at FROM outcomes
  WHERE outcome = 'BLOCKED' AND kind = 'APPROVE'),
earlier AS (SELECT o.* REPLACE (t.met_id AS document_id)
  FROM outcomes o JOIN tried t ON t.document_id = o.document_id
  WHERE (o.issued_at, o.command_id) < (t.issued_at, t.met_id)),
met AS (SELECT i.* REPLACE (t.met_id AS invoice_id, t.met_id AS document_id)
  FROM drafts i JOIN tried t ON t.document_id = i.document_id),
met_lines AS (SELECT l.* REPLACE (t.met_id AS invoice_id) FROM lines l
  JOIN drafts i ON i.invoice_id = l.invoice_id JOIN tried t ON t.document_id = i.document_id),
{_LAST_SET.replace("FROM outcomes", "FROM earlier").replace("FROM drafts", "FROM met")},
{_NEW_LINES.replace("FROM outcomes", "FROM earlier").replace("JOIN drafts", "JOIN met")
 .replace("FROM lines", "FROM met_lines")},
invoices AS (SELECT * FROM patched),
{NUMBERED_SQL.replace("FROM lines", "FROM patched_lines")},
found AS ({_ALL_FINDINGS.replace("FROM lines", "FROM patched_lines")})
SELECT f.* EXCLUDE (invoice_id), t.met_id AS command_id, t.document_id
FROM found f JOIN tried t ON t.met_id = f.invoice_id""",
    "approve_blocked_documents": f"""WITH {outcomes_sql()},
blocked AS (SELECT document_id, count(*) AS n_blocked,
  arg_min(command_id, (issued_at, command_id)) AS first_command_id,
  min((issued_at, command_id)) AS first_at
  FROM outcomes WHERE outcome = 'BLOCKED' GROUP BY document_id),
earlier AS (SELECT o.* FROM outcomes o JOIN blocked b ON b.document_id = o.document_id
  WHERE (o.issued_at, o.command_id) < b.first_at),
{_LAST_SET.replace("FROM outcomes", "FROM earlier")},
{_NEW_LINES.replace("FROM outcomes", "FROM earlier")},
invoices AS (SELECT * FROM patched WHERE document_id IN (SELECT document_id FROM blocked)),
{NUMBERED_SQL.replace("FROM lines", "FROM patched_lines WHERE invoice_id IN (SELECT invoice_id FROM invoices)")},
found AS ({_ALL_FINDINGS.replace("FROM lines", "FROM patched_lines")})
SELECT f.* EXCLUDE (invoice_id), b.document_id, n_blocked, first_command_id FROM found f
JOIN invoices i ON i.invoice_id = f.invoice_id JOIN blocked b ON b.document_id = i.document_id""",
    "reject_batch": f"""WITH {outcomes_sql("'REJECT'")}, {_DECISIONS}
SELECT o.command_id, o.document_id, o.outcome, {text_sql('d.rejected_at')},
  d.rejected_by_user_id, d.rejection_reason
FROM outcomes o LEFT JOIN decisions d ON d.document_id = o.document_id""",
}
