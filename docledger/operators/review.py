"""Review commands applied as a batch: edit, approve, reject.

Commands act in order of (issued_at, command_id) within a document. The first approval
or rejection that succeeds decides the document and later commands conflict.
Whether an approval succeeds depends on the edits before it, so the four values
the arithmetic needs are carried forward along the commands of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import fixed
from docledger.functions.groups import HEAVY_ROWS, merge_groups, split_groups
from docledger.functions.ids import derived_id
from docledger.functions.keybits import with_keys
from docledger.functions.text import is_blank
from docledger.operators import findings
from docledger.operators.extract import parse_payload
from docledger.sources.workspace import persisted

OPEN_STATUS = "REVIEW_REQUIRED"


def tenant_lookup(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Find documents by id and tenant; a foreign id looks like an unknown one."""
    known = documents.select(
        "document_id", F.col("organization_id").alias("_owner"), F.col("status").alias("_status")
    )
    found = F.coalesce(F.col("_owner") == F.col("organization_id"), F.lit(False))
    return requests.join(known, "document_id", "left").withColumns({
        "lookup": F.when(found, "OK").otherwise("NOT_FOUND"),
        "status": F.when(found, F.col("_status")),
    }).drop("_owner", "_status")


def review_view(documents: DataFrame, invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents under any status with their draft and its verdict."""
    rated = findings.with_verdict(invoices, lines)
    return documents.select("document_id", "organization_id", "status").join(
        rated, "document_id", "left"
    ).withColumn(
        "view", F.when(F.col("invoice_id").isNull(), "MISSING_DRAFT").otherwise("OK")
    )


def review_lines(documents: DataFrame, invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of the drafts in a review view, with the rank findings name them by."""
    drafts = documents.select("document_id", "organization_id").join(
        invoices.select("document_id", "invoice_id"), "document_id")
    own = lines.join(drafts.select("invoice_id"), "invoice_id", "left_semi")
    return findings.number_lines(own, probe=lines).join(drafts, "invoice_id")


def review_findings(documents: DataFrame, invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """The findings of the drafts in a review view."""
    drafts = documents.select("document_id", "organization_id").join(invoices, "document_id")
    return findings.all_findings(drafts, lines).join(
        drafts.select("invoice_id", "document_id", "organization_id"), "invoice_id")


def reason_bad() -> Column:
    length = F.char_length("reason")
    return is_blank("reason") | (length < 1) | (length > fixed.MAX_REASON_LENGTH)


def with_patch(commands: DataFrame) -> DataFrame:
    """Parse the JSON patch of edits: values, `fields_set`, and the verdicts."""
    parsed = parse_payload(commands, "patch", null_lines_ok=True)
    return parsed.withColumn("fields_set", F.json_object_keys("patch"))


def is_set(name: str) -> Column:
    return F.coalesce(F.array_contains("fields_set", name), F.lit(False))


def draft_state(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """What the approval arithmetic needs to know about each draft."""
    # Lines that are right do not count, so they need not travel.
    bad = lines.where(findings.line_off(
        F.col("quantity"), F.col("unit_price"), F.col("amount"))).select("invoice_id").distinct()
    return (
        invoices.select("invoice_id", "document_id", "subtotal", "tax", "total")
        .join(bad.withColumn("_bad", F.lit(True)), "invoice_id", "left")
        .select(
            "document_id",
            F.lit(True).alias("_draft"),
            *[F.col(n).alias(f"_base_{n}") for n in fixed.MONEY_FIELDS],
            F.coalesce("_bad", F.lit(False)).alias("_base_bad_lines"),
        )
    )


def checked_commands(commands: DataFrame) -> DataFrame:
    """Commands with what can be said of them alone.

    `_invalid` and `_unfit` judge the body, `_set_<amount>` is a struct where an edit names
    that amount, and `_set_bad_lines` says whether the lines an edit brings are wrong.
    """
    is_edit, is_approve, is_reject = (
        F.col("kind") == kind for kind in ("EDIT", "APPROVE", "REJECT")
    )
    bad_new_line = F.exists(
        "line_items",
        lambda x: F.coalesce(
            findings.line_off(x["quantity"], x["unit_price"], x["amount"]), F.lit(False)
        ),
    )
    return with_patch(commands).select(
        *commands.columns,
        F.coalesce(
            (is_edit & F.col("schema_bad")) | (is_reject & reason_bad())
            | ~(is_edit | is_approve | is_reject), F.lit(True)
        ).alias("_invalid"),
        (is_edit & F.col("limits_bad")).alias("_unfit"),
        *[F.when(is_set(n), F.struct(F.col(n).alias("v"))).alias(f"_set_{n}")
          for n in fixed.MONEY_FIELDS],
        F.when(is_set("line_items"), bad_new_line).alias("_set_bad_lines"),
    )


def command_outcomes(
    commands: DataFrame, documents: DataFrame, invoices: DataFrame, lines: DataFrame,
    min_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Outcome of every command: INVALID, NOT_FOUND, CONFLICT, MISSING_DRAFT,
    BLOCKED, SAVE_FAILED or OK, tested in that order.

    A kind other than EDIT, APPROVE and REJECT, or none, is INVALID. Only documents
    that commands name are looked at, so a small batch reads few lines' groups.
    """
    named = commands.select("document_id").distinct()
    documents = documents.join(named, "document_id", "left_semi")
    # No command on a document under another status asks for its draft.
    undecided = documents.where(F.coalesce(F.col("status") == OPEN_STATUS, F.lit(True)))
    invoices = invoices.join(undecided, "document_id", "left_semi")
    lines = lines.select("invoice_id", "quantity", "unit_price", "amount").join(
        invoices.select("invoice_id"), "invoice_id", "left_semi")
    is_edit, is_approve, is_reject = (
        F.col("kind") == kind for kind in ("EDIT", "APPROVE", "REJECT")
    )
    checked = checked_commands(commands)
    state = (
        documents.select(
            "document_id",
            F.col("organization_id").alias("_owner"),
            F.col("status").alias("_status"),
        )
        .join(draft_state(invoices, lines), "document_id", "left")
    )
    joined = checked.join(state, "document_id", "left")
    found = F.coalesce(F.col("_owner") == F.col("organization_id"), F.lit(False))
    eligible = (
        ~F.col("_invalid") & found & (F.col("_status") == OPEN_STATUS)
        & F.col("_draft").isNotNull()
    )
    edits = eligible & is_edit & ~F.col("_unfit")

    order = [F.col("issued_at"), F.col("command_id")]
    scans = []
    for scan in split_groups(joined, "document_id", order, min_rows, probe=commands):
        scan = scan.carry({
            **{f"_now_{n}": F.when(edits, F.col(f"_set_{n}")) for n in fixed.MONEY_FIELDS},
            "_now_bad_lines": F.when(edits, F.col("_set_bad_lines")),
        })
        money = [
            F.when(F.col(f"_now_{n}").isNotNull(), F.col(f"_now_{n}")["v"])
            .otherwise(F.col(f"_base_{n}"))
            for n in fixed.MONEY_FIELDS
        ]
        has_errors = F.coalesce(findings.total_off(*money), F.lit(False)) | F.coalesce(
            "_now_bad_lines", "_base_bad_lines", F.lit(False)
        )
        df = scan.df.withColumn("_errors", has_errors)
        decides = eligible & (is_reject | (is_approve & ~F.col("_errors")))
        scans.append(
            scan.with_df(df).carry({"_decided": F.when(decides, F.lit(True))}, before=True)
        )

    outcome = (
        F.when(F.col("_invalid"), "INVALID")
        .when(~found, "NOT_FOUND")
        .when((F.col("_status") != OPEN_STATUS) | F.col("_decided").isNotNull(), "CONFLICT")
        .when(F.col("_draft").isNull(), "MISSING_DRAFT")
        .when(is_approve & F.col("_errors"), "BLOCKED")
        .when(F.col("_unfit"), "SAVE_FAILED")
        .otherwise("OK")
    )
    return merge_groups(scans).select(*commands.columns, outcome.alias("outcome"))


def decisions(outcomes: DataFrame) -> DataFrame:
    """At most one successful approval or rejection per document."""
    approved = F.col("kind") == "APPROVE"
    return outcomes.where(
        (F.col("outcome") == "OK") & F.col("kind").isin("APPROVE", "REJECT")
    ).select(
        "document_id",
        F.when(approved, "APPROVED").otherwise("REJECTED").alias("status"),
        F.when(approved, F.col("issued_at")).alias("approved_at"),
        F.when(approved, F.col("user_id")).alias("approved_by_user_id"),
        F.when(~approved, F.col("issued_at")).alias("rejected_at"),
        F.when(~approved, F.col("user_id")).alias("rejected_by_user_id"),
        F.when(~approved, F.col("reason")).alias("rejection_reason"),
    )


def decided_documents(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    new = decisions(outcomes).select("document_id", F.col("status").alias("_new"))
    return documents.join(new, "document_id", "left").withColumn(
        "status", F.coalesce("_new", "status")
    ).drop("_new")


def decided_invoices(invoices: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Invoices with who decided them, when and why; others keep what they have."""
    made = decisions(outcomes).drop("status")
    names = [c for c in made.columns if c != "document_id"]
    new = made.withColumnsRenamed({c: f"_new_{c}" for c in names})
    joined = invoices.join(new, "document_id", "left")
    return joined.withColumns({
        c: F.coalesce(f"_new_{c}", c) if c in invoices.columns else F.col(f"_new_{c}")
        for c in names
    }).drop(*[f"_new_{c}" for c in names])


def saved_edits(outcomes: DataFrame) -> DataFrame:
    return outcomes.where((F.col("outcome") == "OK") & (F.col("kind") == "EDIT"))


def patched_headers(invoices: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Headers after the saved edits: per field, the last edit that set it wins.

    An explicit null clears a field; a field no edit names is left alone.
    """
    latest = with_patch(saved_edits(outcomes)).groupBy("document_id").agg(*[
        F.max(F.when(
            is_set(n), F.struct("issued_at", "command_id", F.col(n).alias("v"))
        )).alias(f"_new_{n}")
        for n in fixed.HEADER_FIELDS
    ])
    return invoices.join(latest, "document_id", "left").withColumns({
        n: F.when(F.col(f"_new_{n}").isNotNull(), F.col(f"_new_{n}")["v"]).otherwise(F.col(n))
        for n in fixed.HEADER_FIELDS
    }).drop(*[f"_new_{n}" for n in fixed.HEADER_FIELDS])


def replaced_lines(invoices: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(invoice_id, line_items) of invoices whose whole line set was replaced."""
    latest = (
        with_patch(saved_edits(outcomes))
        .where(is_set("line_items"))
        .groupBy("document_id")
        .agg(F.max_by("line_items", F.struct("issued_at", "command_id")).alias("line_items"))
    )
    return latest.join(invoices.select("document_id", "invoice_id"), "document_id").select(
        "invoice_id", "line_items"
    )


def brought_lines(replaced: DataFrame) -> DataFrame:
    """The lines that edits bring, from (invoice_id, line_items), numbered from 0."""
    return replaced.select(
        "invoice_id", F.posexplode("line_items").alias("line_order", "item")
    ).select(
        derived_id("edited-line", "invoice_id", "line_order").alias("line_id"),
        "invoice_id", "line_order", "item.description", "item.quantity",
        "item.unit_price", "item.amount",
    )


def patched_lines(lines: DataFrame, invoices: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Lines after the saved edits; a replaced set is renumbered from 0."""
    replaced = replaced_lines(invoices, outcomes)
    kept = lines.join(replaced.select("invoice_id"), "invoice_id", "left_anti")
    fresh = brought_lines(replaced)
    kept = kept.withColumn("line_id", F.col("line_id").cast("string"))
    return kept.select(*fresh.columns).unionByName(fresh)


def line_changes(
    lines: DataFrame, invoices: DataFrame, outcomes: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(removed, added): the lines that saved edits take away and bring."""
    replaced = replaced_lines(invoices, outcomes).select("invoice_id")
    old = lines.join(replaced, "invoice_id", "left_semi")
    new = patched_lines(old, invoices, outcomes)
    return old, new


def blocked_findings(
    outcomes: DataFrame, invoices: DataFrame, lines: DataFrame, min_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Findings of every document with a blocked approval, once per document.

    `n_blocked` counts its blocked approvals and `first_command_id` names the first;
    the findings are those of the draft as that one met it: `invoices` and `lines`,
    changed by the edits saved before. They are not repeated per command: a document
    may hold many of both.
    """
    blocked = (
        outcomes.where(F.col("outcome") == "BLOCKED")
        .groupBy("document_id")
        .agg(
            F.count("*").alias("n_blocked"),
            F.min(F.struct("issued_at", "command_id")).alias("_first"),
        )
    )
    blocked = persisted(blocked, "blocked")
    earlier = saved_edits(outcomes).join(
        blocked.select("document_id", "_first"), "document_id"
    ).where(F.struct("issued_at", "command_id") < F.col("_first")).drop("_first")
    # Each of these is read by several findings; kept, none of them is made twice and no
    # task holds the sorts of all of them at once.
    earlier = persisted(earlier, "earlier-edits")
    before = persisted(
        invoices.join(blocked.select("document_id"), "document_id", "left_semi"), "blocked-drafts")
    own_lines = lines.join(before.select("invoice_id"), "invoice_id", "left_semi")
    drafts = persisted(patched_headers(before, earlier), "met-headers")
    items = persisted(patched_lines(own_lines, before, earlier), "met-lines")
    found = findings.all_findings(drafts, items, min_rows)
    named = before.select("invoice_id", "document_id").join(blocked, "document_id").select(
        "invoice_id", "document_id", "n_blocked", F.col("_first.command_id").alias("first_command_id"))
    return found.join(named, "invoice_id").drop("invoice_id")


def blocked_command_findings(
    outcomes: DataFrame, invoices: DataFrame, lines: DataFrame, min_rows: int = HEAVY_ROWS
) -> DataFrame:
    """command_id, document_id and the findings each blocked approval met, per command.

    The draft an approval meets is the stored one, changed by the edits saved before it.
    Approvals with no saved edit between them meet the same draft, which is judged once.
    The values of headers are carried along a document's commands; of lines only the
    edit that brought them is, and its lines are read when a draft needs them.
    """
    is_blocked = (F.col("outcome") == "BLOCKED") & (F.col("kind") == "APPROVE")
    is_saved = (F.col("outcome") == "OK") & (F.col("kind") == "EDIT")
    named = outcomes.where(is_blocked).select("document_id").distinct()
    steps = with_patch(
        outcomes.where(is_blocked | is_saved).join(named, "document_id", "left_semi")
    ).withColumn("_saved", is_saved)
    carried = {
        **{f"_set_{n}": F.when(F.col("_saved") & is_set(n), F.struct(F.col(n).alias("v")))
           for n in fixed.HEADER_FIELDS},
        "_edit": F.when(F.col("_saved"), F.col("command_id")),
        "_lines": F.when(F.col("_saved") & is_set("line_items"), F.col("command_id")),
    }
    order = [F.col("issued_at"), F.col("command_id")]
    scans = [scan.carry(carried) for scan in split_groups(
        steps, "document_id", order, min_rows, probe=outcomes)]
    met = persisted(merge_groups(scans).where(~F.col("_saved")).select(
        "command_id", "document_id",
        derived_id("met-draft", "document_id", F.coalesce(F.col("_edit").cast("string"), F.lit("")))
        .alias("met_id"), *carried), "met-drafts")
    drafts = met.groupBy("met_id", "document_id", "_lines").agg(
        *[F.any_value(f"_set_{n}").alias(f"_set_{n}") for n in fixed.HEADER_FIELDS])
    base = invoices.join(named, "document_id", "left_semi")
    headers = persisted(drafts.join(
        base.select("document_id", "invoice_id", *fixed.HEADER_FIELDS), "document_id").select(
        "met_id", "document_id", F.col("invoice_id").alias("base_id"), "_lines", *[
            F.when(F.col(f"_set_{n}").isNotNull(), F.col(f"_set_{n}")["v"]).otherwise(F.col(n))
            .alias(n) for n in fixed.HEADER_FIELDS]), "met-headers")
    values = ("line_order", "description", "quantity", "unit_price", "amount")
    stored = lines.join(
        headers.where(F.col("_lines").isNull()).select(
            "met_id", F.col("base_id").alias("invoice_id")), "invoice_id").select(
        F.col("met_id").alias("invoice_id"), F.col("line_id").cast("string").alias("line_id"), *values)
    brought = steps.where(F.col("_saved")).select(
        F.col("command_id").alias("_lines"), "line_items").join(
        headers.select("_lines", "met_id"), "_lines").select(
        F.col("met_id").alias("invoice_id"),
        F.posexplode("line_items").alias("line_order", "item")).select(
        "invoice_id", derived_id("edited-line", "invoice_id", "line_order").alias("line_id"),
        "line_order", *[f"item.{c}" for c in values[1:]])
    items = persisted(stored.unionByName(brought), "met-lines")
    found = findings.all_findings(
        headers.withColumn("invoice_id", F.col("met_id")), items, min_rows)
    return met.select("command_id", "document_id", "met_id").join(
        found.withColumnRenamed("invoice_id", "met_id"), "met_id").drop("met_id")


def review_changes(
    outcomes: DataFrame, documents: DataFrame, invoices: DataFrame,
) -> dict[str, tuple[DataFrame | None, DataFrame]]:
    """What a batch changes in the three stored tables: (removed, added) of each.

    `removed` has organization_id and the table's key, `added` the rows that take their
    place; `removed` is None where these have the same keys. For lines the key is the
    invoice, whose line set is replaced as a whole, so stored lines are not read. Only
    documents with a saved command are joined. `invoices` carry organization_id, as they
    are stored by tenant, and `outcomes` are kept somewhere.
    """
    saved = outcomes.where(F.col("outcome") == "OK")
    named = saved.select("document_id").distinct()
    decided = decisions(saved).select("document_id")
    changed_documents = decided_documents(with_keys(documents, "document_id", decided), saved)
    drafts = with_keys(invoices, "document_id", named)
    headers = decided_invoices(patched_headers(drafts, saved), saved)
    replaced = replaced_lines(drafts, saved)
    owned = drafts.select("invoice_id", "organization_id")
    return {
        "documents": (None, changed_documents),
        "invoices": (None, headers),
        "invoice_line_items": (
            replaced.select("invoice_id").join(owned, "invoice_id").select(
                "organization_id", "invoice_id"),
            brought_lines(replaced).join(owned, "invoice_id")),
    }
