from __future__ import annotations

import json
import random
from datetime import timedelta
from decimal import Decimal

import pytest
from builders import T0, commands, document, documents, invoice, invoices, line, lines

from docledger.operators import export, review
from docledger.plans import review as plans


def cmd(key, kind, minutes=0, patch=None, **values):
    return {"command_id": key, "kind": kind, "issued_at": T0 + timedelta(minutes=minutes),
            "patch": None if patch is None else json.dumps(patch), **values}


def outcomes(spark, rows, docs=None, heads=None, items=None, **options):
    docs = docs or [document()]
    heads = [invoice()] if heads is None else heads
    items = [line("l1")] if items is None else items
    return review.command_outcomes(
        commands(spark, *rows), documents(spark, *docs), invoices(spark, *heads) if heads
        else invoices(spark), lines(spark, *items), **options)


def codes(frame):
    return {r["command_id"]: r["outcome"] for r in frame.collect()}


@pytest.mark.parametrize(("command", "expected"), [
    ({"kind": "APPROVE"}, "OK"),
    ({"kind": "REJECT", "reason": "wrong"}, "OK"),
    ({"kind": "REJECT", "reason": ""}, "INVALID"),
    ({"kind": "REJECT", "reason": " 　\n"}, "INVALID"),
    ({"kind": "REJECT", "reason": None}, "INVALID"),
    ({"kind": "REJECT", "reason": "x" * 2000}, "OK"),
    ({"kind": "REJECT", "reason": "x" * 2001}, "INVALID"),
    ({"kind": "EDIT", "patch": '{"vendor_name": "x"}'}, "OK"),
    ({"kind": "EDIT", "patch": "{}"}, "OK"),
    ({"kind": "EDIT", "patch": None}, "INVALID"),
    ({"kind": "EDIT", "patch": '{"vendor_name": 1}'}, "INVALID"),
    ({"kind": "EDIT", "patch": '{"currency": "123456789"}'}, "SAVE_FAILED"),
    ({"kind": "APPROVE", "organization_id": "b"}, "NOT_FOUND"),
    ({"kind": "APPROVE", "document_id": "nope"}, "NOT_FOUND"),
    ({"kind": "EDIT", "patch": "oops", "organization_id": "b"}, "INVALID"),
    ({"kind": "DELETE"}, "INVALID"),
    ({"kind": None}, "INVALID"),
])
def test_single_command(spark, command, expected):
    row = {"command_id": "c1", "issued_at": T0, **command}
    assert codes(outcomes(spark, [row])) == {"c1": expected}


@pytest.mark.parametrize("status", ["UPLOADED", "TEXT_EXTRACTED", "FAILED", "APPROVED", "REJECTED"])
@pytest.mark.parametrize("kind", ["APPROVE", "REJECT", "EDIT"])
def test_only_review_required_documents_accept_commands(spark, status, kind):
    row = cmd("c1", kind, patch={} if kind == "EDIT" else None, reason="r")
    assert codes(outcomes(spark, [row], docs=[document(status=status)])) == {"c1": "CONFLICT"}


def test_missing_draft(spark):
    assert codes(outcomes(spark, [cmd("c1", "APPROVE"), cmd("c2", "REJECT", 1, reason="r")],
                          heads=[])) == {"c1": "MISSING_DRAFT", "c2": "MISSING_DRAFT"}


def test_first_decision_wins_and_later_commands_conflict(spark):
    rows = [cmd("c1", "REJECT", 0, reason="no"), cmd("c2", "APPROVE", 1),
            cmd("c3", "EDIT", 2, {}), cmd("c4", "REJECT", 3, reason="again")]
    got = outcomes(spark, rows)
    assert codes(got) == {"c1": "OK", "c2": "CONFLICT", "c3": "CONFLICT", "c4": "CONFLICT"}
    row = review.decisions(got).first()
    assert (row["status"], row["rejection_reason"], row["approved_at"]) == ("REJECTED", "no", None)


def test_errors_block_and_warnings_do_not(spark):
    bad = [invoice(total=Decimal("999.00"))]
    assert codes(outcomes(spark, [cmd("c1", "APPROVE")], heads=bad)) == {"c1": "BLOCKED"}
    bare = [invoice(vendor_name=None)]
    assert codes(outcomes(spark, [cmd("c1", "APPROVE")], heads=bare, items=[])) == {"c1": "OK"}
    rejected = [cmd("c1", "REJECT", reason="r")]
    assert codes(outcomes(spark, rejected, heads=bad)) == {"c1": "OK"}


def test_edits_unblock_and_block_approvals(spark):
    rows = [cmd("c1", "APPROVE", 0), cmd("c2", "EDIT", 1, {"total": None}),
            cmd("c3", "EDIT", 2, {"line_items": [{"quantity": 2, "unit_price": 2, "amount": 9}]}),
            cmd("c4", "APPROVE", 3), cmd("c5", "EDIT", 4, {"line_items": None}),
            cmd("c6", "APPROVE", 5), cmd("c7", "APPROVE", 6)]
    assert codes(outcomes(spark, rows, heads=[invoice(total=Decimal("999.00"))])) == {
        "c1": "BLOCKED", "c2": "OK", "c3": "OK", "c4": "BLOCKED", "c5": "OK", "c6": "OK",
        "c7": "CONFLICT"}


def test_patches_keep_clear_and_replace(spark):
    rows = [cmd("c1", "EDIT", 0, {"vendor_name": "New", "due_date": None}),
            cmd("c2", "EDIT", 1, {"vendor_name": "Newer", "currency": "123456789"}),
            cmd("c3", "EDIT", 2, {"line_items": [{"description": "x"}, {"description": "y"}]})]
    got = outcomes(spark, rows)
    head = review.patched_headers(invoices(spark, invoice()), got).first()
    assert head["vendor_name"] == "New"  # the second edit failed as a whole
    assert head["due_date"] is None
    assert head["subtotal"] == Decimal("100.00")
    left = review.patched_lines(lines(spark, line("l1"), line("l2", "i2")),
                                invoices(spark, invoice(), invoice("i2")), got).collect()
    assert sorted((r["invoice_id"], r["line_order"], r["description"]) for r in left) == [
        ("i1", 0, "x"), ("i1", 1, "y"), ("i2", 0, "Item")]


def test_explicit_empty_list_clears_lines(spark):
    got = outcomes(spark, [cmd("c1", "EDIT", 0, {"line_items": []})])
    left = review.patched_lines(lines(spark, line("l1")), invoices(spark, invoice()), got)
    assert left.count() == 0


def test_decided_documents_and_view(spark):
    got = outcomes(spark, [cmd("c1", "APPROVE")])
    docs = documents(spark, document(), document("d2", status="FAILED"))
    rows = {r["document_id"]: r["status"] for r in review.decided_documents(docs, got).collect()}
    assert rows == {"d1": "APPROVED", "d2": "FAILED"}
    view = {r["document_id"]: r for r in review.review_view(
        docs, invoices(spark, invoice()), lines(spark, line("l1"))).collect()}
    assert (view["d1"]["view"], view["d1"]["is_valid"]) == ("OK", True)
    assert view["d2"]["view"] == "MISSING_DRAFT"


def test_blocked_findings_appear_once_per_document(spark):
    bad = [invoice(total=Decimal("999.00"), due_date=None)]
    got = outcomes(spark, [cmd("c2", "APPROVE", 1), cmd("c1", "APPROVE", 0)], heads=bad)
    rows = review.blocked_findings(got, invoices(spark, *bad), lines(spark, line("l1"))).collect()
    assert sorted(r["code"] for r in rows) == ["FIELD_MISSING", "TOTAL_MISMATCH"]
    assert {(r["n_blocked"], r["first_command_id"]) for r in rows} == {(2, "c1")}


def test_blocked_findings_are_those_the_approval_met(spark):
    rows = [cmd("c1", "EDIT", 0, {"total": "999.00", "due_date": None}), cmd("c2", "APPROVE", 1),
            cmd("c3", "EDIT", 2, {"total": "115.00", "vendor_name": None}), cmd("c4", "APPROVE", 3)]
    got = outcomes(spark, rows)
    assert codes(got) == {"c1": "OK", "c2": "BLOCKED", "c3": "OK", "c4": "OK"}
    found = review.blocked_findings(got, invoices(spark, invoice()), lines(spark, line("l1")))
    assert sorted((r["code"], r["field"]) for r in found.collect()) == [
        ("FIELD_MISSING", "due_date"), ("TOTAL_MISMATCH", "total")]


@pytest.mark.parametrize("min_rows", [1, 1_000])
def test_every_blocked_approval_has_the_findings_it_met(spark, min_rows):
    rows = [
        cmd("c1", "EDIT", 0, {"total": "999.00", "due_date": None}), cmd("c2", "APPROVE", 1),
        cmd("c3", "APPROVE", 2), cmd("c4", "EDIT", 3, {"total": "115.00", "line_items": [
            {"amount": 1}, {"quantity": 1, "unit_price": 1, "amount": 9}]}),
        cmd("c5", "APPROVE", 4), cmd("c6", "EDIT", 5, {"line_items": [], "tax": 0}),
        cmd("c7", "APPROVE", 6), cmd("c8", "EDIT", 7, {"tax": "15.00"}), cmd("c9", "APPROVE", 8),
        cmd("e1", "APPROVE", 0, document_id="d2"), cmd("e2", "REJECT", 1, document_id="d2", reason="x")]
    docs = [document(), document("d2"), document("d3")]
    heads = [invoice(), invoice("i2", vendor_name=None), invoice("i3", total=Decimal("1.00"))]
    items = [line("l1"), line("l2", "i2", amount="7.00"), line("l3", "i2", 1, amount="8.00")]
    got = outcomes(spark, rows, docs, heads, items)
    assert {k for k, v in codes(got).items() if v == "BLOCKED"} == {"c2", "c3", "c5", "c7", "e1"}
    found = {}
    for r in review.blocked_command_findings(
            got, invoices(spark, *heads), lines(spark, *items), min_rows).collect():
        found.setdefault((r["command_id"], r["document_id"]), []).append((r["code"], r["field"]))
    met = [("FIELD_MISSING", "due_date"), ("TOTAL_MISMATCH", "total")]
    assert {k: sorted(v) for k, v in found.items()} == {
        ("c2", "d1"): met, ("c3", "d1"): met,
        ("c5", "d1"): [("FIELD_MISSING", "due_date"),
                       ("LINE_ITEM_AMOUNT_MISMATCH", "line_items[1].amount")],
        ("c7", "d1"): [("FIELD_MISSING", "due_date"), ("NO_LINE_ITEMS", "line_items"),
                       ("TOTAL_MISMATCH", "total")],
        ("e1", "d2"): [("FIELD_MISSING", "vendor_name"),
                       ("LINE_ITEM_AMOUNT_MISMATCH", "line_items[0].amount"),
                       ("LINE_ITEM_AMOUNT_MISMATCH", "line_items[1].amount")]}


def test_approval_reaches_the_export(spark):
    got = outcomes(spark, [cmd("c1", "APPROVE", user_id="boss")])
    docs = review.decided_documents(documents(spark, document()), got)
    heads = review.decided_invoices(invoices(spark, invoice(), invoice("i2")), got)
    rows = export.cells(export.flatten(
        export.approved_invoices(docs, heads), lines(spark, line("l1")))).collect()
    assert [(r["invoice_id"], r["approved_at"], r["approved_by_user_id"]) for r in rows] == [
        ("i1", "2024-01-01T12:00:00+00:00", "boss")]
    other = heads.where("invoice_id = 'i2'").first()
    assert (other["approved_at"], other["rejected_at"]) == (None, None)


def test_only_lines_of_named_documents_are_aggregated(spark):
    got = outcomes(spark, [cmd("c1", "APPROVE")])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    body = plan[plan.index("count_if") if "count_if" in plan else 0:]
    assert "LeftSemi" in body


def test_review_view_has_lines_and_findings(spark):
    docs = documents(spark, document(), document("d2", "b"), document("d3"))
    heads = invoices(spark, invoice(), invoice("i2", total=None))
    items = lines(spark, line("l2", "i1", 5), line("l1", "i1", 2, amount="1.00"))
    rows = review.review_lines(docs, heads, items).collect()
    assert sorted((r["document_id"], r["line_index"], r["line_id"]) for r in rows) == [
        ("d1", 0, "l1"), ("d1", 1, "l2")]
    found = review.review_findings(docs, heads, items).collect()
    assert sorted((r["document_id"], r["organization_id"], r["code"]) for r in found) == [
        ("d1", "a", "LINE_ITEM_AMOUNT_MISMATCH"), ("d2", "b", "FIELD_MISSING"),
        ("d2", "b", "NO_LINE_ITEMS")]


def _replay(rows, heads):
    """The commands applied one at a time, as a person at a desk would."""
    state, out = {}, {}
    for row in sorted(rows, key=lambda r: (r["issued_at"], r["command_id"])):
        key = row["document_id"]
        s = state.setdefault(key, {"open": True, "total": heads[key], "bad_line": False})
        patch = json.loads(row["patch"]) if row["patch"] else {}
        if not s["open"]:
            out[row["command_id"]] = "CONFLICT"
        elif row["kind"] == "EDIT":
            if "currency" in patch:
                out[row["command_id"]] = "SAVE_FAILED"
                continue
            out[row["command_id"]] = "OK"
            if "total" in patch:
                s["total"] = patch["total"]
            if "line_items" in patch:
                s["bad_line"] = any(x["amount"] != 4 for x in patch["line_items"])
        elif row["kind"] == "APPROVE" and (s["bad_line"] or s["total"] not in (None, 115)):
            out[row["command_id"]] = "BLOCKED"
        else:
            out[row["command_id"]] = "OK"
            s["open"] = False
    return out


def test_hot_document_matches_one_at_a_time_replay(spark):
    rng = random.Random(7)
    patches = [{"total": 999}, {"total": 998}, {"total": 115, "currency": "too long text"},
               {"line_items": [{"quantity": 2, "unit_price": 2, "amount": 5}]},
               {"line_items": [{"quantity": 2, "unit_price": 2, "amount": 4}]}]
    rows = []
    for i in range(400):
        hot = i % 3 == 0
        kind = "EDIT" if rng.random() < 0.6 else "APPROVE"
        # The hot document can only be approved near its end
        patch = rng.choice(patches) if kind == "EDIT" else None
        if hot and i > 330 and kind == "EDIT":
            patch = {"total": None, "line_items": []}
        rows.append(cmd(f"c{i:04d}", kind, rng.randrange(50) + i, patch,
                        document_id="d0" if hot else f"d{1 + i % 40}"))
    heads = {f"d{i}": (115 if i % 2 else 999) for i in range(41)}
    frames = dict(
        docs=[document(k) for k in heads],
        heads=[invoice(f"i{k[1:]}", total=Decimal(v)) for k, v in heads.items()], items=[])
    expected = _replay(rows, heads)
    assert codes(outcomes(spark, rows, **frames)) == expected
    assert codes(outcomes(spark, rows, min_rows=50, **frames)) == expected
    assert {"OK", "BLOCKED", "CONFLICT", "SAVE_FAILED"} <= set(expected.values())


@pytest.mark.parametrize("name", ["approve_blocked_documents", "approve_blocked", "patch_findings_rows"])
def test_findings_after_edits_are_made_from_kept_drafts(spark, name):
    """One stage that patches drafts and lines once per kind of finding holds dozens of sorts."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Join") <= 6 and "patch" not in plan.toString()


def test_verdicts_after_edits_keep_no_rows_but_those_of_named_drafts(spark, monkeypatch):
    kept, whole = [], plans.persisted

    def counting(df, label):
        made = whole(df, label)
        kept.append((label, made.count()))
        return made

    monkeypatch.setattr(plans, "persisted", counting)
    sf_dir = "/root/testdata/sf0.001"
    n = plans.patch_verdicts(spark, sf_dir).count()
    stored = plans.frame(spark, sf_dir, "lines").count()
    assert n == plans.frame(spark, sf_dir, "drafts").count()
    assert all(count < stored / 2 for label, count in kept)


def test_changes_of_a_batch_are_made_without_the_stored_lines(spark):
    heads = [invoice(k) for k in ("i1", "i2", "i3")]
    docs = documents(spark, *[document(f"d{n}") for n in (1, 2, 3)])
    stored = invoices(spark, *heads).join(
        docs.select("document_id", "organization_id"), "document_id")
    lined = {"line_items": [{"description": "x", "quantity": 2, "unit_price": 5, "amount": 10}]}
    got = review.command_outcomes(commands(
        spark, cmd("c1", "EDIT", 0, lined), cmd("c2", "APPROVE", 1),
        cmd("c3", "EDIT", 0, {"vendor_name": "New"}, document_id="d2"),
        cmd("c4", "EDIT", 0, {"vendor_name": 1}, document_id="d3"),
    ), docs, stored, lines(spark, line("l1"), line("l2", "i2"))).persist()
    changes = review.review_changes(got, docs, stored)
    removed, added = changes["documents"]
    assert removed is None
    assert [(r.document_id, r.status) for r in added.collect()] == [("d1", "APPROVED")]
    removed, added = changes["invoices"]
    assert removed is None and {(r.invoice_id, r.vendor_name, r.organization_id)
                                for r in added.collect()} == {("i1", "Acme", "a"), ("i2", "New", "a")}
    removed, added = changes["invoice_line_items"]
    assert [tuple(r) for r in removed.collect()] == [("a", "i1")]
    assert [(r.invoice_id, r.line_order, r.amount, r.organization_id) for r in added.collect()] == [
        ("i1", 0, Decimal("10.00"), "a")]
