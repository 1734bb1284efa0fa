from __future__ import annotations

import json
import random
import sys
from datetime import timedelta
from decimal import Decimal

import pytest
from builders import T0, build, commands, document, documents, invoice, invoices, line, lines
from pyspark import cloudpickle

from docledger import schemas
from docledger.operators import review
from docledger.operators.gate import gate
from docledger.plans import streams, uploads
from docledger.plans.standins import DRIVER_TABLES
from docledger.streaming import chain, decisions, keyed
from docledger.streaming.uploads import start_gate

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _feed(spark, frames, path, schema):
    """A file stream that sees one file per trigger."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_gate_equals_batch(spark, tmp_path):
    rows = [{"upload_id": str(i), "organization_id": "a", "filename": f"{i}.pdf" if i % 3 else None,
             "size_bytes": i % 2, "header": b"%PDF-"} for i in range(12)]
    frames = [build(spark, schemas.UPLOADS, rows[i::3]) for i in range(3)]
    stream = _feed(spark, frames, str(tmp_path / "in"), schemas.UPLOADS)
    start_gate(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("upload_id", "reject_reason").collect()
    batch = gate(build(spark, schemas.UPLOADS, rows)).select("upload_id", "reject_reason").collect()
    assert sorted(map(str, got)) == sorted(map(str, batch))


def test_streams_read_a_table_that_is_one_file_or_a_folder(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "web", 6) for i in range(1, 30)]
    table = spark.createDataFrame(rows, DRIVER_TABLES["documents"])
    table.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "file").mkdir()
    (part,) = (tmp_path / "part").glob("part-*.parquet")
    part.rename(tmp_path / "file" / "documents.parquet")
    for kind in ("file", "folder"):
        root = str(tmp_path / kind)
        got = streams.stream_gate(spark, root).collect()
        assert sorted(map(str, got)) == sorted(map(str, uploads.upload_gate(spark, root).collect()))
        assert len(got) == len(rows)
        assert streams.stream_chain(spark, root).count() > 0


def test_a_chain_without_any_batch_has_no_findings(spark, tmp_path):
    assert chain.read_findings(spark, str(tmp_path / "nothing")).count() == 0


class Counting:
    """Leaves one file per call, so that calls can be counted across workers."""

    folder = ""

    def __init__(self, folder):
        self.folder = folder

    def extract(self, text):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(text)
        return {"vendor_name": text, "line_items": [{"quantity": 1, "unit_price": 1, "amount": 5}]}


TEXTS = "document_id string, extracted_text_storage_key string, text string"


def test_chain_asks_once_per_document_even_when_replayed(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    root, folder = str(tmp_path / "tables"), str(calls)

    def factory():
        return Counting(folder)

    first = spark.createDataFrame([("d1", "k", "one"), ("d2", "k", "two"), ("d3", "k", " ")], TEXTS)
    second = spark.createDataFrame([("d2", "k", "two"), ("d4", "k", "four"), ("d4", "k", "four")],
                                   TEXTS)
    for batch_id, batch in [(0, first), (0, first), (1, second), (1, second)]:
        chain.process_batch(batch, batch_id, root, factory)
    assert sorted(p.read_text() for p in calls.iterdir()) == ["four", "one", "two"]
    heads = spark.read.parquet(f"{root}/invoices").collect()
    assert sorted(r["document_id"] for r in heads) == ["d1", "d2", "d4"]
    found = chain.read_findings(spark, root).collect()
    assert sum(r["code"] == "LINE_ITEM_AMOUNT_MISMATCH" for r in found) == 3


def test_stream_decisions_keep_refusing_across_batches(spark, tmp_path):
    def cmd(key, doc, kind, minutes, **more):
        return {"command_id": key, "document_id": doc, "kind": kind,
                "issued_at": T0 + timedelta(minutes=minutes), **more}

    batches = [
        [cmd("c1", "d1", "APPROVE", 0), cmd("c2", "d2", "APPROVE", 0)],
        [cmd("c3", "d1", "REJECT", 1, reason="late"), cmd("c4", "d2", "REJECT", 1, reason="bad")],
        [cmd("c5", "d2", "APPROVE", 2), cmd("c6", "d3", "REJECT", 2, reason="r")],
    ]
    docs = documents(spark, document("d1"), document("d2"), document("d3", status="FAILED"))
    heads = invoices(spark, invoice("i1"), invoice("i2", total=None), invoice("i3"))
    items = lines(spark, line("l1", "i1"), line("l2", "i2", amount="1.00"))
    stream = _feed(spark, [commands(spark, *b) for b in batches], str(tmp_path / "in"),
                   schemas.COMMANDS)
    root = str(tmp_path / "tables")
    decisions.start_decisions(
        stream, root, str(tmp_path / "cp"), docs, heads, items).awaitTermination()
    got = {r["command_id"]: r["outcome"] for r in spark.read.parquet(f"{root}/outcomes").collect()}
    batch = review.command_outcomes(
        commands(spark, *[c for b in batches for c in b]), docs, heads, items)
    assert got == {r["command_id"]: r["outcome"] for r in batch.collect()}
    assert got == {"c1": "OK", "c2": "BLOCKED", "c3": "CONFLICT", "c4": "OK", "c5": "CONFLICT",
                   "c6": "CONFLICT"}
    decisions.process_batch(commands(spark, *batches[1]), 1, root, docs, heads, items)
    decided = spark.read.parquet(f"{root}/decisions").collect()
    assert sorted((r["document_id"], r["status"]) for r in decided) == [
        ("d1", "APPROVED"), ("d2", "REJECTED")]


def test_stream_decisions_remember_edits_of_earlier_batches(spark, tmp_path):
    def cmd(key, doc, kind, minutes, patch=None):
        return {"command_id": key, "document_id": doc, "kind": kind, "patch": patch,
                "issued_at": T0 + timedelta(minutes=minutes)}

    batches = [
        [cmd("c1", "d1", "EDIT", 0, '{"total": "999.00"}'), cmd("c2", "d2", "APPROVE", 0)],
        [cmd("c3", "d1", "APPROVE", 1), cmd("c4", "d2", "EDIT", 1, '{"line_items": []}')],
        [cmd("c5", "d1", "EDIT", 2, '{"total": "115.00"}'), cmd("c6", "d2", "APPROVE", 2)],
        [cmd("c7", "d1", "APPROVE", 3), cmd("c8", "d2", "EDIT", 3, "{}")],
    ]
    docs = documents(spark, document("d1"), document("d2"))
    heads = invoices(spark, invoice("i1"), invoice("i2"))
    items = lines(spark, line("l1", "i1"), line("l2", "i2", amount="1.00"))
    stream = _feed(spark, [commands(spark, *b) for b in batches], str(tmp_path / "in"),
                   schemas.COMMANDS)
    root = str(tmp_path / "tables")
    decisions.start_decisions(
        stream, root, str(tmp_path / "cp"), docs, heads, items).awaitTermination()
    got = {r["command_id"]: r["outcome"] for r in spark.read.parquet(f"{root}/outcomes").collect()}
    batch = review.command_outcomes(
        commands(spark, *[c for b in batches for c in b]), docs, heads, items)
    assert got == {r["command_id"]: r["outcome"] for r in batch.collect()}
    assert got == {"c1": "OK", "c2": "BLOCKED", "c3": "BLOCKED", "c4": "OK", "c5": "OK",
                   "c6": "OK", "c7": "OK", "c8": "CONFLICT"}


def test_keyed_decisions_equal_one_batch_and_survive_a_restart(spark, tmp_path):
    r = random.Random(4)
    patches = ['{"total": "999.00"}', '{"total": "115.00"}', '{"line_items": []}', '{"tax": null}',
               '{"line_items": [{"quantity": 1, "unit_price": 1, "amount": 9}]}', '{"currency": "TOO-LONG-ONE"}',
               '{"subtotal": "abc"}', "{}", '{"subtotal": "100.00", "tax": 15}']
    made = []
    for i in range(90):
        kind = r.choice(["EDIT", "EDIT", "EDIT", "APPROVE", "REJECT", "OTHER"])
        made.append({
            "command_id": f"c{i:03}", "document_id": r.choice(["d1", "d2", "d3", "d4", "d5", "d6", "nobody", None]),
            "kind": kind, "issued_at": T0 + timedelta(minutes=i // 2), "organization_id": r.choice(["a"] * 9 + ["b"]),
            "patch": r.choice(patches) if kind == "EDIT" else None,
            "reason": r.choice(["wrong", ""]) if kind == "REJECT" else None, "user_id": f"u{i % 3}"})
    made = [c for i, c in enumerate(made) if c["kind"] != "REJECT" or i > 60]
    docs = documents(spark, *[document(f"d{i}") for i in range(1, 5)], document("d5", status="FAILED"), document("d6"))
    heads = invoices(spark, *[invoice(f"i{i}", total=Decimal(t)) for i, t in enumerate(
        ["115.00", "1.00", "115.00", "115.00", "115.00"], 1)])
    items = lines(spark, line("l1", "i1"), line("l2", "i2"), line("l3", "i3", amount="7.00"))
    schema = schemas.COMMANDS

    def feed(rows):
        commands(spark, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        keyed.start_keyed_decisions(
            stream, str(tmp_path / "out"), str(tmp_path / "cp"), docs, heads, items).awaitTermination()

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    thirds = [made[i * len(made) // 3:(i + 1) * len(made) // 3] for i in range(3)]
    for rows in thirds:  # each a run of its own, from the checkpoint
        feed(rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = review.command_outcomes(commands(spark, *made), docs, heads, items)
    assert {x["command_id"]: x["outcome"] for x in got.collect()} == {
        x["command_id"]: x["outcome"] for x in batch.collect()}
    assert sorted(map(str, review.decisions(got).collect())) == sorted(map(str, review.decisions(batch).collect()))
    assert {x["outcome"] for x in got.collect()} == {
        "INVALID", "NOT_FOUND", "CONFLICT", "MISSING_DRAFT", "BLOCKED", "SAVE_FAILED", "OK"}


def test_keyed_state_holds_only_documents_that_commands_changed(spark, tmp_path):
    docs = documents(spark, *[document(f"d{i}") for i in range(1, 41)], document("d99", status="FAILED"))
    heads = invoices(spark, *[invoice(f"i{i}") for i in range(1, 41)])
    rows = [{"command_id": "c1", "document_id": "d1", "kind": "REJECT", "reason": "r", "issued_at": T0},
            {"command_id": "c2", "document_id": "d99", "kind": "APPROVE", "issued_at": T0},
            {"command_id": "c3", "document_id": "nobody", "kind": "APPROVE", "issued_at": T0}]
    stream = _feed(spark, [commands(spark, *rows)], str(tmp_path / "in"), schemas.COMMANDS)
    query = keyed.start_keyed_decisions(
        stream, str(tmp_path / "out"), str(tmp_path / "cp"), docs, heads, lines(spark, line("l1", "i1")))
    query.awaitTermination()
    got = {r["command_id"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"c1": "OK", "c2": "CONFLICT", "c3": "NOT_FOUND"}
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 1


def test_workspace_needs_a_shared_folder_off_local_mode(spark, monkeypatch):
    from docledger.sources import workspace

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_folder(Session())
    assert json.dumps(workspace.new_path(spark, "x")).count("docledger/x-") == 1
