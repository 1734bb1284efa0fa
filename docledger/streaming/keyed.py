"""Continuous review decisions with the state of each document in the state store.

The state of a document is what its next command depends on: status, tenant, the amounts
as edited so far and whether its lines are wrong. A document without one starts from the
stored tables, which are joined to the commands; its state is carried from batch to batch by
Spark as soon as a command changes it. Commands that the stored tables alone refuse never
reach a task's fold. `decisions.py` is the other way: state in tables, no keyed task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from docledger import fixed
from docledger.operators import review
from docledger.sources.workspace import persisted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STATE = (
    "status string, owner string, drafted boolean, subtotal decimal(14,2), tax decimal(14,2), "
    "total decimal(14,2), bad_lines boolean"
)
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Plain values, so that Python workers need not have the package installed.
_OPEN, _MONEY, _TOLERANCE = review.OPEN_STATUS, tuple(fixed.MONEY_FIELDS), Decimal(fixed.TOLERANCE)
_COLUMNS = tuple(c.split()[0] for c in _STATE.split(", "))


class _Fold(StatefulProcessor):
    """The commands of one document in order; its state is a row of _STATE. The rows bring
    the stored state along, for a document that has no other."""

    def init(self, handle) -> None:
        self._state = handle.getValueState("review", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = before = None
        for row in sorted(rows, key=lambda r: (r.issued_at, r.command_id)):
            if state is None:
                kept = self._state.get()
                state = list(kept) if kept is not None else [row[f"base_{c}"] for c in _COLUMNS]
                before = tuple(state)
            outcome = _outcome(row, state)
            if outcome == "OK":
                _apply(row, state)
            yield Row(command_id=row.command_id, document_id=row.document_id, user_id=row.user_id,
                      kind=row.kind, issued_at=row.issued_at, reason=row.reason, outcome=outcome)
        if state is not None and tuple(state) != before:
            self._state.update(tuple(state))

    def close(self) -> None:
        pass


def _settled() -> Column:
    """The outcome of commands that no other command can change; NULL for the others."""
    same_tenant = F.coalesce(F.col("base_owner") == F.col("organization_id"), F.lit(False))
    is_open = F.coalesce(F.col("base_status") == _OPEN, F.lit(False))
    return (
        F.when(F.col("invalid"), "INVALID").when(~same_tenant, "NOT_FOUND")
        .when(~is_open, "CONFLICT").when(~F.col("base_drafted"), "MISSING_DRAFT")
    )


def _outcome(row: Row, state: list) -> str:
    if state[0] != _OPEN:
        return "CONFLICT"
    if row.kind == "APPROVE":
        subtotal, tax, total = state[3:6]
        known = subtotal is not None and tax is not None and total is not None
        if state[6] or (known and abs(subtotal + tax - total) > _TOLERANCE):
            return "BLOCKED"
    return "SAVE_FAILED" if row.unfit else "OK"


def _apply(row: Row, state: list) -> None:
    if row.kind == "EDIT":
        for i, name in enumerate(_MONEY):
            if row[f"set_{name}"] is not None:
                state[3 + i] = row[f"set_{name}"]["v"]
        if row.set_bad_lines is not None:
            state[6] = row.set_bad_lines
    else:
        state[0] = "APPROVED" if row.kind == "APPROVE" else "REJECTED"


def first_states(documents: DataFrame, invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """The state of every stored document: document_id and the columns of _STATE."""
    drafts = review.draft_state(invoices, lines)
    return documents.select(
        "document_id", "status", F.col("organization_id").cast("string").alias("owner"),
    ).join(drafts, "document_id", "left").select(
        "document_id", "status", "owner", F.coalesce("_draft", F.lit(False)).alias("drafted"),
        *[F.col(f"_base_{n}").cast("decimal(14,2)").alias(n) for n in fixed.MONEY_FIELDS],
        F.coalesce("_base_bad_lines", F.lit(False)).alias("bad_lines"))


@contextmanager
def _rocks(spark: SparkSession):
    """Keyed state of this kind needs that store; a query keeps the setting it starts with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)


def keyed_outcomes(commands: DataFrame, states: DataFrame) -> DataFrame:
    """Outcome of every command of a stream; `states` comes from `first_states` and should
    be a kept table, as each batch is joined to it.

    Commands act in order of (issued_at, command_id) within a batch and of batches among
    each other. One task holds a document's commands of one batch. A command without a
    document_id is of no document.
    """
    kinds = {f.name: f.dataType.simpleString() for f in commands.schema.fields}
    columns = ("command_id", "document_id", "user_id", "kind", "issued_at", "reason")
    ddl = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", outcome string"
    checked = review.checked_commands(commands).select(
        *columns, F.col("organization_id").cast("string").alias("organization_id"),
        F.col("_invalid").alias("invalid"), F.col("_unfit").alias("unfit"),
        *[F.col(f"_set_{n}").alias(f"set_{n}") for n in _MONEY],
        F.col("_set_bad_lines").alias("set_bad_lines"))
    met = checked.join(
        states.withColumnsRenamed({c: f"base_{c}" for c in _COLUMNS}), "document_id", "left")
    folded = met.where(_settled().isNull()).groupBy("document_id").transformWithState(
        _Fold(), ddl, "Append", "None")
    settled = met.where(_settled().isNotNull()).select(*columns, _settled().alias("outcome"))
    return folded.unionByName(settled)


def start_keyed_decisions(
    commands: DataFrame, path: str, checkpoint: str,
    documents: DataFrame, invoices: DataFrame, lines: DataFrame, every: str | None = None,
) -> StreamingQuery:
    """Append the outcomes of a stream of commands to a table at `path`, each once.

    `review.decisions` of that table are the decisions. `every` (such as '1 minute')
    keeps the query running; without it the query takes what is there and ends. The stored
    tables are read once a start; what commands did to a document counts before them.
    """
    states = persisted(first_states(documents, invoices, lines), "first-states")
    trigger = {"processingTime": every} if every else {"availableNow": True}
    with _rocks(commands.sparkSession):
        return (
            keyed_outcomes(commands, states).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start()
        )
