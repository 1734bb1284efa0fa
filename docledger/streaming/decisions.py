"""Continuous review decisions: the first valid one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docledger.operators import review
from docledger.sources.workspace import persisted


def _batch_path(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table}/batch_id={batch_id}"


def _earlier(commands: DataFrame, root: str, table: str, schema: str, batch_id: int) -> DataFrame:
    """Rows that earlier batches wrote about the documents of this one."""
    named = commands.select("document_id").distinct()
    return (
        commands.sparkSession.read.schema(f"{schema}, batch_id bigint")
        .parquet(f"{root}/{table}")
        .where(F.col("batch_id") < batch_id)
        .join(named, "document_id", "left_semi")
    )


def process_batch(
    commands: DataFrame, batch_id: int, root: str,
    documents: DataFrame, invoices: DataFrame, lines: DataFrame,
) -> None:
    """Apply one batch of commands.

    The state is two tables: the decisions so far, one row per decided document,
    and the saved edits. Neither expires: a decided document must keep refusing
    commands, and an approval is judged on all edits before it. Both are joined, not
    held in a task, for documents of this batch only. The batch itself goes through
    the same outcome operator as any batch job, so a document with very many commands
    is spread out there. Writes go under the batch number, so a replay replaces its
    own rows.
    """
    spark = commands.sparkSession
    # What a batch names is kept, so that its small size is known and the tables are not
    # shuffled to find a few of their rows.
    named = persisted(commands.select("document_id").distinct(), "named")
    documents = persisted(documents.join(named, "document_id", "left_semi"), "named-documents")
    invoices = persisted(invoices.join(named, "document_id", "left_semi"), "named-drafts")
    own = persisted(invoices.select("invoice_id"), "named-invoices")
    lines = persisted(lines.join(own, "invoice_id", "left_semi"), "named-lines")
    if batch_id > 0:
        key = documents.schema["document_id"].dataType.simpleString()
        decided = _earlier(
            commands, root, "decisions", f"document_id {key}, status string", batch_id,
        ).select("document_id", F.col("status").alias("_decided"))
        documents = documents.join(decided, "document_id", "left").withColumn(
            "status", F.coalesce("_decided", "status")
        ).drop("_decided")
        edits = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in commands.schema.fields)
        edits = _earlier(
            commands, root, "edits", f"{edits}, outcome string", batch_id).drop("batch_id")
        lines = review.patched_lines(lines, invoices, edits)
        invoices = review.patched_headers(invoices, edits)
    outcomes = review.command_outcomes(commands, documents, invoices, lines)
    outcome_path = _batch_path(root, "outcomes", batch_id)
    outcomes.write.mode("overwrite").parquet(outcome_path)
    kept = spark.read.schema(outcomes.schema).parquet(outcome_path)
    review.saved_edits(kept).write.mode("overwrite").parquet(_batch_path(root, "edits", batch_id))
    review.decisions(kept).write.mode("overwrite").parquet(
        _batch_path(root, "decisions", batch_id)
    )


def start_decisions(
    commands: DataFrame, root: str, checkpoint: str,
    documents: DataFrame, invoices: DataFrame, lines: DataFrame,
    every: str | None = None,
) -> StreamingQuery:
    """`every` (such as '1 minute') keeps the query running; without it the query
    takes what is there and ends."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by each of the three writes
        try:
            process_batch(batch, batch_id, root, documents, invoices, lines)
        finally:
            batch.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        commands.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
