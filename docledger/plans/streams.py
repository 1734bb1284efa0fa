"""Queries that run the streaming twins over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger import fixed
from docledger.operators import review
from docledger.plans.extraction import TEXT_FAILURE_SQL
from docledger.plans.review import DECISIONS_SQL
from docledger.plans.samples import LengthExtractor
from docledger.plans.shown import shown
from docledger.plans.standins import (
    COMMAND_TENANT,
    COMMANDS,
    DRIVER_TABLES,
    TEXTS,
    UPLOADS,
    ctes,
    driver_table,
    frame,
    spark_list,
)
from docledger.plans.uploads import ORACLES as UPLOAD_ORACLES
from docledger.plans.uploads import id_sql
from docledger.sources.workspace import new_path
from docledger.streaming.chain import read_findings, start_chain
from docledger.streaming.decisions import start_decisions
from docledger.streaming.keyed import start_keyed_decisions
from docledger.streaming.uploads import start_gate

BATCHES = 4
ROWS_PER_FILE, MOST_FILES = 100_000, 64


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as a stream; it may be one file or a folder of files.

    A stream's path must be a folder unless it is a pattern, so the name is written as one.
    """
    return spark.readStream.schema(DRIVER_TABLES[table]).parquet(f"{sf_dir}/{table}.parque[t]")


def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "stream-gate")
    uploads = _stream(spark, sf_dir, "documents").selectExpr(*spark_list(UPLOADS))
    start_gate(uploads, f"{root}/gated", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(
        "upload_id bigint, organization_id string, reject_reason string"
    ).parquet(f"{root}/gated")


def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "stream-chain")
    texts = _stream(spark, sf_dir, "documents").selectExpr(*spark_list(TEXTS))
    start_chain(texts, root, f"{root}/checkpoint", LengthExtractor).awaitTermination()
    return read_findings(spark, root)


def _commands(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """The commands as a stream of BATCHES batches, in order of time: edits and approvals of
    a document come in different batches. A large batch is several files, each of many rows,
    and all batches have the same number of files."""
    owners = frame(spark, sf_dir, "documents").selectExpr(
        "document_id", "organization_id AS owner_id"
    )
    raw = driver_table(spark, sf_dir, "events")
    first, last = raw.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * i / BATCHES for i in range(1, BATCHES)] if first else []
    bounds = [F.lit(c).cast("timestamp_ntz") for c in cuts]
    windows = []
    for low, high in zip([None, *bounds], [*bounds, None]):
        since = F.lit(True) if low is None else F.col("ts") > low
        windows.append(since if high is None else since & (F.col("ts") <= high))
    least = min(raw.agg(*[F.count_if(w) for w in windows]).first())
    files = max(1, min(MOST_FILES, least // ROWS_PER_FILE))
    for window in windows:
        raw.where(window).repartition(files).write.mode("append").parquet(f"{root}/in")
    return (
        spark.readStream.schema(DRIVER_TABLES["events"]).option("maxFilesPerTrigger", files)
        .parquet(f"{root}/in").selectExpr(*spark_list(COMMANDS))
        .join(owners, "document_id", "left")
        .selectExpr(*COMMANDS, f"{COMMAND_TENANT} AS organization_id")
    )


def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "stream-decisions")
    start_decisions(
        _commands(spark, sf_dir, root), root, f"{root}/checkpoint", frame(spark, sf_dir, "documents"),
        frame(spark, sf_dir, "drafts"), frame(spark, sf_dir, "lines"),
    ).awaitTermination()
    return shown(spark.read.schema(
        "document_id bigint, status string, approved_at timestamp, approved_by_user_id bigint, "
        "rejected_at timestamp, rejected_by_user_id bigint, rejection_reason string"
    ).parquet(f"{root}/decisions").drop("batch_id"))


def stream_keyed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions with the state of each document in the state store."""
    root = new_path(spark, "stream-keyed")
    start_keyed_decisions(
        _commands(spark, sf_dir, root), f"{root}/outcomes", f"{root}/checkpoint",
        frame(spark, sf_dir, "documents"), frame(spark, sf_dir, "drafts"),
        frame(spark, sf_dir, "lines"),
    ).awaitTermination()
    return shown(review.decisions(spark.read.schema(
        "command_id bigint, document_id bigint, user_id bigint, kind string, issued_at timestamp, "
        "reason string, outcome string").parquet(f"{root}/outcomes")))


QUERIES = {
    "stream_gate": stream_gate,
    "stream_chain": stream_chain,
    "stream_decisions": stream_decisions,
    "stream_keyed_decisions": stream_keyed_decisions,
}

_UNFILLED = ("vendor_address", "customer_name", "invoice_number", "invoice_date", "due_date",
             "payment_terms")
_EXPECTED = "\nUNION ALL\n".join(
    f"SELECT invoice_id, 'WARNING' AS severity, CAST({fixed.HEADER_FIELDS.index(n)} AS BIGINT) "
    f"AS ord, '{n}' AS field, 'FIELD_MISSING' AS code, '{n}{fixed.MISSING_SUFFIX}' AS message "
    "FROM good" for n in _UNFILLED
)

ORACLES = {
    "stream_chain": f"""WITH {ctes('texts')},
sized AS (SELECT document_id, CAST(length(text) AS BIGINT) AS n FROM texts
  WHERE {TEXT_FAILURE_SQL} IS NULL),
good AS (SELECT {id_sql('invoice', 'document_id')} AS invoice_id, n FROM sized
  WHERE n % 19 <> 0 AND n % 23 <> 0 AND n % 29 <> 0)
{_EXPECTED}
UNION ALL
SELECT invoice_id, 'ERROR', 0, 'total', 'TOTAL_MISMATCH', 'subtotal (' || n || '.00) + tax (1.50) = '
  || (n + 1) || '.50, which does not match total (' || (n + 2) || '.50).' FROM good
  WHERE n % 2 = 1""",
    "stream_gate": UPLOAD_ORACLES["upload_gate"],
    "stream_decisions": DECISIONS_SQL,
    "stream_keyed_decisions": DECISIONS_SQL,
}
