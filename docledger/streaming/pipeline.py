"""Continuous processing: stored files to texts, drafts, findings and job rows.

Every micro-batch goes through the batch path. Its tables are written under the number
of the batch, and one marker, written last, makes them count: readers see all tables of a
batch or none, and a batch that is replayed after its marker does nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docledger.operators import processing
from docledger.sources.ledger import Ledger, drop_ledger

_MARKER = "batch_id bigint"


def _path(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table}/batch_id={batch_id}"


def committed(spark: SparkSession, root: str) -> DataFrame:
    """batch_id of every batch that counts."""
    try:
        return spark.read.schema(_MARKER).parquet(f"{root}/commits").distinct()
    except AnalysisException:
        return spark.createDataFrame([], _MARKER)


def results(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """Rows of one of processing.RESULTS from all batches that count, with batch_id."""
    try:
        rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{root}/{table}")
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch_id bigint")
    # One row per batch: compare a handful of numbers with the partitions' names.
    ids = [r["batch_id"] for r in committed(spark, root).collect()]
    return rows.where(F.col("batch_id").isin(ids))


def _key(documents: DataFrame) -> str:
    return f"document_id {documents.schema['document_id'].dataType.simpleString()}"


def _run_batch(
    spark: SparkSession, batch_id: int, root: str, documents: DataFrame, rows: DataFrame,
    existing: DataFrame, used: processing.Hooks, run: processing.Run,
) -> None:
    def keep(df: DataFrame, name: str) -> DataFrame:
        path = _path(root, name, batch_id)
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    ledger = Ledger(_path(root, "ledger", batch_id))
    earlier = results(spark, root, "invoices", _key(documents)).where(
        F.col("batch_id") != batch_id).select("document_id")
    drafted = earlier.unionByName(existing.select("document_id")).join(
        documents.select("document_id"), "document_id", "left_semi")
    processing.process(documents, rows, drafted, used, run, keep, ledger)
    spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id")).coalesce(
        1).write.mode("append").parquet(f"{root}/commits")
    drop_ledger(spark, ledger)


def _counts(spark: SparkSession, root: str, batch_id: int) -> bool:
    return not committed(spark, root).where(F.col("batch_id") == batch_id).isEmpty()


def process_batch(
    files: DataFrame, batch_id: int, root: str, documents: DataFrame, existing: DataFrame,
    used: processing.Hooks, run: processing.Run,
) -> None:
    """Process the documents of one batch of files (storage_key, content).

    The files' bytes are read once, by the reader; everything else starts from its rows.
    A document of an earlier batch whose file comes again is read again and not asked
    about again. Answers of an attempt that failed are taken from the batch's ledger.
    """
    spark = files.sparkSession
    if _counts(spark, root, batch_id):
        return
    rows_path = _path(root, "pages", batch_id)
    rows = processing.read_files(files, used)
    rows.write.mode("overwrite").parquet(rows_path)
    rows = spark.read.schema(rows.schema).parquet(rows_path)
    named = rows.where("kind = 'file'").select("storage_key").distinct()
    own = documents.join(named, "storage_key", "left_semi")
    _run_batch(spark, batch_id, root, own, rows, existing, used, run)


def process_missing(
    spark: SparkSession, root: str, documents: DataFrame, existing: DataFrame,
    used: processing.Hooks, run: processing.Run,
) -> None:
    """Fail the documents whose file no batch has seen, as a batch of its own.

    Such batches have negative numbers, so that they never meet those of the stream. A
    file that comes later is processed by the stream as usual.
    """
    seen = results(spark, root, "document_statuses", _key(documents)).select("document_id")
    least = committed(spark, root).agg(F.min("batch_id")).first()[0]
    batch_id = min(least if least is not None else 0, 0) - 1
    rows = processing.read_files(
        spark.createDataFrame([], "storage_key string, content binary"), used)
    missing = documents.join(seen, "document_id", "left_anti")
    _run_batch(spark, batch_id, root, missing, rows, existing, used, run)


def start_pipeline(
    files: DataFrame, root: str, checkpoint: str, documents: DataFrame, existing: DataFrame,
    used: processing.Hooks, run: processing.Run, every: str | None = None,
) -> StreamingQuery:
    """Process a stream of stored files; `every` (such as '1 minute') keeps it running,
    without it the query takes what is there and ends."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, root, documents, existing, used, run)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        files.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
