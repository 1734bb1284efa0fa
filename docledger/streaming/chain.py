"""Continuous extraction: texts to answers to drafts and findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docledger.operators import extract, findings
from docledger.operators.hooks import Extractor, run_extractor


def _batch_path(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table}/batch_id={batch_id}"


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _so_far(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """Rows of a table that earlier batches or attempts have written."""
    full = f"{schema}, batch_id bigint"
    try:
        return spark.read.schema(full).parquet(f"{root}/{table}")
    except AnalysisException:
        return spark.createDataFrame([], full)


def process_batch(
    texts: DataFrame, batch_id: int, root: str, factory: Callable[[], Extractor]
) -> None:
    """One batch: ask once per new document, keep the answers, then derive.

    Answers are kept before anything is made of them, and a document with a kept
    answer is not asked about again, neither in a later batch nor when this one
    is replayed. Derived tables are written under the batch number, so a replay
    replaces its own rows.
    """
    spark = texts.sparkSession
    key = texts.schema["document_id"].dataType.simpleString()
    answer_schema = f"document_id {key}, raw_json string, error_kind string"
    answered = _so_far(spark, root, "answers", answer_schema).select("document_id")
    # A batch may repeat a document; the smallest text stands for it.
    new = (
        extract.requests(texts)
        .join(answered, "document_id", "left_anti")
        .groupBy("document_id").agg(F.min("request_text").alias("request_text"))
    )
    answers_path = _batch_path(root, "answers", batch_id)
    run_extractor(new, factory).write.mode("append").parquet(answers_path)
    answers = spark.read.schema(answer_schema).parquet(answers_path)
    parsed = extract.with_extraction_outcome(extract.parse_payload(answers, "raw_json"))
    kept = _kept(parsed, _batch_path(root, "parsed", batch_id))
    good = kept.where(F.col("error_message").isNull())
    headers = _kept(extract.draft_headers(good), _batch_path(root, "invoices", batch_id))
    lines = _kept(extract.draft_lines(good), _batch_path(root, "invoice_line_items", batch_id))
    findings.all_findings(headers, lines).write.mode("overwrite").parquet(
        _batch_path(root, "findings", batch_id)
    )


def start_chain(
    texts: DataFrame, root: str, checkpoint: str, factory: Callable[[], Extractor]
) -> StreamingQuery:
    def handle(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, root, factory)

    return (
        texts.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_findings(spark: SparkSession, root: str) -> DataFrame:
    schema = (
        "invoice_id string, severity string, ord bigint, field string, code string, "
        "message string"
    )
    return _so_far(spark, root, "findings", schema).drop("batch_id")
