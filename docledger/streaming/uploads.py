"""Continuous upload gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docledger.operators.gate import gate


def start_gate(uploads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Gate a stream of upload candidates into a table at `path`.

    The gate is one expression per row, so the stream keeps no state; the file
    sink commits each batch once.
    """
    return (
        gate(uploads)
        .select("upload_id", "organization_id", "reject_reason")
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
