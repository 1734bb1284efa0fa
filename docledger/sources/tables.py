"""Table scans and appends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from docledger import schemas


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one of the six tables with its declared schema (no inference)."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Append rows; documents are laid out by tenant so tenant reads prune."""
    _writer(df, name).mode("append").parquet(f"{root.rstrip('/')}/{name}")


def replace_table(df: DataFrame, root: str, name: str) -> None:
    """Store `df` as the whole table, also if it was read from that table.

    The rows go to a new folder first; only when they are complete does it take the
    table's place, and the former rows are removed last.
    """
    spark = df.sparkSession
    base = f"{root.rstrip('/')}/{name}"
    mark = uuid.uuid4().hex
    _writer(df, name).parquet(f"{base}-new-{mark}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    former = path(f"{base}-old-{mark}")
    if system.exists(path(base)) and not system.rename(path(base), former):
        raise OSError(f"cannot move {base} aside")
    if not system.rename(path(f"{base}-new-{mark}"), path(base)):
        system.rename(former, path(base))
        raise OSError(f"cannot move the new rows to {base}")
    system.delete(former, True)
    spark.catalog.refreshByPath(base)


def _writer(df: DataFrame, name: str) -> DataFrameWriter:
    if name != "documents":
        return df.write
    # Ranges keep a tenant's rows together, and split a large tenant by document.
    return df.repartitionByRange("organization_id", "document_id").write.partitionBy(
        "organization_id")
