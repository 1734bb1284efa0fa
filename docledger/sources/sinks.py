"""Writers for text artifacts and exports."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.operators.export import export_order, for_writing

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_text_artifacts(parts: DataFrame, path: str) -> None:
    """Write extracted text by tenant: (organization_id, storage_key, part_no, part_text).

    Ranges over tenant and document keep a tenant's files few and split a large
    tenant over tasks.
    """
    keys = ["organization_id", "document_id", "part_no"]
    (
        parts.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .partitionBy("organization_id")
        .parquet(path)
    )


def write_csv_export(csv_rows: DataFrame, path: str) -> None:
    """Write CSV lines by tenant; a tenant's files in name order are its export."""
    keys = [F.col("organization_id"), F.col("is_body"), *export_order()]
    (
        csv_rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("organization_id", "value")
        .write.mode("overwrite")
        .partitionBy("organization_id")
        .option("lineSep", "\r\n")
        .text(path)
    )


def write_cell_export(cell_rows: DataFrame, path: str) -> None:
    """Write the all-text export table by tenant."""
    rows = for_writing(cell_rows)
    rows = rows.drop(*[c for c in rows.columns if c.startswith("_")])
    rows.write.mode("overwrite").partitionBy("organization_id").parquet(path)


def write_files(files: DataFrame, root: str) -> int:
    """Store (storage_key, content) as one file each under `root`; how many there are.

    The tasks write the files where they belong, so that very many need neither a move
    each nor a process each. A retried task writes the same files again.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root.rstrip("/")))
        for batch in batches:
            for key, content in zip(batch["storage_key"], batch["content"], strict=True):
                store.create_dir(f"{base}/{key}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{key}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    written = files.select("storage_key", "content").mapInPandas(write, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
