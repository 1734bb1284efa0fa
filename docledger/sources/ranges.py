"""Pages of stored files in ranges, so that one huge file is the work of many tasks.

Files are opened where they lie and read as far as a range needs; their bytes do not
pass through a row. One pass asks every file how many pages it has, then each range of
pages is a row of its own.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from typing import BinaryIO, Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGES_PER_RANGE = 200


class RangeReader(Protocol):
    def count(self, file: BinaryIO) -> int:
        """Pages of an open, seekable file."""

    def read(self, file: BinaryIO, first: int, stop: int) -> list[str | None]:
        """Texts of pages first to stop - 1; None for a page that cannot be read."""


def _opened(root: str):
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root.rstrip("/")))
    return lambda key: store.open_input_file(f"{base}/{key}")


def page_ranges(
    files: DataFrame, root: str, factory: Callable[[], RangeReader],
    pages_per_range: int = PAGES_PER_RANGE,
) -> DataFrame:
    """(document_id, storage_key) to rows (document_id, storage_key, first, stop,
    open_failed): ranges of pages, one row without a range for a file that cannot be
    opened or counted, none for a file without pages."""
    key = files.schema["document_id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, opened = factory(), _opened(root)
        for batch in batches:
            found = []
            for storage_key in batch["storage_key"]:
                try:
                    with opened(storage_key) as file:
                        found.append(reader.count(file))
                except Exception:
                    found.append(None)
            yield batch.assign(pages=pd.Series(found, dtype="Int64"))

    counted = files.select("document_id", "storage_key").mapInPandas(
        count, f"document_id {key}, storage_key string, pages bigint")
    size = F.lit(pages_per_range)
    firsts = F.when(F.col("pages") > 0, F.sequence(
        F.lit(0).cast("bigint"), F.col("pages") - 1, size.cast("bigint"))).when(
        F.col("pages").isNull(), F.array(F.lit(None).cast("bigint")))
    return counted.select(
        "document_id", "storage_key", "pages", F.explode(firsts).alias("first"),
    ).select(
        "document_id", "storage_key", "first", F.least(F.col("first") + size, "pages").alias("stop"),
        F.col("pages").isNull().alias("open_failed"))


def read_page_ranges(
    ranges: DataFrame, root: str, factory: Callable[[], RangeReader], tasks: int | None = None,
) -> DataFrame:
    """Rows of `page_ranges` to one row per page, as `hooks.read_pages` gives them.

    The ranges of a file are dealt over `tasks` tasks (by default the session's shuffle
    partitions) by a hash of file and range. A range that fails has all its pages marked.
    """
    key = ranges.schema["document_id"].dataType.simpleString()
    names = ["document_id", "page_no", "text", "page_error", "open_failed"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, opened = factory(), _opened(root)
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.open_failed:
                    rows = [(row.document_id, None, None, False, True)]
                else:
                    first, stop = int(row.first), int(row.stop)
                    try:
                        with opened(row.storage_key) as file:
                            texts = reader.read(file, first, stop)
                    except Exception:
                        texts = [None] * (stop - first)
                    rows = [(row.document_id, first + i, t, t is None, False)
                            for i, t in enumerate(texts)]
                yield pd.DataFrame(rows, columns=names).astype({"page_no": "Int32"})

    # A range is a few bytes and a lot of work: without a number, adaptive execution would
    # put all of them into one task.
    tasks = tasks or int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.repartition(tasks, "storage_key", "first")
    return dealt.mapInPandas(
        read, f"document_id {key}, page_no int, text string, page_error boolean, open_failed boolean")
