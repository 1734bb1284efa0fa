"""Stored files: listing, bytes, and joining them to documents.

Spark's own file reader keeps a record of every file on the driver, and its stream one of
every file it has ever seen. Here tasks list the folders and read the files; the names lie
in tables, and a stream reads lists of names, a batch each.
"""

from __future__ import annotations

import contextlib
import os
import re
import stat
import sys
import uuid
from collections.abc import Iterator
from functools import reduce
from threading import Thread

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docledger import fixed
from docledger.functions.groups import number_in_group
from docledger.sources.workspace import persisted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Stores that tasks can open by themselves; others go through Spark's own reader.
TASK_STORES = ("file", "s3", "gs", "abfs", "abfss")
_CHUNK_BYTES, _CHUNK_ROWS = 8 << 20, 10_000
_LIST = "storage_key string, length bigint"


def _qualified(spark: SparkSession, root: str) -> str:
    """`root` as the file system itself writes it in the paths of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/") + "/"


def _for_tasks(spark: SparkSession, root: str) -> str | None:
    """`root` as tasks open it, None if its store is not one of TASK_STORES."""
    base = _qualified(spark, root).rstrip("/")
    scheme = base.partition(":")[0]
    if scheme not in TASK_STORES:
        return None
    # A plain path may hold what a URI may not.
    return re.sub("^file:/*", "/", base) if scheme == "file" else base


def _hidden(name: str, is_folder: bool) -> bool:
    """Whether Spark's sources leave out a file or folder of this name."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (
        name.startswith("_") and "=" not in name)


def _entries(root: str, folder: str) -> Iterator[tuple[str, int | None, int]]:
    """(name, length, time of change in ms) of what lies in a folder; folders have no length."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    if store.type_name != "local":
        for x in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
            is_folder = x.type == fs.FileType.Directory
            yield x.base_name, None if is_folder else x.size, (x.mtime_ns or 0) // 1_000_000
        return
    with os.scandir(f"{base}/{folder}") as found:  # one by one, however many there are
        for x in found:
            try:
                info = x.stat()
            except FileNotFoundError:  # gone by now, or a link to nothing
                continue
            yield (x.name, None if stat.S_ISDIR(info.st_mode) else info.st_size,
                   info.st_mtime_ns // 1_000_000)


def _tasks(spark: SparkSession) -> int:
    # Names are a few bytes each: without a number, adaptive execution would put them all,
    # and the work on their files, into one task.
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(storage_key, length, modified) of all files under `root`, one of TASK_STORES.

    `modified` is in milliseconds. Folders are listed level by level, those of a level dealt
    over the tasks, and the levels are kept as tables. Hidden names and empty files are left
    out, as Spark's sources leave them out.
    """
    base = _for_tasks(spark, root)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["storage_key", "length", "modified"])
            rows.clear()
            return out.astype({"length": "Int64"})

        for batch in batches:
            for folder in batch["storage_key"]:
                try:
                    for name, length, modified in _entries(base, folder):
                        if not _hidden(name, length is None):
                            rows.append((f"{folder}/{name}" if folder else name, length, modified))
                        if len(rows) >= _CHUNK_ROWS:
                            yield frame()
                except FileNotFoundError:
                    if not folder:
                        raise
        if rows:
            yield frame()

    folders = spark.range(0, 1, 1, 1).select(F.lit("").alias("storage_key"))
    levels: list[DataFrame] = []
    while not levels or not folders.isEmpty():
        dealt = folders.repartition(_tasks(spark), "storage_key") if levels else folders
        levels.append(persisted(
            dealt.mapInPandas(entries, f"{_LIST}, modified bigint"), "listed-files"))
        folders = levels[-1].where("length IS NULL").select("storage_key")
    return reduce(DataFrame.unionByName, levels).where("length > 0")


def _with_content(names: DataFrame, base: str) -> DataFrame:
    """(storage_key, length) to (storage_key, length, content), read where the names are dealt."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(base)
        rows: list[tuple] = []
        held = 0

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["storage_key", "length", "content"])
            rows.clear()
            return out

        for batch in batches:
            for key, length in zip(batch["storage_key"], batch["length"], strict=True):
                with store.open_input_file(f"{folder}/{key}") as file:
                    content = file.read()
                rows.append((key, length, content))
                held += len(content)
                if held >= _CHUNK_BYTES or len(rows) >= _CHUNK_ROWS:
                    yield frame()
                    held = 0
        if rows:
            yield frame()

    dealt = names.select("storage_key", "length").repartition(
        _tasks(names.sparkSession), "storage_key")
    return dealt.mapInPandas(read, f"{_LIST}, content binary")


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of any size under `root` as (storage_key, length, content).

    How large a file may be is the gate's rule, not this reader's. The files are those that
    are there now. A file that is gone when it is read fails the job. Where only names and
    lengths are wanted, `listed_files` reads no content.
    """
    base = _for_tasks(spark, root)
    if base is not None:
        return _with_content(listed_files(spark, root), base)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(_qualified(spark, root))
    )
    return files.select(storage_key(spark, root), "length", "content")


def stored_file_stream(
    spark: SparkSession, root: str, files_per_batch: int, lists: str | None = None,
) -> DataFrame:
    """New files under `root` as a stream of (storage_key, length, content), oldest first.

    With `lists`, a folder that belongs to one stream as its checkpoint does, tasks list the
    files and the driver's memory does not follow their number; `follow_files` lists those
    that come later. Without it Spark's own source finds them and keeps a record of each file
    on the driver, as it does for a store that is none of TASK_STORES.
    """
    base = _for_tasks(spark, root) if lists else None
    if base is not None:
        list_new_files(spark, root, files_per_batch, lists)
        names = spark.readStream.schema(_LIST).option("maxFilesPerTrigger", 1).parquet(lists)
        return _with_content(names, base)
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(_qualified(spark, root))
    )
    return files.select(storage_key(spark, root), "length", "content")


def list_new_files(spark: SparkSession, root: str, files_per_batch: int, lists: str) -> int:
    """Add the files under `root` that no list has to `lists`; how many there are.

    A list is one file of at most `files_per_batch` names, which appears whole and is not
    changed again; older files come in earlier lists. Names whose list did not appear,
    because the driver died, are listed the next time. One writer at a time.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(lists).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(lists))
    known = spark.read.schema(_LIST).parquet(lists).select("storage_key")
    new = persisted(
        listed_files(spark, root).join(known, "storage_key", "left_anti"), "new-files")
    count = new.count()
    if not count:
        return 0
    numbered = number_in_group(
        new.withColumn("_all", F.lit(0)), "_all", [F.col("modified"), F.col("storage_key")], "at")
    made = f"{lists}/_{uuid.uuid4().hex}"
    numbered.select(
        "storage_key", "length", F.floor(F.col("at") / files_per_batch).alias("list"),
    ).repartition("list").write.option("maxRecordsPerFile", 0).partitionBy("list").parquet(made)
    now = spark._jvm.System.currentTimeMillis()
    for i in range(-(-count // files_per_batch)):
        (file,) = (x.getPath() for x in system.globStatus(path(f"{made}/list={i}/part-*")))
        system.setTimes(file, now + i, -1)  # a stream takes its files in this order
        if not system.rename(file, path(f"{lists}/{now + i}-{uuid.uuid4().hex}.parquet")):
            raise OSError(f"cannot move {file} to {lists}")
    system.delete(path(made), True)
    return count


def follow_files(
    query: StreamingQuery, spark: SparkSession, root: str, files_per_batch: int, lists: str,
    seconds: float,
) -> Thread:
    """List new files every so many seconds as long as `query` runs, in a thread.

    For a stream with `lists` that keeps running. A listing that fails stops the query.
    """
    def follow() -> None:
        while True:
            with contextlib.suppress(StreamingQueryException):  # the query tells it itself
                query.awaitTermination(seconds)
            if not query.isActive:
                return
            try:
                list_new_files(spark, root, files_per_batch, lists)
            except BaseException:
                query.stop()
                raise

    thread = Thread(target=follow, name="follow-files", daemon=True)
    thread.start()
    return thread


def storage_key(spark: SparkSession, root: str) -> Column:
    """The path of a binaryFile row below `root`."""
    base = _qualified(spark, root)
    # binaryFile may print file:/x as file:///x, depending on the file system.
    path = F.regexp_replace("path", "^file:/+", "file:/")
    base = "file:/" + base.removeprefix("file:").lstrip("/") if base.startswith("file:") else base
    key = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(
        F.raise_error(F.concat(F.lit("stored file outside the root: "), path)))
    return key.alias("storage_key")


def read_outcome(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents with their stored file; no file is a read failure, not a drop."""
    found = files.withColumn("file_found", F.lit(True))
    joined = documents.join(found, "storage_key", "left")
    missing = F.col("file_found").isNull()
    return joined.withColumns({
        "error_category": F.when(missing, F.lit("PROCESSING_ERROR")),
        "error_message": F.when(missing, F.lit(fixed.READ_FAILED)),
    }).drop("file_found")
