"""Answers that were paid for, kept one by one as they arrive.

A task that dies half way has committed nothing to its table, but what it has already
asked is in the ledger, and the next attempt reads it there. An entry is one small file,
named by a hash of the document and the request, that appears whole or not at all. A
ledger belongs to one run or one batch and can be dropped once its answers are in a
table.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Ledger:
    """Entries under `folder`, an absolute path or the URI of a shared store."""

    def __init__(self, folder: str) -> None:
        # pyarrow wants file:///x where Hadoop may write file:/x.
        self.folder = re.sub("^file:/+", "file:///", folder.rstrip("/"))
        self._opened = None

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "_opened": None}

    @staticmethod
    def key(document_id: object, request: str) -> str:
        return hashlib.sha256(json.dumps([str(document_id), request]).encode()).hexdigest()

    def _store(self):
        if self._opened is None:
            from pyarrow import fs

            self._opened = fs.FileSystem.from_uri(self.folder)
        return self._opened

    def read(self, key: str) -> tuple[str | None, str | None] | None:
        """(raw_json, error_kind) of an earlier attempt, None if there is no entry."""
        from pyarrow import fs

        store, base = self._store()
        path = f"{base}/{key[:2]}/{key}"
        if store.get_file_info(path).type != fs.FileType.File:
            return None
        with store.open_input_stream(path) as file:
            raw, kind = json.loads(file.read())
        return raw, kind

    def write(self, key: str, raw: str | None, kind: str | None) -> None:
        store, base = self._store()
        store.create_dir(f"{base}/{key[:2]}", recursive=True)
        path = f"{base}/{key[:2]}/{key}"
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as file:
            file.write(json.dumps([raw, kind]).encode())
        store.move(part, path)


def drop_ledger(spark: SparkSession, ledger: Ledger) -> None:
    """Remove the entries, after their answers are in a committed table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger.folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
