"""User-supplied Python: page reader, page recogniser, field extractor.

A factory is called once per task, so a model or client is built once and
reused for every row. Failures are caught row by row and come back as data.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from docledger import fixed
from docledger.sources.ledger import Ledger

# Python workers get these functions with the task and need not have the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class PageReader(Protocol):
    def read(self, content: bytes) -> list[str | None]:
        """Page texts in order; None for a page that cannot be read."""


class PageRenderer(Protocol):
    def render(self, content: bytes) -> list[bytes | None]:
        """Images of all pages in order; None for a page that cannot be rendered."""


class Recogniser(Protocol):
    def run(self, image: bytes) -> str:
        """Text of one page image."""


class Extractor(Protocol):
    def extract(self, text: str) -> dict:
        """Raw structured fields of one document."""


class ExtractorError(Exception):
    """Raised by an extractor; `kind` is timeout, auth or response."""

    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


def _key_ddl(df: DataFrame) -> str:
    return f"document_id {df.schema['document_id'].dataType.simpleString()}"


def read_pages(files: DataFrame, factory: Callable[[], PageReader]) -> DataFrame:
    """(document_id, content) to one row per page; an unreadable file gives one
    row with open_failed set."""
    columns = ["document_id", "page_no", "text", "page_error", "open_failed"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = factory()
        for batch in batches:
            rows: list[tuple] = []
            for key, content in zip(batch["document_id"], batch["content"], strict=True):
                try:
                    texts = reader.read(bytes(content))
                except Exception:
                    rows.append((key, None, None, False, True))
                    continue
                rows.extend((key, i, text, text is None, False) for i, text in enumerate(texts))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"page_no": "Int32"})

    schema = f"{_key_ddl(files)}, page_no int, text string, page_error boolean, open_failed boolean"
    return files.select("document_id", "content").mapInPandas(read, schema)


_FILE_ROWS = (
    "storage_key string, kind string, page_no int, text string, page_error boolean, "
    "open_failed boolean, engine_failed boolean"
)


def read_files(
    files: DataFrame, reader: Callable[[], PageReader],
    renderer: Callable[[], PageRenderer] | None = None,
    recogniser: Callable[[], Recogniser] | None = None,
    min_chars: int = fixed.MIN_TEXT_CHARS,
) -> DataFrame:
    """(storage_key, content) to one row per file and rows of its pages.

    `kind` is file, native or ocr. A file without enough native text is rendered and
    recognised while its bytes are at hand, so that no bytes are read twice or moved;
    without a renderer and recogniser nothing is. A file that cannot be opened has
    open_failed on its file row; one that cannot be rendered has one ocr row with
    page_error.
    """
    columns = [c.split()[0] for c in _FILE_ROWS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reads = reader()
        made: list = []
        rows: list[tuple] = []

        def engines() -> tuple[PageRenderer, Recogniser]:
            if not made:
                made.extend([renderer(), recogniser()])
            return made[0], made[1]

        def recognised(key: str, content: bytes) -> Iterator[tuple]:
            try:
                images = engines()[0].render(content)
            except Exception:
                yield key, "ocr", None, None, True, False, False
                return
            for i, image in enumerate(images):
                if image is None:
                    yield key, "ocr", i, None, True, False, False
                    continue
                try:
                    yield key, "ocr", i, engines()[1].run(image), False, False, False
                except Exception:
                    yield key, "ocr", i, None, False, False, True

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns).astype({"page_no": "Int32"})
            rows.clear()
            return out

        for batch in batches:
            for key, content in zip(batch["storage_key"], batch["content"], strict=True):
                content = bytes(content)
                try:
                    texts = reads.read(content)
                except Exception:
                    rows.append((key, "file", None, None, False, True, False))
                    continue
                rows.append((key, "file", None, None, False, False, False))
                rows.extend((key, "native", i, text, text is None, False, False)
                            for i, text in enumerate(texts))
                count = sum(len("".join((text or "").split())) for text in texts)
                if count < min_chars and renderer is not None and recogniser is not None:
                    rows.extend(recognised(key, content))
                if len(rows) > 1_000:
                    yield frame()
        if rows:
            yield frame()

    return files.select("storage_key", "content").mapInPandas(read, _FILE_ROWS)


def recognise_pages(images: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """(document_id, page_no, image) to recognised text or engine_failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        for batch in batches:
            texts, failed = [], []
            for image in batch["image"]:
                try:
                    if engine is None:
                        engine = factory()
                    texts.append(engine.run(bytes(image)))
                    failed.append(False)
                except Exception:
                    texts.append(None)
                    failed.append(True)
            yield batch[["document_id", "page_no"]].assign(text=texts, engine_failed=failed)

    schema = f"{_key_ddl(images)}, page_no int, text string, engine_failed boolean"
    return images.select("document_id", "page_no", "image").mapInPandas(run, schema)


def run_extractor(
    requests: DataFrame, factory: Callable[[], Extractor], ledger: Ledger | None = None
) -> DataFrame:
    """(document_id, request_text) to (document_id, raw_json, error_kind).

    With a ledger every answer, failures included, is kept as it arrives, and a request
    that has an entry is not asked again: a lost task costs at most the call it was
    waiting for. Two attempts that run at once (speculation) may both ask.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = None
        for batch in batches:
            raws, kinds = [], []
            for document_id, text in zip(batch["document_id"], batch["request_text"], strict=True):
                key = ledger.key(document_id, text) if ledger else None
                known = ledger.read(key) if ledger else None
                if known is None:
                    if extractor is None:
                        extractor = factory()
                    raw, kind = None, None
                    try:
                        raw = json.dumps(extractor.extract(text))
                    except ExtractorError as error:
                        kind = error.kind
                    except Exception:
                        kind = "other"
                    if ledger:
                        ledger.write(key, raw, kind)
                else:
                    raw, kind = known
                raws.append(raw)
                kinds.append(kind)
            yield batch[["document_id"]].assign(raw_json=raws, error_kind=kinds)

    schema = f"{_key_ddl(requests)}, raw_json string, error_kind string"
    return requests.select("document_id", "request_text").mapInPandas(run, schema)
