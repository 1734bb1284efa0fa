"""Deterministic hooks for the registered queries and the tests."""

from __future__ import annotations

import re
import sys
from typing import BinaryIO

from pyspark import cloudpickle

from docledger.operators.hooks import ExtractorError

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class MarkupReader:
    """Reads a web page as a document: one page per paragraph."""

    def read(self, content: bytes) -> list[str | None]:
        html = content.decode("utf-8")
        if "<html" not in html:
            raise ValueError("not a document")
        return [re.sub(r"<[^>]*>", " ", part) for part in html.split("<p>")]


class MarkupRanges:
    """The same pages from an open file, some at a time."""

    def count(self, file: BinaryIO) -> int:
        html = file.read()
        if b"<html" not in html:
            raise ValueError("not a document")
        return html.count(b"<p>") + 1

    def read(self, file: BinaryIO, first: int, stop: int) -> list[str | None]:
        parts = file.read().decode("utf-8").split("<p>", stop)
        return [re.sub(r"<[^>]*>", " ", part) for part in parts[first:stop]]


class ScanReader(MarkupReader):
    """The same, but files of some lengths have no native text, as scans have none."""

    def read(self, content: bytes) -> list[str | None]:
        texts = super().read(content)
        return [None] * len(texts) if len(content) % 5 == 0 else texts


class ParagraphRenderer:
    """Paragraphs as images; files of some lengths fail or come out odd."""

    def render(self, content: bytes) -> list[bytes | None]:
        size = len(content)
        if size % 25 == 0:
            raise ValueError("cannot be rendered")
        if size % 35 == 0:
            return [b" "]
        images = [part.encode() for part in content.decode("utf-8").split("<p>")]
        if size % 55 == 0:
            images[-1] = None
        if size % 65 == 0:
            images.append(b"unreadable")
        return images


class WordRecogniser:
    """Takes the image bytes for text and joins its words by one space."""

    def run(self, image: bytes) -> str:
        text = image.decode("utf-8")
        if text == "unreadable":
            raise RuntimeError("engine failure")
        return " ".join(text.split(" "))


class LengthExtractor:
    """Answers from the length of the text; some lengths fail in each known way."""

    def extract(self, text: str) -> dict:
        size = len(text)
        if size % 19 == 0:
            raise ExtractorError(("timeout", "auth", "response")[size % 3])
        if size % 23 == 0:
            raise RuntimeError("client failure")
        if size % 29 == 0:
            return {"vendor_name": 70, "line_items": "seven lines"}
        return {
            "vendor_name": f"Vendor {size % 100}",
            "currency": "USD",
            "subtotal": size,
            "tax": "1.50",
            "total": f"{size + 1 + size % 2}.50",
            "line_items": [
                {"description": "text", "quantity": size, "unit_price": "1.00", "amount": size}
            ],
        }
