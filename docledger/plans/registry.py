"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docledger.plans import (
    exports,
    extraction,
    findings,
    history,
    integrity,
    merges,
    pipeline,
    review,
    streams,
    texts,
    uploads,
)

_SECTIONS = (uploads, texts, extraction, findings, review, exports, history, integrity, streams,
             pipeline, merges)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for section in _SECTIONS for name, query in section.QUERIES.items()
}
ORACLES: dict[str, str] = {
    name: sql for section in _SECTIONS for name, sql in section.ORACLES.items()
}
