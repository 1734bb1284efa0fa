"""Deterministic identifiers, so that a retried task writes the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def derived_id(kind: str, *parts: Column | str) -> Column:
    """A lower-case hyphenated identifier computed from a row's natural key."""
    text = F.concat_ws(":", F.lit(kind), *[
        (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts
    ])
    return F.regexp_replace(
        F.md5(text), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )
