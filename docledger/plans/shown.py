"""Result columns in a form both engines print alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AS_TEXT = (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)


def shown(df: DataFrame) -> DataFrame:
    """Decimals, dates and timestamps as their exact text."""
    return df.select(*[
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, _AS_TEXT)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def text_sql(*names: str) -> str:
    """The same casts for the checking SQL."""
    return ", ".join(f"CAST({n} AS VARCHAR) AS {n.split('.')[-1]}" for n in names)
