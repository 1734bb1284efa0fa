"""Text form of export cells and CSV lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_timestamp(col: Column) -> Column:
    """ISO 8601 in UTC; the fraction appears only when it is not zero.

    Built from the instant, so the session's time zone does not matter.
    """
    micros = F.unix_micros(col)
    rest = F.pmod(micros, F.lit(1_000_000))
    seconds = F.floor((micros - rest) / 1_000_000).cast("decimal(18,6)")
    wall = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    fraction = F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))
    return F.concat(
        F.replace(wall.cast("string"), F.lit(" "), F.lit("T")),
        F.when(rest > 0, fraction).otherwise(F.lit("")),
        F.lit("+00:00"),
    )


def cell_text(df: DataFrame, name: str) -> Column:
    """One cell as text: NULL is empty, decimals are exact, dates ISO 8601."""
    dtype = df.schema[name].dataType
    col = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        col = iso_timestamp(F.convert_timezone(
            F.lit("UTC"), F.current_timezone(), col).cast("timestamp"))
    elif isinstance(dtype, T.TimestampType):
        col = iso_timestamp(col)
    return F.coalesce(col.cast("string"), F.lit(""))


def csv_field(col: Column) -> Column:
    """Quote only where needed and double the quotes inside."""
    quoted = F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(col.rlike('[",\r\n]'), quoted).otherwise(col)


def csv_line(names: Iterable[str]) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(n)) for n in names])
