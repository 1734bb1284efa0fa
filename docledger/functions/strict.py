"""Strict reading of JSON fields held in a VARIANT, as SQL expressions.

Strings must be JSON strings, numbers may be numbers or numeric text, dates may
be ISO text or whole days since the epoch. Casting functions alone accept far
more, so values pass a type and a pattern first. Absent and null fields both
read as NULL and are never rejected.

These are SQL text rather than Column objects: reading a document takes some
hundred expressions, and one string each is far quicker to hand over.
"""

from __future__ import annotations

from docledger import fixed

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_CALENDAR = (
    r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt _]00:00(:00([.,]0{1,9})?)?"
    r"([Zz]|[+-][0-9]{2}:?[0-9]{2})?)?$"
)
_EPOCH = r"^[+-]?[0-9]{1,18}(\.0*)?$"
# Epoch numbers above this size count milliseconds
_SECONDS_LIMIT = 20000000000
# 0001-01-01 and 9999-12-31 in seconds
_FIRST_DAY = -62135596800
_LAST_DAY = 253402214400


def json_type(variant: str, path: str) -> str:
    """Type name of a field; NULL when absent, VOID when JSON null."""
    return f"schema_of_variant(try_variant_get({variant}, '{path}', 'variant'))"


def json_text(variant: str, path: str) -> str:
    return f"try_variant_get({variant}, '{path}', 'string')"


def rejected(text: str, value: str) -> str:
    """A field that was given, and not as null, but could not be read."""
    return f"({text} IS NOT NULL AND {value} IS NULL)"


def string_value(variant: str, path: str, text: str) -> str:
    return f"CASE WHEN {text} IS NOT NULL AND {json_type(variant, path)} = 'STRING' THEN {text} END"


def number_value(text: str) -> str:
    """The value stays text, so that range is judged separately from syntax.

    Neither booleans nor nested JSON look like a number, so the pattern alone
    tells them apart.
    """
    plain = f"translate(trim(BOTH '{fixed.WHITE_SPACE}' FROM {text}), '_', '')"
    return (
        f"CASE WHEN {text} RLIKE r'{_NUMBER}' THEN {text} "
        f"WHEN {plain} RLIKE r'{_NUMBER}' THEN {plain} END"
    )


def date_value(text: str) -> str:
    count = f"try_cast({text} AS DECIMAL(28,6))"
    seconds = f"CASE WHEN abs({count}) > {_SECONDS_LIMIT} THEN {count} / 1000 ELSE {count} END"
    day = f"try_cast(substring({text}, 1, 10) AS DATE)"
    epoch_day = f"date_add(DATE'1970-01-01', CAST(({seconds}) / 86400 AS INT))"
    whole = f"({seconds}) % 86400 = 0 AND ({seconds}) BETWEEN {_FIRST_DAY} AND {_LAST_DAY}"
    return (
        f"CASE WHEN {text} RLIKE r'{_CALENDAR}' THEN {day} "
        f"WHEN {text} RLIKE r'{_EPOCH}' AND {whole} THEN {epoch_day} END"
    )


def fits(value: str, decimal_type: str) -> str:
    """True when a numeric text rounds into the decimal type."""
    return f"({value} IS NULL OR try_cast({value} AS {decimal_type}) IS NOT NULL)"


def text_fits(value: str, limit: int) -> str:
    """True when a string can be stored: short enough and free of NUL."""
    return (
        f"({value} IS NULL OR (char_length({value}) <= {limit} "
        f"AND NOT contains({value}, char(0))))"
    )
