"""Text measures that agree with Python's notion of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger import fixed

# Unicode white space plus the four separators Python counts as well, taken as
# runs so that a long gap costs one match.
_WHITE_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def non_space_count(text: Column | str) -> Column:
    """Number of code points that are not white space."""
    return F.char_length(F.regexp_replace(text, _WHITE_SPACE_RUN, ""))


def is_blank(text: Column | str) -> Column:
    """True for NULL, empty and white-space-only text."""
    col = F.col(text) if isinstance(text, str) else text
    return col.isNull() | (F.length(F.trim(col, F.lit(fixed.WHITE_SPACE))) == 0)
