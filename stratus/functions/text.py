"""Text cell functions: whitespace stripping, missing markers, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

# Every character Python's ``str.strip()`` removes (its definition of
# whitespace), so stripping here equals stripping in the original.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Whole-cell numbers as the original's parser reads them: optional sign,
# digits with optional fraction and exponent, surrounding whitespace allowed;
# or inf/infinity in any case, without whitespace. Texts such as 'nan', '1f',
# '1d', '0x1p3' or '1_000' are not numbers (Spark's own cast takes several of
# them), and a finite literal that overflows a double is missing, not inf.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"(?i)^[+-]?(inf|infinity)$"

# Calendar date as year-month-day with one- or two-digit month and day.
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Remove leading and trailing whitespace; NULL stays NULL.

    A cell that begins and ends with a visible ASCII character is taken as it is:
    most cells are, and trimming looks every character up in the list.
    """
    col = _c(c)
    bare = F.substring(col, 1, 1).between("!", "~") & F.substring(col, -1, 1).between("!", "~")
    return F.when(bare, col).otherwise(F.btrim(col, F.lit(WHITESPACE)))


def clean_text(c: str | Column, na_tokens: bool = True) -> Column:
    """Stripped text; NULL for a blank cell or a missing-value token.

    Same result as ``strip(blank_to_null(c))`` with a single strip per cell
    (the repeated strip is one common subexpression).
    """
    col = _c(c)
    s = strip(col)
    missing = s == ""
    if na_tokens:
        missing = missing | col.isin(S.NA_TOKENS)
    return F.when(missing, F.lit(None).cast("string")).otherwise(s)


def parse_number(c: str | Column, stripped: bool = False) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    col = _c(c)
    x = (col if stripped else strip(col)).try_cast("double")
    infinite = x.isin(float("inf"), float("-inf"))
    return (F.when(col.rlike(NUMBER_PATTERN), F.when(~infinite, x))
             .when(col.rlike(INFINITY_PATTERN), x))


def parse_date(c: str | Column, stripped: bool = False) -> Column:
    """Text to date (year-month-day); anything else, or a date the original's
    timestamp type cannot hold, becomes NULL."""
    s = _c(c) if stripped else strip(_c(c))
    d = s.try_cast("date")
    in_range = d.between(F.lit(S.EARLIEST_DATE).cast("date"), F.lit(S.LATEST_DATE).cast("date"))
    return F.when(s.rlike(DATE_PATTERN) & in_range, d)
