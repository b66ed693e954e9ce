"""Numeric helpers shared by the questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from admitlens.fixed_values import MAX_LIMIT


# Numbers as Python reads them: no type suffixes, no hexadecimal; inf and nan.
NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*)?\.?\d+(?:e[+-]?\d+)?|\d+\.?(?:e[+-]?\d+)?|inf|infinity|nan)\s*$"


def round2(c: Column) -> Column:
    """Two-decimal rounding, half away from zero, after cutting the double to a
    decimal first (so 3.8249999999999997 -> 3.83, 3.925 -> 3.93). DOUBLE out."""
    return F.round(c.cast("decimal(38,15)"), 2).cast("double")


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, NULL (not an error) when whole is 0."""
    return round2(F.lit(100.0).cast("double") * part / F.nullif(whole, F.lit(0)))


def try_double(c: Column) -> Column:
    """Text -> double; NULL on bad text, blanks and NaN."""
    d = F.when(c.rlike(NUMBER), c.try_cast("double"))
    return F.nanvl(d, F.lit(None).cast("double"))


def try_key(c: Column) -> Column:
    """Text -> 64-bit key; integral text such as "1001.0" is a key, anything else
    (a fraction, bad text, out of range) is NULL."""
    whole = F.regexp_extract(c, r"^\s*([+-]?\d+)(?:\.0*)?\s*$", 1)
    return F.when(whole != "", whole.try_cast("bigint"))


def clamp_limit(limit, max_limit: int | None = MAX_LIMIT) -> int:
    """A requested row cap (numeric text too) of at least 1 and, unless
    ``max_limit`` is None, at most that."""
    n = max(int(limit), 1)
    return n if max_limit is None else min(n, max_limit)
