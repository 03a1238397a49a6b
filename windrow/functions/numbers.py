"""Numeric expressions with explicit rules for missing values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that mean "no reading" in the climate sheets.
MISSING_TOKENS = ("NA", "N/A", "na", "n/a", "")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    value = _col(c).cast("double")
    return F.when(~F.isnan(value), value)


def to_number(c: Column | str) -> Column:
    """Number or null: missing tokens and unreadable texts are null, never an error."""
    text = _col(c).cast("string")
    return nan_to_null(F.when(~text.isin(*MISSING_TOKENS), text).try_cast("double"))


def first_number(c: Column | str) -> Column:
    """First number inside a text."""
    return F.nullif(F.regexp_extract(_col(c).cast("string"), r"-?\d+(?:\.\d+)?", 0), F.lit("")).cast("double")


def first_integer(c: Column | str) -> Column:
    """First number inside a text, rounded half to even."""
    return F.bround(first_number(c), 0).cast("bigint")


def fraction(c: Column | str) -> Column:
    """``a/b`` or a plain number; a zero denominator gives null."""
    text = F.trim(_col(c).cast("string"))
    top = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double")
    bottom = F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(F.contains(text, F.lit("/")), F.try_divide(top, F.nullif(bottom, F.lit(0.0)))).otherwise(
        first_number(text)
    )


def clip(c: Column | str, low: float, high: float) -> Column:
    """Bounded value; null stays null (``least``/``greatest`` alone would drop it)."""
    value = _col(c)
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def row_mean(*cols: Column | str) -> Column:
    """Mean of the values present in the row; null when all are missing."""
    values = [_col(c) for c in cols]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    count = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    return F.try_divide(total, count)


def min_max(
    value: Column,
    low: Column,
    high: Column,
    const_zero: float = 0.0,
    const_other: float = 0.5,
    null_as: float | None = None,
    clipped: bool = False,
) -> Column:
    """Min-max scaling. A constant group gives ``const_zero`` if it is zero, else ``const_other``."""
    flat = F.when(low == 0, F.lit(const_zero)).otherwise(F.lit(const_other))
    scaled = (value - low) / (high - low)
    if clipped:
        scaled = clip(scaled, 0.0, 1.0)
    result = F.when(low.isNull(), F.lit(0.0)).when(low == high, flat if null_as is not None else F.when(value.isNotNull(), flat))
    result = result.otherwise(scaled)
    return F.coalesce(result, F.lit(null_as)) if null_as is not None else result
