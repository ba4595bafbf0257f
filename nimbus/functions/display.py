"""Display-side conversions: non-finite values, zero fill, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(x: Column) -> Column:
    """NaN and +/-Infinity become null (JSON has no representation for them)."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def null_to_zero(x: Column) -> Column:
    """Null or NaN measure shown as 0."""
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def round_display(x: Column, digits: int = 1) -> Column:
    """Numeric rounding used by the charts (1 decimal, 0 for total rain)."""
    return F.round(x, digits)


def display_text(x: Column, digits: int = 1) -> Column:
    """Table cell text: fixed decimals, ``-`` for a missing value."""
    return F.when(x.isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f", F.round(x, digits)))
