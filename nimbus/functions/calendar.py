"""Calendar parts, seasons and date labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations shown by the dashboard (French).
MONTH_NAMES = ["Jan", "Fév", "Mar", "Avr", "Mai", "Jun", "Jul", "Aoû", "Sep", "Oct", "Nov", "Déc"]

# Season names in dashboard order.
SEASONS = ["Winter", "Spring", "Summer", "Fall"]


def calendar_columns(date: Column) -> dict[str, Column]:
    """YEAR, MONTH, DAY, DAY_OF_WEEK (1 = Sunday) and ISO WEEK_OF_YEAR."""
    return {
        "YEAR": F.year(date),
        "MONTH": F.month(date),
        "DAY": F.dayofmonth(date),
        "DAY_OF_WEEK": F.dayofweek(date),
        "WEEK_OF_YEAR": F.weekofyear(date),
    }


def season_index(month: Column) -> Column:
    """Place of a month's season in ``SEASONS``: months in threes from December on.

    December joins January and February of the *same* calendar year; a null
    month counts as the first season.
    """
    return F.coalesce(F.floor(F.pmod(month, F.lit(12)) / 3), F.lit(0)).cast("int")


def season(month: Column) -> Column:
    """Name of the meteorological season of a month number."""
    return F.get(F.array(*map(F.lit, SEASONS)), season_index(month))


def format_day(date: Column) -> Column:
    """``YYYY-MM-DD`` text of a date."""
    return F.date_format(date, "yyyy-MM-dd")


def format_month(year: Column, month: Column) -> Column:
    """``YYYY-MM`` text of a (year, month) pair."""
    return F.date_format(F.make_date(year, month, F.lit(1)), "yyyy-MM")


def month_label(year: Column, month: Column) -> Column:
    """``"<abbr> <year>"`` label, e.g. ``Jan 1996``; null month gives null."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.concat(F.try_element_at(names, month), F.lit(" "), year.cast("string"))
