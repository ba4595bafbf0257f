"""Dashboard queries (filters, latest-N, ordered series) and reshapes.

Top-N reads are ``orderBy(...).limit(n)``, which Spark plans as
TakeOrderedAndProject: each task keeps only its best n rows, so no full sort
or full shuffle happens; the limit is the feature of these reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbus.functions.calendar import SEASONS, format_day, month_label
from nimbus.functions.display import display_text, null_to_zero
from nimbus.operators.clean import date_range, nonfinite_to_null, project_available

TABLE_COLUMNS = ["DATE", "TEMP_AVG", "TEMP_MIN", "TEMP_MAX", "PRECIPITATION_TOTAL", "HUMIDITY_AVG"]


def daily_query(
    daily: DataFrame, start: str | None = None, end: str | None = None, limit: int = 5000
) -> DataFrame:
    """Date-range filter, newest first (null date last), at most ``limit`` rows.

    DATE is returned as ``YYYY-MM-DD`` text and non-finite values as null.
    """
    rows = date_range(daily, start, end).orderBy(F.col("DATE").desc_nulls_last()).limit(limit)
    return nonfinite_to_null(rows).withColumn("DATE", format_day(F.col("DATE")))


def monthly_query(monthly: DataFrame) -> DataFrame:
    """All months, newest first."""
    return nonfinite_to_null(
        monthly.orderBy(F.col("YEAR").desc_nulls_last(), F.col("MONTH").desc_nulls_last())
    )


def seasonal_query(seasonal: DataFrame) -> DataFrame:
    """All seasons, newest year first (season order inside a year: by name)."""
    return nonfinite_to_null(
        seasonal.orderBy(F.col("YEAR").desc_nulls_last(), F.col("SEASON").asc())
    )


def temperature_trend(daily: DataFrame, days: int = 365 * 3) -> DataFrame:
    """DATE text and temperature columns of the latest ``days`` dated days."""
    cols = project_available(daily, ["DATE", "TEMP_AVG", "TEMP_MIN", "TEMP_MAX"]).columns
    latest = (
        daily.filter(F.col("DATE").isNotNull())
        .orderBy(F.col("DATE").desc())
        .limit(days)
        .select(*cols)
    )
    return nonfinite_to_null(latest).withColumn("DATE", format_day(F.col("DATE"))).orderBy("DATE")


def last_n_days(daily: DataFrame, n: int = 365) -> DataFrame:
    """Latest ``n`` dated daily rows, returned oldest first."""
    latest = daily.filter(F.col("DATE").isNotNull()).orderBy(F.col("DATE").desc()).limit(n)
    return latest.orderBy("DATE")


def rain_last_24_months(monthly: DataFrame, months: int = 24) -> DataFrame:
    """Latest ``months`` monthly rows oldest first, rain null/NaN shown as 0."""
    latest = monthly.orderBy(
        F.col("YEAR").desc_nulls_last(), F.col("MONTH").desc_nulls_last()
    ).limit(months)
    return latest.select(
        "YEAR",
        "MONTH",
        month_label(F.col("YEAR"), F.col("MONTH")).alias("LABEL"),
        null_to_zero(F.col("PRECIPITATION_TOTAL")).alias("PRECIPITATION_TOTAL"),
    ).orderBy("YEAR", "MONTH")


def preview(daily: DataFrame, rows: int = 50, start=None, end=None, limit: int = 5000) -> DataFrame:
    """First rows of the daily query as the table shows them (text cells)."""
    top = date_range(daily, start, end).orderBy(F.col("DATE").desc_nulls_last()).limit(
        min(rows, limit)
    )
    return top.select(
        F.coalesce(format_day(F.col("DATE")), F.lit("-")).alias("DATE"),
        *[display_text(F.col(c)).alias(c) for c in TABLE_COLUMNS[1:] if c in daily.columns],
    )


def monthly_series(monthly: DataFrame) -> DataFrame:
    """Monthly mean temperature oldest first with ``"<abbr> <year>"`` labels."""
    return monthly.select(
        "YEAR",
        "MONTH",
        month_label(F.col("YEAR"), F.col("MONTH")).alias("LABEL"),
        "TEMP_AVG",
    ).orderBy(F.col("YEAR").asc_nulls_first(), F.col("MONTH").asc_nulls_first())


def month_year_grid(monthly: DataFrame, value: str = "TEMP_AVG") -> DataFrame:
    """Long form of the month x year grid: 12 rows per year, null where absent.

    One pass: the (at most 12) months of each year are gathered into a
    month -> value map, then every year is expanded to months 1..12 and each
    cell looked up in its year's map. No join, the input is read once.
    """
    per_year = (
        monthly.filter(F.col("YEAR").isNotNull() & F.col("MONTH").isNotNull())
        .groupBy("YEAR")
        .agg(F.map_from_entries(F.collect_list(F.struct("MONTH", value))).alias("_m"))
    )
    cells = per_year.select("YEAR", "_m", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("MONTH"))
    return cells.select("MONTH", "YEAR", F.try_element_at("_m", F.col("MONTH")).alias(value))


def month_year_grid_wide(monthly: DataFrame, years: Sequence[int], value: str = "TEMP_AVG"):
    """Wide grid: one row per month, one column per listed year.

    ``years`` is the column list of the result (a calendar-sized list the
    caller supplies, e.g. from :func:`distinct_years`); the values are pivoted
    with a grouped aggregate, never collected.
    """
    long = month_year_grid(monthly, value)
    return (
        long.groupBy("MONTH")
        .pivot("YEAR", list(years))
        .agg(F.max(value))
        .orderBy("MONTH")
    )


def seasonal_series(seasonal: DataFrame, value: str = "TEMP_AVG") -> DataFrame:
    """One row per YEAR with one column per season (Winter, Spring, Summer, Fall)."""
    return (
        seasonal.groupBy("YEAR")
        .pivot("SEASON", SEASONS)
        .agg(F.max(value))
        .select("YEAR", *SEASONS)
        .orderBy(F.col("YEAR").asc_nulls_last())
    )


def distinct_years(monthly: DataFrame) -> DataFrame:
    return monthly.select("YEAR").distinct().orderBy(F.col("YEAR").asc_nulls_last())
