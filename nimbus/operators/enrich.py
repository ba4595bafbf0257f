"""Derived calendar and category columns (one projection, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbus.functions.calendar import calendar_columns, season
from nimbus.functions.categories import rain_category, temp_category, temp_range


def calendar_parts(df: DataFrame, date_col: str = "DATE") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(date_col)))


def add_season(df: DataFrame, month_col: str = "MONTH") -> DataFrame:
    return df.withColumn("SEASON", season(F.col(month_col)))


def add_temp_range(df: DataFrame) -> DataFrame:
    if "TMAX" in df.columns and "TMIN" in df.columns:
        return df.withColumn("TEMP_RANGE", temp_range(F.col("TMAX"), F.col("TMIN")))
    return df


def add_temp_category(df: DataFrame, null_label: str = "Hot") -> DataFrame:
    if "TAVG" in df.columns:
        return df.withColumn("TEMP_CATEGORY", temp_category(F.col("TAVG"), null_label))
    return df


def add_rain_category(df: DataFrame, null_label: str = "Extreme") -> DataFrame:
    if "PRCP" in df.columns:
        return df.withColumn("RAIN_CATEGORY", rain_category(F.col("PRCP"), null_label))
    return df


def enrich(
    df: DataFrame, temp_null_label: str = "Hot", rain_null_label: str = "Extreme"
) -> DataFrame:
    """Calendar parts, season, temperature range and both categories."""
    cols = calendar_columns(F.col("DATE"))
    cols["SEASON"] = season(cols["MONTH"])
    if "TMAX" in df.columns and "TMIN" in df.columns:
        cols["TEMP_RANGE"] = temp_range(F.col("TMAX"), F.col("TMIN"))
    if "TAVG" in df.columns:
        cols["TEMP_CATEGORY"] = temp_category(F.col("TAVG"), temp_null_label)
    if "PRCP" in df.columns:
        cols["RAIN_CATEGORY"] = rain_category(F.col("PRCP"), rain_null_label)
    return df.withColumns(cols)
