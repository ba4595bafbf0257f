"""Projection, filtering and cleaning of observation rows.

Every rule is a deterministic row filter, so Catalyst moves the range checks
below the full-row de-duplication and into the Parquet scan
(``PushedFilters``); only the de-duplication itself needs a shuffle, and its
map-side partial aggregation already folds duplicates inside each task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.observation import Observation

from nimbus.functions.display import finite_or_null
from nimbus.schema import DEFAULT_RULES, ValidationRules


def dedup_rows(df: DataFrame) -> DataFrame:
    """Drop rows equal in every column (nulls compare equal)."""
    return df.dropDuplicates()


def drop_null_date(df: DataFrame, col: str = "DATE") -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def parse_date(df: DataFrame, col: str = "DATE", fmt: str | None = None) -> DataFrame:
    """String to date; an unparseable value becomes null instead of failing."""
    parsed = F.try_to_date(F.col(col), F.lit(fmt)) if fmt else F.try_to_date(F.col(col))
    return df.withColumn(col, parsed)


def keep_in_range(
    df: DataFrame, col: str, lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """Keep rows whose value is null or inside [lo, hi]; absent column: no-op.

    NaN follows Spark's ordering (NaN is above every number), so ``NaN <= hi``
    is false and ``NaN >= lo`` is true.
    """
    if col not in df.columns:
        return df
    c = F.col(col)
    cond = None
    if lo is not None:
        cond = c >= lo
    if hi is not None:
        cond = (c <= hi) if cond is None else (cond & (c <= hi))
    if cond is None:
        return df
    return df.filter(c.isNull() | cond)


def valid_temperature(df: DataFrame, rules: ValidationRules = DEFAULT_RULES) -> DataFrame:
    return keep_in_range(df, "TAVG", rules.temperature_min, rules.temperature_max)


def valid_humidity(df: DataFrame, rules: ValidationRules = DEFAULT_RULES) -> DataFrame:
    return keep_in_range(df, "RHUM", rules.humidity_min, rules.humidity_max)


def valid_precipitation(df: DataFrame, rules: ValidationRules = DEFAULT_RULES) -> DataFrame:
    return keep_in_range(df, "PRCP", rules.precipitation_min)


def valid_wind(df: DataFrame, rules: ValidationRules = DEFAULT_RULES) -> DataFrame:
    return keep_in_range(df, "AWND", rules.wind_speed_min)


def in_bounds(df: DataFrame, rules: ValidationRules = DEFAULT_RULES, date_format: str | None = None) -> DataFrame:
    """Rows with a date text and every measure in its range; the text becomes a date."""
    return (
        df.transform(drop_null_date)
        .transform(lambda d: parse_date(d, "DATE", date_format))
        .transform(lambda d: valid_temperature(d, rules))
        .transform(lambda d: valid_humidity(d, rules))
        .transform(lambda d: valid_precipitation(d, rules))
        .transform(lambda d: valid_wind(d, rules))
    )


def clean(
    df: DataFrame,
    rules: ValidationRules = DEFAULT_RULES,
    drop_unparseable: bool = False,
    date_format: str | None = None,
) -> DataFrame:
    """De-duplicate, drop null dates, parse dates, apply the range checks.

    The null-date test runs on the text before parsing, so a malformed date
    survives as a null date (one null-date group downstream) unless
    ``drop_unparseable`` is set.
    """
    out = in_bounds(dedup_rows(df), rules, date_format)
    if drop_unparseable:
        out = drop_null_date(out)
    return out


def clean_counted(df: DataFrame, rules: ValidationRules, observation: Observation, counts: list[Column], times: str = "_n") -> DataFrame:
    """``clean`` with counts observed on its own de-duplication: no second pass over the rows.

    ``counts`` are aggregates over the distinct rows and their multiplicity ``times``.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(times)).observe(observation, *counts)
    return in_bounds(counted, rules).drop(times)


def _valid_row(df: DataFrame, rules: ValidationRules) -> F.Column:
    """Row-level predicate equal to the cleaning filters (date kept if text present)."""
    cond = F.col("DATE").isNotNull()
    checks = [
        ("TAVG", rules.temperature_min, rules.temperature_max),
        ("RHUM", rules.humidity_min, rules.humidity_max),
        ("PRCP", rules.precipitation_min, None),
        ("AWND", rules.wind_speed_min, None),
    ]
    for col, lo, hi in checks:
        if col not in df.columns:
            continue
        c = F.col(col)
        rng = c >= lo
        if hi is not None:
            rng = rng & (c <= hi)
        cond = cond & (c.isNull() | rng)
    return cond


def clean_report(raw: DataFrame, rules: ValidationRules = DEFAULT_RULES) -> DataFrame:
    """One row: initial, final, removed, retention_pct (0 when empty).

    One shuffle: rows are grouped on their full value (the de-duplication the
    cleaning step does anyway) with their multiplicity, then a global
    aggregate sums multiplicities (initial) and counts valid groups (final).
    """
    grouped = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_n"))
    agg = grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("initial"),
        F.count_if(_valid_row(raw, rules)).cast("long").alias("final"),
    )
    return agg.select(
        "initial",
        "final",
        (F.col("initial") - F.col("final")).alias("removed"),
        F.when(F.col("initial") > 0, F.round(F.col("final") / F.col("initial") * 100.0, 6))
        .otherwise(F.lit(0.0))
        .alias("retention_pct"),
    )


def project_available(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Select the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def date_range(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    col: str = "DATE",
    year_col: str | None = "YEAR",
) -> DataFrame:
    """start <= DATE <= end, each bound optional (null dates never match).

    When the frame carries a YEAR column (the partition column of stored
    daily data) the year bounds implied by the dates are added as well, which
    lets Spark prune whole partitions instead of only row groups.
    """
    c = F.col(col)
    if start:
        df = df.filter(c >= F.to_date(F.lit(start)))
        if year_col and year_col in df.columns:
            df = df.filter(F.col(year_col) >= int(start[:4]))
    if end:
        df = df.filter(c <= F.to_date(F.lit(end)))
        if year_col and year_col in df.columns:
            df = df.filter(F.col(year_col) <= int(end[:4]))
    return df


def nonfinite_to_null(df: DataFrame) -> DataFrame:
    """NaN and +/-Infinity become null in every float column."""
    floats = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(
        *[finite_or_null(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def drop_null_measure(df: DataFrame, col: str = "TEMP_AVG") -> DataFrame:
    return df.filter(F.col(col).isNotNull())
