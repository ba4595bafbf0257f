"""Lazily built standard frames over the test tables.

Each function returns a new logical plan; nothing is executed until an action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbus.operators import aggregate, clean, enrich
from nimbus.sources import bindings


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.obs_raw(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(raw(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich(cleaned(spark, sf_dir))


def station_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all stations of the raw rows (those of the cleaned rows are among them); no de-duplication."""
    return aggregate.station_codes(raw(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.daily(enriched(spark, sf_dir))


def daily_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows with a real date (the null-date group removed)."""
    return daily(spark, sf_dir).filter(F.col("DATE").isNotNull())


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.monthly(enriched(spark, sf_dir))


def seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.seasonal(enriched(spark, sf_dir))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.yearly(enriched(spark, sf_dir))


def station_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (STATION, DATE) with a real date: the shape of one station's feed.

    Each fixture station has exactly one name, so the name is a grouping key
    (hash aggregation) rather than a ``min`` over strings.
    """
    return (
        cleaned(spark, sf_dir)
        .filter(F.col("DATE").isNotNull())
        .groupBy("STATION", "STATION_NAME", "DATE")
        .agg(
            F.max("TMAX").alias("TMAX"),
            F.min("TMIN").alias("TMIN"),
            F.avg("TAVG").alias("TAVG"),
            F.sum("PRCP").alias("PRCP"),
            F.max("AWND").alias("AWND"),
            F.avg("RHUM").alias("RHUM"),
        )
    )
