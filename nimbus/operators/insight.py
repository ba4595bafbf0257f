"""Analyses the reference declares (README questions, configured periods)
without code: period windows, extremes, station comparison, hot/cold days,
season profiles and anomalies.

Choices the reference leaves open are parameters: the period anchor is the
latest date present, hot/cold thresholds apply to the daily mean temperature,
anomalies are |z| > 2 against the season's daily values, ties go to the
earliest period or the alphabetically first name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbus.operators import aggregate
from nimbus.operators.rank import rank_desc
from nimbus.session import cut_lineage

# Analysis periods of the reference configuration (days back
# from the anchor; None = all time).
PERIODS = {
    "last_7_days": 7,
    "last_30_days": 30,
    "last_90_days": 90,
    "last_year": 365,
    "all_time": None,
}


def period_window(
    daily: DataFrame, periods: Mapping[str, int | None] = PERIODS, materialize: bool = True
) -> DataFrame:
    """Days, first/last date, mean temperature and total rain per period.

    The anchor (latest date) is a scalar subquery; every dated row is fanned
    out to the periods containing it and one grouped aggregate follows. The
    daily rows feed both, so they are checkpointed once unless the caller
    read them from storage (``materialize=False``).
    """
    dated = daily.filter(F.col("DATE").isNotNull()).select(
        "DATE", "TEMP_AVG", "PRECIPITATION_TOTAL"
    )
    if materialize:
        dated = cut_lineage(dated)
    anchor = dated.agg(F.max("DATE")).scalar()
    member = [
        F.when(F.lit(True) if n is None else F.col("DATE") > F.date_sub(anchor, n), F.lit(name))
        for name, n in periods.items()
    ]
    fanned = dated.select(
        "DATE", "TEMP_AVG", "PRECIPITATION_TOTAL",
        F.explode(F.array_compact(F.array(*member))).alias("PERIOD"),
    )
    return fanned.groupBy("PERIOD").agg(
        F.count(F.lit(1)).alias("DAYS"),
        F.min("DATE").alias("FIRST_DATE"),
        F.max("DATE").alias("LAST_DATE"),
        F.round(F.avg("TEMP_AVG"), 6).alias("TEMP_AVG"),
        F.sum("PRECIPITATION_TOTAL").alias("PRECIPITATION_TOTAL"),
    )


def overall_mean(enriched: DataFrame) -> DataFrame:
    """Mean temperature of the period: of daily means, and of all observations."""
    per_day = enriched.groupBy("DATE").agg(
        F.avg("TAVG").alias("_m"), F.sum("TAVG").alias("_s"), F.count("TAVG").alias("_n")
    )
    return per_day.agg(
        F.round(F.avg("_m"), 6).alias("MEAN_OF_DAILY_MEANS"),
        F.round(F.try_divide(F.sum("_s"), F.sum("_n")), 6).alias("MEAN_OF_OBSERVATIONS"),
    )


def extreme_months(monthly: DataFrame) -> DataFrame:
    """Hottest and coldest (YEAR, MONTH) by mean temperature; ties: earliest."""
    m = monthly.filter(F.col("TEMP_AVG").isNotNull() & F.col("YEAR").isNotNull())
    ym = F.struct("YEAR", "MONTH", "TEMP_AVG")
    hot = F.max_by(ym, F.struct(F.col("TEMP_AVG"), -F.col("YEAR"), -F.col("MONTH")))
    cold = F.min_by(ym, F.struct(F.col("TEMP_AVG"), F.col("YEAR"), F.col("MONTH")))
    return m.agg(hot.alias("h"), cold.alias("c")).select(
        F.col("h.YEAR").alias("HOTTEST_YEAR"),
        F.col("h.MONTH").alias("HOTTEST_MONTH"),
        F.col("h.TEMP_AVG").alias("HOTTEST_TEMP"),
        F.col("c.YEAR").alias("COLDEST_YEAR"),
        F.col("c.MONTH").alias("COLDEST_MONTH"),
        F.col("c.TEMP_AVG").alias("COLDEST_TEMP"),
    )


def wettest_season(seasonal: DataFrame) -> DataFrame:
    """Season with the most rain over all (dated) years; ties: first by name."""
    totals = (
        seasonal.filter(F.col("YEAR").isNotNull())
        .groupBy("SEASON")
        .agg(F.sum("PRECIPITATION_TOTAL").alias("PRECIPITATION_TOTAL"))
    )
    return totals.orderBy(F.col("PRECIPITATION_TOTAL").desc_nulls_last(), "SEASON").limit(1)


def hottest_year(yearly: DataFrame) -> DataFrame:
    """Year with the highest mean temperature; ties: earliest."""
    return (
        yearly.filter(F.col("YEAR").isNotNull() & F.col("TEMP_AVG").isNotNull())
        .select("YEAR", "TEMP_AVG")
        .orderBy(F.col("TEMP_AVG").desc(), "YEAR")
        .limit(1)
    )


def station_comparison(enriched: DataFrame, materialize: bool = True, codes: DataFrame | None = None) -> DataFrame:
    """Per station: mean temperature, total rain, counts and both ranks.

    Observation rows are reduced to one row per station by a partial
    aggregate; the ranks are computed in parallel (``rank.rank_desc``), not by
    a single-task window. The per-station table feeds both rankings, so it is
    checkpointed once (unless ``materialize`` is off). With ``codes``
    (``aggregate.station_codes``) the least name is found by hashing, not sorting.
    """
    rows = enriched.select("STATION", "STATION_NAME", "TAVG", "PRCP")
    if codes is not None:
        rows = aggregate.encoded(rows, codes, ("STATION_NAME",))
    per = rows.groupBy("STATION").agg(
        F.min("STATION_NAME").alias("STATION_NAME"),
        F.round(F.avg("TAVG"), 6).alias("TEMP_AVG"),
        F.sum("PRCP").alias("PRECIPITATION_TOTAL"),
        F.count(F.lit(1)).alias("N_OBS"),
    )
    if codes is not None:
        per = aggregate.decoded(per, codes, ("STATION_NAME",))
    if materialize:
        per = cut_lineage(per)
    by_temp = rank_desc(per, "TEMP_AVG", "TEMP_RANK")
    if materialize:
        by_temp = cut_lineage(by_temp)
    return rank_desc(by_temp, "PRECIPITATION_TOTAL", "RAIN_RANK")


def hot_cold_days(daily: DataFrame, hot: float = 30.0, cold: float = 5.0) -> DataFrame:
    """Number of dated days with mean temperature above ``hot`` / below ``cold``."""
    dated = daily.filter(F.col("DATE").isNotNull())
    return dated.agg(
        F.count_if(F.col("TEMP_AVG") > hot).alias("HOT_DAYS"),
        F.count_if(F.col("TEMP_AVG") < cold).alias("COLD_DAYS"),
        F.count(F.lit(1)).alias("TOTAL_DAYS"),
    )


def season_profile(enriched: DataFrame) -> DataFrame:
    """Mean and standard deviation of temperature (and mean rain) per season, all years."""
    return (
        enriched.filter(F.col("DATE").isNotNull())
        .groupBy("SEASON")
        .agg(
            F.round(F.avg("TAVG"), 6).alias("TEMP_MEAN"),
            F.round(F.stddev_samp("TAVG"), 6).alias("TEMP_STD"),
            F.round(F.avg("PRCP"), 6).alias("PRECIPITATION_MEAN"),
            F.count(F.lit(1)).alias("N_OBS"),
        )
    )


def seasonal_anomalies(daily: DataFrame, z: float = 2.0) -> DataFrame:
    """Dated days whose mean temperature is more than ``z`` season std from the season mean.

    Season statistics are a 4-row grouped aggregate joined back on SEASON
    (AQE turns the join into a broadcast of those 4 rows at run time).
    """
    dated = daily.filter(F.col("DATE").isNotNull() & F.col("TEMP_AVG").isNotNull())
    stats = dated.groupBy("SEASON").agg(
        F.avg("TEMP_AVG").alias("SEASON_MEAN"), F.stddev_samp("TEMP_AVG").alias("SEASON_STD")
    )
    zc = (F.col("TEMP_AVG") - F.col("SEASON_MEAN")) / F.col("SEASON_STD")
    return (
        dated.select("DATE", "SEASON", "TEMP_AVG")
        .join(stats, "SEASON")
        .filter((F.col("SEASON_STD") > 0) & (F.abs(zc) > z))
        .select(
            "DATE",
            "SEASON",
            "TEMP_AVG",
            F.round("SEASON_MEAN", 6).alias("SEASON_MEAN"),
            F.round("SEASON_STD", 6).alias("SEASON_STD"),
            F.round(zc, 6).alias("Z_SCORE"),
        )
    )
