"""Dashboard statistics over the daily frame: rain by month, summary
statistics, temperature histogram.

Summary values follow the dashboard's null conventions: an undefined mean,
minimum, maximum or standard deviation (no values, or one value for the
standard deviation) is reported as 0, and a sum over nothing is 0.
Global aggregates run as partial aggregates in every task followed by one
final merge of one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbus.functions.calendar import format_day, format_month
from nimbus.session import cut_lineage


def _z(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def monthly_rain(daily: DataFrame) -> DataFrame:
    """Sum of daily rain per (YEAR, MONTH) with a ``YYYY-MM`` label.

    Rows without a year (the null-date group) form no month.
    """
    return (
        daily.filter(F.col("YEAR").isNotNull() & F.col("MONTH").isNotNull())
        .groupBy("YEAR", "MONTH")
        .agg(F.coalesce(F.sum("PRECIPITATION_TOTAL"), F.lit(0.0)).alias("PRECIPITATION_TOTAL"))
        .withColumn("DATE", format_month(F.col("YEAR"), F.col("MONTH")))
        .orderBy("YEAR", "MONTH")
    )


def _temperature_aggs(digits: int | None) -> list[Column]:
    std = _z(F.stddev_samp("TEMP_AVG"))
    if digits is not None:
        std = F.round(std, digits)
    return [
        _z(F.avg("TEMP_AVG")).alias("temperature_mean"),
        _z(F.min("TEMP_AVG")).alias("temperature_min"),
        _z(F.max("TEMP_AVG")).alias("temperature_max"),
        std.alias("temperature_std"),
    ]


def _precipitation_aggs() -> list[Column]:
    return [
        F.coalesce(F.sum("PRECIPITATION_TOTAL"), F.lit(0.0)).alias("precipitation_total"),
        _z(F.avg("PRECIPITATION_TOTAL")).alias("precipitation_mean"),
        _z(F.max("PRECIPITATION_TOTAL")).alias("precipitation_max"),
        F.count_if(F.col("PRECIPITATION_TOTAL") > 0).alias("precipitation_days_with_rain"),
    ]


def _humidity_aggs() -> list[Column]:
    return [
        _z(F.avg("HUMIDITY_AVG")).alias("humidity_mean"),
        _z(F.min("HUMIDITY_AVG")).alias("humidity_min"),
        _z(F.max("HUMIDITY_AVG")).alias("humidity_max"),
    ]


def _period_aggs() -> list[Column]:
    return [
        format_day(F.min("DATE")).alias("period_start"),
        format_day(F.max("DATE")).alias("period_end"),
        F.count(F.lit(1)).alias("period_total_days"),
    ]


def stats_temperature(daily: DataFrame, digits: int | None = 6) -> DataFrame:
    return daily.agg(*_temperature_aggs(digits))


def stats_precipitation(daily: DataFrame) -> DataFrame:
    return daily.agg(*_precipitation_aggs())


def stats_humidity(daily: DataFrame) -> DataFrame:
    return daily.agg(*_humidity_aggs())


def stats_period(daily: DataFrame) -> DataFrame:
    return daily.agg(*_period_aggs())


def statistics(daily: DataFrame, digits: int | None = 6) -> DataFrame:
    """All summary groups in one pass, as flat columns.

    Groups whose source column is absent are left out.
    """
    aggs: list[Column] = []
    if "TEMP_AVG" in daily.columns:
        aggs += _temperature_aggs(digits)
    if "PRECIPITATION_TOTAL" in daily.columns:
        aggs += _precipitation_aggs()
    if "HUMIDITY_AVG" in daily.columns:
        aggs += _humidity_aggs()
    if "DATE" in daily.columns:
        aggs += _period_aggs()
    return daily.agg(*aggs)


def statistics_nested(daily: DataFrame, digits: int | None = 6) -> DataFrame:
    """Same values grouped into one struct column per topic."""
    flat = statistics(daily, digits)
    groups: dict[str, list[str]] = {}
    for c in flat.columns:
        topic, _, field = c.partition("_")
        groups.setdefault(topic, []).append(field)
    return flat.select(
        *[
            F.struct(*[F.col(f"{t}_{f}").alias(f) for f in fields]).alias(t)
            for t, fields in groups.items()
        ]
    )


def statistics_cards(daily: DataFrame) -> DataFrame:
    """The four summary cards as display text: mean temperature and humidity
    with one decimal, total rain with none, number of daily rows."""
    st = statistics(daily, None)
    text = lambda c, d: F.format_string(f"%.{d}f", F.round(F.col(c), d))
    return st.select(
        text("temperature_mean", 1).alias("avg_temp"),
        text("precipitation_total", 0).alias("total_precip"),
        text("humidity_mean", 1).alias("avg_humidity"),
        F.col("period_total_days").cast("string").alias("total_days"),
    )


def histogram(
    daily: DataFrame, col: str = "TEMP_AVG", bins: int = 20, include_max: bool = False, materialize: bool = True
) -> DataFrame:
    """Equal-width histogram with every bin kept (BIN, BIN_START, LABEL, COUNT), in the order of the bins.

    Bin ``i`` is ``[min + i*w, min + i*w + w)`` with ``w = (max - min) / bins``
    evaluated in double precision, exactly as the chart does; by default the
    maximum itself falls in no bin, and equal values give all-zero bins.
    Each value is tested against its computed bin and both neighbours, so a
    value on an edge that rounding places in two bins (or none) is counted
    the same way the edge arithmetic decides.

    The values are written once (unless the caller read them from storage), the
    bounds are taken from them by one global aggregate, and the binning is one
    scan of the values with both bounds as literals, a partial/final count of at
    most ``bins`` keys, and one row that is fanned out to all bins.
    """
    values = daily.select(F.col(col).alias("_v")).filter(F.col("_v").isNotNull())
    if materialize:
        values = cut_lineage(values, "histogram")
    least, most = values.agg(F.min("_v"), F.max("_v")).first()
    lo, hi = (F.lit(x).cast("double") for x in (least, most))
    width = (hi - lo) / F.lit(float(bins))
    start_of = lambda b: lo + b.cast("double") * width
    guess = F.when(width > 0, F.floor((F.col("_v") - lo) / width).cast("int"))
    cand = values.select(
        "_v", F.explode(F.array(guess - 1, guess, guess + 1)).alias("BIN")
    ).filter((F.col("BIN") >= 0) & (F.col("BIN") < bins))
    start = start_of(F.col("BIN"))
    inside = (F.col("_v") >= start) & (F.col("_v") < start + width)
    if include_max:
        inside = inside | ((F.col("BIN") == bins - 1) & (F.col("_v") == hi))
    counts = cand.filter(inside).groupBy("BIN").agg(F.count(F.lit(1)).alias("COUNT"))
    found = counts.agg(F.map_from_entries(F.collect_list(F.struct("BIN", "COUNT"))).alias("n"))
    every = found.select("n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("BIN"))
    bin_start = start_of(F.col("BIN"))
    return every.select(
        "BIN",
        bin_start.alias("BIN_START"),
        F.format_string("%.1f", F.round(bin_start, 1)).alias("LABEL"),
        F.coalesce(F.element_at("n", F.col("BIN")), F.lit(0)).cast("long").alias("COUNT"),
    )
