"""Column functions: labels, formatting, display conversions."""

import math

from pyspark.sql import functions as F

from nimbus.functions import (
    display_text,
    finite_or_null,
    format_day,
    format_month,
    month_label,
    null_to_zero,
    round_display,
)
from nimbus.operators import dashboard


def test_month_label_and_formats(spark):
    df = spark.createDataFrame([(2024, 1), (1999, 12), (None, None)], "y int, m int")
    got = df.select(
        month_label(F.col("y"), F.col("m")).alias("l"), format_month(F.col("y"), F.col("m")).alias("f")
    ).collect()
    assert [(r.l, r.f) for r in got] == [("Jan 2024", "2024-01"), ("Déc 1999", "1999-12"), (None, None)]
    d = spark.createDataFrame([("2020-02-29",)], "d string").select(format_day(F.to_date("d"))).first()[0]
    assert d == "2020-02-29"


def test_display_conversions(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.25,), (None,), (nan,), (inf,), (-2.04,)], "x double")
    rows = df.select(
        finite_or_null(F.col("x")).alias("f"),
        null_to_zero(F.col("x")).alias("z"),
        round_display(F.col("x")).alias("r"),
        display_text(F.col("x")).alias("t"),
    ).collect()
    assert rows[0].f == 1.25 and rows[0].z == 1.25 and rows[0].r == 1.3 and rows[0].t == "1.3"
    assert rows[1].f is None and rows[1].z == 0.0 and rows[1].t == "-"
    assert rows[2].f is None and rows[2].z == 0.0
    assert rows[3].f is None and math.isinf(rows[3].z)
    assert rows[4].t == "-2.0"


def test_statistics_nested(spark):
    daily = spark.createDataFrame(
        [("2020-01-01", 10.0, 1.0, 50.0), ("2020-01-02", 20.0, 0.0, 70.0)],
        "DATE string, TEMP_AVG double, PRECIPITATION_TOTAL double, HUMIDITY_AVG double",
    ).withColumn("DATE", F.to_date("DATE"))
    row = dashboard.statistics_nested(daily).first()
    assert row.temperature.mean == 15.0 and row.temperature.min == 10.0
    assert row.precipitation.total == 1.0 and row.precipitation.days_with_rain == 1
    assert row.humidity.max == 70.0
    assert row.period.start == "2020-01-01" and row.period.total_days == 2
    cards = dashboard.statistics_cards(daily).first()
    assert (cards.avg_temp, cards.total_precip, cards.avg_humidity, cards.total_days) == ("15.0", "1", "60.0", "2")
