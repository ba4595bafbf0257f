"""Distributed rank equals Spark's window rank (ties, nulls, skewed values)."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from nimbus.operators.rank import rank_desc


def _check(spark, values, buckets):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    ours = {r.id: r.R for r in rank_desc(df, "x", "R", buckets).collect()}
    ref = {
        r.id: r.R
        for r in df.withColumn("R", F.rank().over(Window.orderBy(F.col("x").desc_nulls_last()))).collect()
    }
    assert ours == ref


def test_rank_matches_window_rank(spark):
    rnd = random.Random(11)
    vals = [float(rnd.randint(0, 50)) for _ in range(400)] + [None] * 7 + [3.5] * 150
    _check(spark, vals, 16)
    _check(spark, vals, 1)
    _check(spark, [1.0], 8)
    _check(spark, [None, None], 8)
    _check(spark, [rnd.uniform(-5, 5) for _ in range(300)], 32)


def test_station_comparison_keeps_null_station(spark):
    from nimbus.operators.insight import station_comparison

    rows = [("A", "a", 1.0, 2.0), ("B", "b", 5.0, 0.0), (None, None, 3.0, 9.0)]
    df = spark.createDataFrame(rows, "STATION string, STATION_NAME string, TAVG double, PRCP double")
    got = {r.STATION: (r.TEMP_RANK, r.RAIN_RANK) for r in station_comparison(df).collect()}
    assert got == {"B": (1, 3), None: (2, 1), "A": (3, 2)}
