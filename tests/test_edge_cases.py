"""Hand-made edge cases (null labels, boundaries, NaN, malformed dates,
single observations, ragged payloads, histogram edges, row frames, empty
input, missing columns)."""

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbus.functions.calendar import season
from nimbus.functions.categories import rain_category, temp_category
from nimbus.operators import aggregate, clean, dashboard, enrich, insight, ledger, query, trend
from nimbus.sources import payload

OBS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("STATION", "STATION_NAME", "DATE")]
    + [T.StructField(c, T.DoubleType()) for c in ("TAVG", "TMAX", "TMIN", "PRCP", "RHUM", "AWND")]
)


def obs(spark, rows):
    full = [tuple(r) + (None,) * (9 - len(r)) for r in rows]
    return spark.createDataFrame(full, OBS)


def test_null_categories_fall_through(spark):
    df = spark.createDataFrame([(None, None)], "t double, p double")
    row = df.select(temp_category(F.col("t")).alias("a"), rain_category(F.col("p")).alias("b")).first()
    assert (row.a, row.b) == ("Hot", "Extreme")
    row = df.select(temp_category(F.col("t"), "Unknown").alias("a")).first()
    assert row.a == "Unknown"


def test_category_boundaries(spark):
    t = spark.createDataFrame([(v,) for v in (-0.1, 0.0, 10.0, 20.0, 30.0)], "t double")
    got = [r[0] for r in t.select(temp_category(F.col("t"))).collect()]
    assert got == ["Freezing", "Cold", "Mild", "Warm", "Hot"]
    p = spark.createDataFrame([(v,) for v in (0.0, 2.0, 10.0, 50.0, 50.1, -1.0)], "p double")
    got = [r[0] for r in p.select(rain_category(F.col("p"))).collect()]
    assert got == ["No Rain", "Light", "Moderate", "Heavy", "Extreme", "Extreme"]


def test_seasons(spark):
    m = spark.createDataFrame([(v,) for v in (2, 3, 5, 6, 8, 9, 11, 12)], "m int")
    got = [r[0] for r in m.select(season(F.col("m"))).collect()]
    assert got == ["Winter", "Spring", "Spring", "Summer", "Summer", "Fall", "Fall", "Winter"]


def test_dedup_with_nulls(spark):
    df = obs(spark, [("A", "a", "2020-01-01", None, 1.0), ("A", "a", "2020-01-01", None, 1.0)])
    assert clean.dedup_rows(df).count() == 1


def test_nan_handling(spark):
    nan = float("nan")
    df = obs(spark, [
        ("A", "a", "2020-01-01", nan, None, None, 1.0),   # NaN temperature: dropped
        ("A", "a", "2020-01-02", 5.0, None, None, nan),   # NaN rain: kept
    ])
    got = clean.clean(df).select("DATE").collect()
    assert [str(r.DATE) for r in got] == ["2020-01-02"]


def test_null_and_malformed_dates(spark):
    df = obs(spark, [("A", "a", None, 1.0), ("A", "a", "garbage", 2.0), ("A", "a", "2020-01-01", 3.0)])
    out = clean.clean(df)
    assert out.count() == 2  # null dropped, malformed kept as null date
    assert out.filter(F.col("DATE").isNull()).count() == 1
    assert clean.clean(df, drop_unparseable=True).count() == 1
    daily = aggregate.daily(enrich.enrich(out))
    assert daily.count() == 2  # one null-date group


def test_single_observation_std(spark):
    df = obs(spark, [("A", "a", "2020-01-01", 7.0)])
    d = aggregate.daily(enrich.enrich(clean.clean(df)))
    assert d.first().TEMP_STD is None
    st = dashboard.stats_temperature(d).first()
    assert st.temperature_std == 0.0 and st.temperature_mean == 7.0


def test_ragged_payload(spark):
    doc = {
        "location_name": "Nice",
        "latitude": 43.7,
        "longitude": 7.26,
        "fetch_timestamp": "2024-01-01T00:00:00",
        "data": {"daily": {
            "time": ["2024-01-01", "2024-01-02", "2024-01-03"],
            "temperature_2m_mean": [10.0, 11.0],
            "precipitation_sum": [1.5, None],
        }},
    }
    empty = {"location_name": "Empty", "data": {"daily": {}}}
    text = spark.createDataFrame([(json.dumps(doc),), (json.dumps(empty),)], "value string")
    rows = payload.flatten_payload(payload.parse_payloads(text)).orderBy("DATE").collect()
    assert [r.PRCP for r in rows] == [1.5, None, 0.0]
    assert [r.TAVG for r in rows] == [10.0, 11.0, None]
    assert [r.TMAX for r in rows] == [None, None, None]
    assert rows[0].STATION == "OPENMETEO_NICE"
    assert rows[0].STATION_NAME == "Nice, Côte d'Azur, France"
    assert rows[0].ELEVATION == 0


def test_histogram_drops_max_and_handles_equal_values(spark):
    vals = spark.createDataFrame([(float(v),) for v in range(21)], "TEMP_AVG double")
    h = dashboard.histogram(vals).orderBy("BIN").collect()
    assert len(h) == 20
    assert sum(r.COUNT for r in h) == 20  # the maximum (20) is in no bin
    assert h[0].LABEL == "0.0" and h[19].BIN_START == 19.0
    with_max = dashboard.histogram(vals, include_max=True).agg(F.sum("COUNT")).first()[0]
    assert with_max == 21
    same = spark.createDataFrame([(3.0,), (3.0,)], "TEMP_AVG double")
    assert [r.COUNT for r in dashboard.histogram(same).collect()] == [0] * 20


def test_histogram_matches_brute_force(spark):
    import random

    rnd = random.Random(7)
    data = [rnd.uniform(-12.3, 41.7) for _ in range(500)] + [None]
    df = spark.createDataFrame([(v,) for v in data], "TEMP_AVG double")
    vals = [v for v in data if v is not None]
    lo, hi = min(vals), max(vals)
    w = (hi - lo) / 20
    expect = []
    for i in range(20):
        start = lo + i * w
        expect.append(sum(1 for v in vals if start <= v < start + w))
    got = [r.COUNT for r in dashboard.histogram(df).orderBy("BIN").collect()]
    assert got == expect


def test_row_frame_spans_gaps(spark):
    days = ["2020-01-%02d" % d for d in (1, 2, 3, 4, 5, 10, 11, 12, 13, 14)]
    df = spark.createDataFrame(
        [(d, float(i)) for i, d in enumerate(days)], "DATE string, TEMP_AVG double"
    ).withColumn("DATE", F.to_date("DATE"))
    out = trend.moving_averages(df, {"MA3": ("TEMP_AVG", 3)}, block_rows=4).orderBy("DATE").collect()
    expect = [sum(range(max(0, i - 2), i + 1)) / (i - max(0, i - 2) + 1) for i in range(10)]
    assert [r.MA3 for r in out] == pytest.approx(expect)


def test_moving_average_blocks_equal_plain_window(spark):
    from pyspark.sql import Window

    import random

    rnd = random.Random(3)
    base = spark.range(0, 3000).select(
        F.date_add(F.to_date(F.lit("1990-01-01")), (F.col("id") * 2).cast("int")).alias("DATE"),
        (F.col("id") % 97).cast("double").alias("TEMP_AVG"),
    ).withColumn("TEMP_AVG", F.when(F.col("TEMP_AVG") % 13 == 0, None).otherwise(F.col("TEMP_AVG")))
    specs = {"MA7": ("TEMP_AVG", 7), "MA30": ("TEMP_AVG", 30)}
    ours = trend.moving_averages(base, specs, block_rows=rnd.choice([64, 100, 257]))
    w = Window.orderBy("DATE")
    plain = base.select(
        "DATE",
        F.avg("TEMP_AVG").over(w.rowsBetween(-6, 0)).alias("MA7"),
        F.avg("TEMP_AVG").over(w.rowsBetween(-29, 0)).alias("MA30"),
    )
    a = {r.DATE: (r.MA7, r.MA30) for r in ours.collect()}
    b = {r.DATE: (r.MA7, r.MA30) for r in plain.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or math.isclose(x, y, rel_tol=1e-12)


def test_station_positions_partitioned(spark):
    rows = [("S1", "2020-01-0%d" % d, float(d)) for d in range(1, 6)] + [
        ("S2", "2021-06-0%d" % d, float(10 * d)) for d in range(1, 4)
    ]
    df = spark.createDataFrame(rows, "STATION string, DATE string, TAVG double").withColumn(
        "DATE", F.to_date("DATE")
    ).withColumn("PRCP", F.lit(1.0))
    out = trend.station_trends(df).orderBy("STATION", "DATE").collect()
    s2 = [r.TEMP_MA_7D for r in out if r.STATION == "S2"]
    assert s2 == pytest.approx([10.0, 15.0, 20.0])


def test_empty_input(spark):
    df = obs(spark, [])
    rep = clean.clean_report(df).first()
    assert (rep.initial, rep.final, rep.retention_pct) == (0, 0, 0.0)
    assert aggregate.daily(enrich.enrich(clean.clean(df))).count() == 0
    assert dashboard.statistics(aggregate.daily(enrich.enrich(clean.clean(df)))).first().temperature_mean == 0.0


def test_missing_columns(spark):
    df = obs(spark, [("A", "a", "2020-01-01", 5.0, 6.0, 4.0, 1.0, 50.0, 3.0)]).drop("RHUM", "AWND")
    c = clean.clean(df)
    d = aggregate.daily(enrich.enrich(c))
    assert "HUMIDITY_AVG" not in d.columns and "WIND_SPEED_AVG" not in d.columns
    assert {"TEMP_AVG", "PRECIPITATION_TOTAL"} <= set(d.columns)
    assert "humidity_mean" not in dashboard.statistics(d).columns
    assert clean.project_available(d, ["DATE", "HUMIDITY_AVG", "TEMP_AVG"]).columns == ["DATE", "TEMP_AVG"]


def test_retention_null_when_input_zero(spark):
    runs = spark.createDataFrame(
        [("a", "t", 0, 0, 1.0, "SUCCESS"), ("a", "t", 10, 5, 3.0, "SUCCESS")],
        "transformation_name string, transformation_type string, input_records long, "
        "output_records long, processing_time_seconds double, status string",
    )
    r = ledger.transformation_performance(runs).first()
    assert r.avg_retention_rate == 50.0 and r.total_runs == 2


def test_december_joins_same_year(spark):
    df = obs(spark, [("A", "a", "2020-12-15", 1.0), ("A", "a", "2020-01-15", 3.0)])
    s = aggregate.seasonal(enrich.enrich(clean.clean(df))).collect()
    assert len(s) == 1 and s[0].SEASON == "Winter" and s[0].YEAR == 2020 and s[0].DAYS_COUNT == 2


def test_extremes_tie_to_earliest(spark):
    m = spark.createDataFrame(
        [(2000, 1, 5.0), (1999, 7, 9.0), (2001, 7, 9.0), (1998, 2, 5.0)],
        "YEAR int, MONTH int, TEMP_AVG double",
    )
    r = insight.extreme_months(m).first()
    assert (r.HOTTEST_YEAR, r.HOTTEST_MONTH, r.COLDEST_YEAR, r.COLDEST_MONTH) == (1999, 7, 1998, 2)


def test_month_year_grid_fills_absent_cells(spark):
    m = spark.createDataFrame([(2000, 1, 5.0), (2001, 3, 9.0)], "YEAR int, MONTH int, TEMP_AVG double")
    g = query.month_year_grid(m)
    assert g.count() == 24 and g.filter(F.col("TEMP_AVG").isNotNull()).count() == 2
    wide = query.month_year_grid_wide(m, [2000, 2001]).collect()
    assert len(wide) == 12 and wide[0]["2000"] == 5.0 and wide[2]["2001"] == 9.0
