"""DuckDB oracle SQL for the registered queries.

Every statement starts from the same chain of common table expressions
(``obs_raw -> obs_clean -> obs_enriched -> daily/monthly/seasonal``) written
independently of the Spark code, so each oracle is a short final SELECT.
Values that are not exact in binary (standard deviations, slopes, ratios)
are rounded to 6 digits on both sides.
"""

from __future__ import annotations

PREFIX = r"""
WITH obs_b AS (
  SELECT concat('ST_', CAST(l_suppkey % 5 AS VARCHAR)) AS STATION,
         concat('Station ', CAST(l_suppkey % 5 AS VARCHAR)) AS STATION_NAME,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL
              WHEN l_orderkey % 101 = 0 THEN 'not-a-date'
              ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS DATE,
         CASE WHEN l_linenumber = 7 THEN NULL
              WHEN l_partkey % 211 = 0 THEN 75.0e0
              ELSE l_quantity - 10.0e0 END AS TAVG,
         CASE WHEN l_linenumber = 7 THEN NULL
              ELSE l_quantity - 10.0e0 + round(l_tax * 100.0e0) END AS TMAX,
         CASE WHEN l_linenumber = 7 THEN NULL
              ELSE l_quantity - 10.0e0 - round(l_discount * 100.0e0) END AS TMIN,
         CASE WHEN l_partkey % 17 = 0 THEN NULL
              WHEN l_partkey % 223 = 0 THEN -1.0e0
              ELSE round(l_discount * 100.0e0) * round(l_tax * 100.0e0) END AS PRCP,
         CAST(l_partkey % 103 AS DOUBLE) AS RHUM,
         CAST(l_orderkey % 50 AS DOUBLE) - 1.0e0 AS AWND,
         l_orderkey
  FROM lineitem),
obs_raw AS (
  SELECT STATION, STATION_NAME, DATE, TAVG, TMAX, TMIN, PRCP, RHUM, AWND FROM obs_b
  UNION ALL
  SELECT STATION, STATION_NAME, DATE, TAVG, TMAX, TMIN, PRCP, RHUM, AWND FROM obs_b
  WHERE l_orderkey % 31 = 0),
obs_dedup AS (SELECT DISTINCT * FROM obs_raw),
obs_clean AS (
  SELECT STATION, STATION_NAME, TRY_CAST(DATE AS DATE) AS DATE, TAVG, TMAX, TMIN, PRCP, RHUM, AWND
  FROM obs_dedup
  WHERE DATE IS NOT NULL
    AND (TAVG IS NULL OR TAVG BETWEEN -60 AND 60)
    AND (RHUM IS NULL OR RHUM BETWEEN 0 AND 100)
    AND (PRCP IS NULL OR PRCP >= 0)
    AND (AWND IS NULL OR AWND >= 0)),
obs_enriched AS (
  SELECT *,
         CAST(year(DATE) AS INTEGER) AS YEAR,
         CAST(month(DATE) AS INTEGER) AS MONTH,
         CAST(dayofmonth(DATE) AS INTEGER) AS DAY,
         CAST(dayofweek(DATE) + 1 AS INTEGER) AS DAY_OF_WEEK,
         CAST(weekofyear(DATE) AS INTEGER) AS WEEK_OF_YEAR,
         CASE WHEN month(DATE) BETWEEN 3 AND 5 THEN 'Spring'
              WHEN month(DATE) BETWEEN 6 AND 8 THEN 'Summer'
              WHEN month(DATE) BETWEEN 9 AND 11 THEN 'Fall'
              ELSE 'Winter' END AS SEASON,
         TMAX - TMIN AS TEMP_RANGE,
         CASE WHEN TAVG < 0 THEN 'Freezing' WHEN TAVG < 10 THEN 'Cold'
              WHEN TAVG < 20 THEN 'Mild' WHEN TAVG < 30 THEN 'Warm'
              ELSE 'Hot' END AS TEMP_CATEGORY,
         CASE WHEN PRCP = 0 THEN 'No Rain' WHEN PRCP > 0 AND PRCP <= 2 THEN 'Light'
              WHEN PRCP > 2 AND PRCP <= 10 THEN 'Moderate'
              WHEN PRCP > 10 AND PRCP <= 50 THEN 'Heavy'
              ELSE 'Extreme' END AS RAIN_CATEGORY
  FROM obs_clean),
daily AS (
  SELECT DATE, min(STATION) AS STATION, min(STATION_NAME) AS STATION_NAME,
         CAST(year(DATE) AS INTEGER) AS YEAR, CAST(month(DATE) AS INTEGER) AS MONTH,
         CAST(dayofmonth(DATE) AS INTEGER) AS DAY,
         CASE WHEN month(DATE) BETWEEN 3 AND 5 THEN 'Spring'
              WHEN month(DATE) BETWEEN 6 AND 8 THEN 'Summer'
              WHEN month(DATE) BETWEEN 9 AND 11 THEN 'Fall'
              ELSE 'Winter' END AS SEASON,
         avg(TAVG) AS TEMP_AVG, min(TAVG) AS TEMP_MIN, max(TAVG) AS TEMP_MAX,
         stddev_samp(TAVG) AS TEMP_STD,
         avg(RHUM) AS HUMIDITY_AVG, min(RHUM) AS HUMIDITY_MIN, max(RHUM) AS HUMIDITY_MAX,
         sum(PRCP) AS PRECIPITATION_TOTAL, avg(PRCP) AS PRECIPITATION_AVG,
         max(PRCP) AS PRECIPITATION_MAX,
         avg(AWND) AS WIND_SPEED_AVG, max(AWND) AS WIND_SPEED_MAX,
         count(*) AS RECORDS_COUNT
  FROM obs_enriched GROUP BY DATE),
monthly AS (
  SELECT YEAR, MONTH, min(STATION) AS STATION, min(STATION_NAME) AS STATION_NAME,
         avg(TAVG) AS TEMP_AVG, min(TAVG) AS TEMP_MIN, max(TAVG) AS TEMP_MAX,
         avg(RHUM) AS HUMIDITY_AVG, sum(PRCP) AS PRECIPITATION_TOTAL,
         avg(PRCP) AS PRECIPITATION_AVG, avg(AWND) AS WIND_SPEED_AVG,
         count(*) AS DAYS_COUNT
  FROM obs_enriched GROUP BY YEAR, MONTH),
seasonal AS (
  SELECT YEAR, SEASON, min(STATION) AS STATION, min(STATION_NAME) AS STATION_NAME,
         avg(TAVG) AS TEMP_AVG, min(TAVG) AS TEMP_MIN, max(TAVG) AS TEMP_MAX,
         sum(PRCP) AS PRECIPITATION_TOTAL, count(*) AS DAYS_COUNT
  FROM obs_enriched GROUP BY YEAR, SEASON),
yearly AS (
  SELECT YEAR, min(STATION) AS STATION, min(STATION_NAME) AS STATION_NAME,
         avg(TAVG) AS TEMP_AVG, min(TAVG) AS TEMP_MIN, max(TAVG) AS TEMP_MAX,
         avg(RHUM) AS HUMIDITY_AVG, sum(PRCP) AS PRECIPITATION_TOTAL,
         avg(PRCP) AS PRECIPITATION_AVG, avg(AWND) AS WIND_SPEED_AVG,
         count(*) AS DAYS_COUNT
  FROM obs_enriched GROUP BY YEAR),
daily_dated AS (SELECT * FROM daily WHERE DATE IS NOT NULL),
station_day AS (
  SELECT STATION, min(STATION_NAME) AS STATION_NAME, DATE,
         max(TMAX) AS TMAX, min(TMIN) AS TMIN, avg(TAVG) AS TAVG, sum(PRCP) AS PRCP,
         max(AWND) AS AWND, avg(RHUM) AS RHUM
  FROM obs_clean WHERE DATE IS NOT NULL GROUP BY STATION, DATE),
ledger_runs AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'CSV' WHEN '2-HIGH' THEN 'API'
              WHEN '3-MEDIUM' THEN 'JSON' ELSE 'OTHER' END AS source_type,
         CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PENDING'
              ELSE 'FAILED' END AS status,
         o_custkey AS records_count,
         CAST(o_orderkey % 101 AS DOUBLE) AS data_quality_score,
         o_orderdate AS ingestion_timestamp
  FROM orders),
transformation_runs AS (
  SELECT o_orderpriority AS transformation_name, o_orderstatus AS transformation_type,
         o_custkey % 500 AS input_records, o_custkey % 400 AS output_records,
         CAST(o_orderkey % 997 AS DOUBLE) / 100.0e0 AS processing_time_seconds,
         CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING'
              ELSE 'FAILED' END AS status
  FROM orders)
"""

# name -> final SELECT (appended to PREFIX)
_DR = "SELECT * REPLACE (round(TEMP_STD, 6) AS TEMP_STD) FROM daily"
_DDR = "SELECT * REPLACE (round(TEMP_STD, 6) AS TEMP_STD) FROM daily_dated"
_MONTHS = "['Jan', 'Fév', 'Mar', 'Avr', 'Mai', 'Jun', 'Jul', 'Aoû', 'Sep', 'Oct', 'Nov', 'Déc']"


def _label(y: str = "YEAR", m: str = "MONTH") -> str:
    return f"(list_element({_MONTHS}, {m}) || ' ' || CAST({y} AS VARCHAR))"


def _txt(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE printf('%.1f', round({x}, 1) + 0.0) END"


_FLAT = """
SELECT 'OPENMETEO_' || upper(STATION_NAME) AS STATION, STATION_NAME || ', Côte d''Azur, France' AS STATION_NAME,
       CAST(DATE AS VARCHAR) AS DATE, CAST(NULL AS DOUBLE) AS LATITUDE, CAST(NULL AS DOUBLE) AS LONGITUDE,
       0 AS ELEVATION, TMAX, TMIN, TAVG, PRCP, AWND, RHUM
FROM station_day"""

FINAL: dict[str, str] = {
    # B
    "dedup_rows": "SELECT * FROM obs_dedup",
    "drop_null_date": "SELECT * FROM obs_raw WHERE DATE IS NOT NULL",
    "parse_date": "SELECT * REPLACE (TRY_CAST(DATE AS DATE) AS DATE) FROM obs_raw",
    "valid_temperature": "SELECT * FROM obs_raw WHERE TAVG IS NULL OR TAVG BETWEEN -60 AND 60",
    "valid_humidity": "SELECT * FROM obs_raw WHERE RHUM IS NULL OR RHUM BETWEEN 0 AND 100",
    "valid_precipitation": "SELECT * FROM obs_raw WHERE PRCP IS NULL OR PRCP >= 0",
    "valid_wind": "SELECT * FROM obs_raw WHERE AWND IS NULL OR AWND >= 0",
    "clean": "SELECT * FROM obs_clean",
    "clean_report": """
SELECT initial, final, initial - final AS removed,
       CASE WHEN initial > 0 THEN round(final / initial * 100.0e0, 6) ELSE 0.0e0 END AS retention_pct
FROM (SELECT (SELECT count(*) FROM obs_raw) AS initial, (SELECT count(*) FROM obs_clean) AS final)""",
    "project_available": "SELECT DATE, TEMP_AVG, TEMP_MIN, TEMP_MAX FROM daily",
    "date_range": f"SELECT * FROM ({_DR}) WHERE DATE BETWEEN DATE '1996-03-01' AND DATE '1999-10-31'",
    "nonfinite_to_null": f"""
SELECT * REPLACE (CASE WHEN DAY > 3 OR DAY IS NULL THEN TEMP_AVG END AS TEMP_AVG,
                  CASE WHEN DAY > 3 OR DAY IS NULL THEN WIND_SPEED_MAX END AS WIND_SPEED_MAX) FROM ({_DR})""",
    "drop_null_measure": f"SELECT * FROM ({_DR}) WHERE TEMP_AVG IS NOT NULL AND (DAY > 3 OR DAY IS NULL)",
    # C
    "calendar_parts": "SELECT DATE, YEAR, MONTH, DAY, DAY_OF_WEEK, WEEK_OF_YEAR FROM obs_enriched",
    "season": "SELECT DATE, SEASON FROM obs_enriched",
    "temp_range": "SELECT TMAX, TMIN, TEMP_RANGE FROM obs_enriched",
    "temp_category": "SELECT TAVG, TEMP_CATEGORY FROM obs_enriched",
    "rain_category": "SELECT PRCP, RAIN_CATEGORY FROM obs_enriched",
    "enrich": "SELECT * FROM obs_enriched",
    "format_date": """
SELECT DATE, strftime(DATE, '%Y-%m-%d') AS DATE_TEXT,
       strftime(make_date(YEAR, MONTH, 1), '%Y-%m') AS MONTH_TEXT FROM daily""",
    "month_label": f"SELECT YEAR, MONTH, {_label()} AS LABEL FROM monthly",
    "null_to_zero": """
SELECT YEAR, MONTH, CASE WHEN MONTH IN (3, 5) OR MONTH IS NULL THEN 0.0e0
                         ELSE coalesce(PRECIPITATION_TOTAL, 0.0e0) END AS PRECIPITATION_TOTAL FROM monthly""",
    "round_display": """
SELECT DATE, round(TEMP_AVG, 1) + 0.0 AS TEMP_AVG, round(HUMIDITY_AVG, 1) + 0.0 AS HUMIDITY_AVG,
       round(PRECIPITATION_TOTAL, 0) + 0.0 AS PRECIPITATION_TOTAL FROM daily""",
    # D
    "daily": _DR,
    "monthly": "SELECT * FROM monthly",
    "seasonal": "SELECT * FROM seasonal",
    "yearly": "SELECT * FROM yearly",
    "monthly_rain": """
SELECT YEAR, MONTH, coalesce(sum(PRECIPITATION_TOTAL), 0.0e0) AS PRECIPITATION_TOTAL,
       strftime(make_date(YEAR, MONTH, 1), '%Y-%m') AS DATE
FROM daily WHERE YEAR IS NOT NULL AND MONTH IS NOT NULL GROUP BY YEAR, MONTH""",
    "stats_temperature": """
SELECT round(coalesce(avg(TEMP_AVG), 0), 6) AS temperature_mean,
       coalesce(min(TEMP_AVG), 0) AS temperature_min, coalesce(max(TEMP_AVG), 0) AS temperature_max,
       round(coalesce(stddev_samp(TEMP_AVG), 0), 6) AS temperature_std FROM daily""",
    "stats_precipitation": """
SELECT coalesce(sum(PRECIPITATION_TOTAL), 0) AS precipitation_total,
       round(coalesce(avg(PRECIPITATION_TOTAL), 0), 6) AS precipitation_mean,
       coalesce(max(PRECIPITATION_TOTAL), 0) AS precipitation_max,
       count(*) FILTER (WHERE PRECIPITATION_TOTAL > 0) AS precipitation_days_with_rain FROM daily""",
    "stats_humidity": """
SELECT round(coalesce(avg(HUMIDITY_AVG), 0), 6) AS humidity_mean,
       coalesce(min(HUMIDITY_AVG), 0) AS humidity_min, coalesce(max(HUMIDITY_AVG), 0) AS humidity_max
FROM daily""",
    "stats_period": """
SELECT strftime(min(DATE), '%Y-%m-%d') AS period_start, strftime(max(DATE), '%Y-%m-%d') AS period_end,
       count(*) AS period_total_days FROM daily""",
    "statistics": """
SELECT round(coalesce(avg(TEMP_AVG), 0), 6) AS temperature_mean,
       coalesce(min(TEMP_AVG), 0) AS temperature_min, coalesce(max(TEMP_AVG), 0) AS temperature_max,
       round(coalesce(stddev_samp(TEMP_AVG), 0), 6) AS temperature_std,
       coalesce(sum(PRECIPITATION_TOTAL), 0) AS precipitation_total,
       round(coalesce(avg(PRECIPITATION_TOTAL), 0), 6) AS precipitation_mean,
       coalesce(max(PRECIPITATION_TOTAL), 0) AS precipitation_max,
       count(*) FILTER (WHERE PRECIPITATION_TOTAL > 0) AS precipitation_days_with_rain,
       round(coalesce(avg(HUMIDITY_AVG), 0), 6) AS humidity_mean,
       coalesce(min(HUMIDITY_AVG), 0) AS humidity_min, coalesce(max(HUMIDITY_AVG), 0) AS humidity_max,
       strftime(min(DATE), '%Y-%m-%d') AS period_start, strftime(max(DATE), '%Y-%m-%d') AS period_end,
       count(*) AS period_total_days FROM daily""",
    "statistics_cards": """
SELECT printf('%.1f', round(coalesce(avg(TEMP_AVG), 0), 1) + 0.0) AS avg_temp,
       printf('%.0f', round(coalesce(sum(PRECIPITATION_TOTAL), 0), 0) + 0.0) AS total_precip,
       printf('%.1f', round(coalesce(avg(HUMIDITY_AVG), 0), 1) + 0.0) AS avg_humidity,
       CAST(count(*) AS VARCHAR) AS total_days FROM daily""",
    "histogram": """
, hv AS (SELECT TEMP_AVG AS v FROM daily WHERE TEMP_AVG IS NOT NULL),
hb AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20.0e0 AS w FROM hv),
hg AS (SELECT CAST(range AS INTEGER) AS BIN FROM range(20))
SELECT hg.BIN, round(hb.lo + hg.BIN * hb.w, 6) AS BIN_START,
       printf('%.1f', round(hb.lo + hg.BIN * hb.w, 1) + 0.0) AS LABEL,
       (SELECT count(*) FROM hv WHERE hv.v >= hb.lo + hg.BIN * hb.w
                                AND hv.v < hb.lo + hg.BIN * hb.w + hb.w) AS COUNT
FROM hg, hb""",
    "dataset_counts": """
SELECT 'raw' AS DATASET, count(*) AS RECORDS FROM obs_raw
UNION ALL SELECT 'clean', count(*) FROM obs_clean
UNION ALL SELECT 'enriched', count(*) FROM obs_enriched
UNION ALL SELECT 'daily', count(*) FROM daily
UNION ALL SELECT 'monthly', count(*) FROM monthly
UNION ALL SELECT 'seasonal', count(*) FROM seasonal
UNION ALL SELECT 'trends', count(*) FROM daily_dated""",
    # E
    "temp_ma_7d": """
SELECT DATE, TEMP_AVG, round(avg(TEMP_AVG) OVER (ORDER BY DATE ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6)
       AS TEMP_MA_7D FROM daily_dated""",
    "temp_ma_30d": """
SELECT DATE, TEMP_AVG, round(avg(TEMP_AVG) OVER (ORDER BY DATE ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6)
       AS TEMP_MA_30D FROM daily_dated""",
    "prcp_ma_7d": """
SELECT DATE, PRECIPITATION_TOTAL,
       round(avg(PRECIPITATION_TOTAL) OVER (ORDER BY DATE ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6)
       AS PRCP_MA_7D FROM daily_dated""",
    "trends": f"""
SELECT *, round(avg(TEMP_AVG) OVER w7, 6) AS TEMP_MA_7D, round(avg(TEMP_AVG) OVER w30, 6) AS TEMP_MA_30D,
       round(avg(PRECIPITATION_TOTAL) OVER w7, 6) AS PRCP_MA_7D
FROM ({_DDR})
WINDOW w7 AS (ORDER BY DATE ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (ORDER BY DATE ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "station_trends": """
SELECT STATION, DATE, round(TAVG, 6) AS TAVG, PRCP,
       round(avg(TAVG) OVER w7, 6) AS TEMP_MA_7D, round(avg(TAVG) OVER w30, 6) AS TEMP_MA_30D,
       round(avg(PRCP) OVER w7, 6) AS PRCP_MA_7D
FROM (SELECT STATION, DATE, avg(TAVG) AS TAVG, sum(PRCP) AS PRCP FROM obs_clean
      WHERE DATE IS NOT NULL GROUP BY STATION, DATE)
WINDOW w7 AS (PARTITION BY STATION ORDER BY DATE ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY STATION ORDER BY DATE ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    # F
    "daily_query": f"""
SELECT * REPLACE (strftime(DATE, '%Y-%m-%d') AS DATE)
FROM ({_DR}) WHERE DATE BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
ORDER BY DATE DESC NULLS LAST LIMIT 5000""",
    "monthly_query": "SELECT * FROM monthly",
    "seasonal_query": "SELECT * FROM seasonal",
    "temperature_trend": """
SELECT strftime(DATE, '%Y-%m-%d') AS DATE, TEMP_AVG, TEMP_MIN, TEMP_MAX
FROM daily_dated ORDER BY daily_dated.DATE DESC LIMIT 1095""",
    "last_n_days": f"SELECT * FROM ({_DDR}) ORDER BY DATE DESC LIMIT 365",
    "rain_last_24_months": f"""
SELECT YEAR, MONTH, {_label()} AS LABEL, coalesce(PRECIPITATION_TOTAL, 0.0e0) AS PRECIPITATION_TOTAL
FROM monthly ORDER BY YEAR DESC NULLS LAST, MONTH DESC NULLS LAST LIMIT 24""",
    "preview_50": f"""
SELECT coalesce(strftime(DATE, '%Y-%m-%d'), '-') AS DATE, {_txt('TEMP_AVG')} AS TEMP_AVG,
       {_txt('TEMP_MIN')} AS TEMP_MIN, {_txt('TEMP_MAX')} AS TEMP_MAX,
       {_txt('PRECIPITATION_TOTAL')} AS PRECIPITATION_TOTAL, {_txt('HUMIDITY_AVG')} AS HUMIDITY_AVG
FROM daily ORDER BY daily.DATE DESC NULLS LAST LIMIT 50""",
    "monthly_series": f"SELECT YEAR, MONTH, {_label()} AS LABEL, TEMP_AVG FROM monthly",
    # G
    "month_year_grid": """
SELECT m.MONTH, y.YEAR, mo.TEMP_AVG
FROM (SELECT DISTINCT YEAR FROM monthly WHERE YEAR IS NOT NULL) y
CROSS JOIN (SELECT CAST(range AS INTEGER) AS MONTH FROM range(1, 13)) m
LEFT JOIN monthly mo ON mo.YEAR = y.YEAR AND mo.MONTH = m.MONTH""",
    "seasonal_series": """
SELECT YEAR, max(CASE WHEN SEASON = 'Winter' THEN TEMP_AVG END) AS Winter,
       max(CASE WHEN SEASON = 'Spring' THEN TEMP_AVG END) AS Spring,
       max(CASE WHEN SEASON = 'Summer' THEN TEMP_AVG END) AS Summer,
       max(CASE WHEN SEASON = 'Fall' THEN TEMP_AVG END) AS Fall
FROM seasonal GROUP BY YEAR""",
    "distinct_years": "SELECT DISTINCT YEAR FROM monthly",
    "aggregation_facts": """
, fl AS (
  SELECT DATE, YEAR, MONTH, SEASON, m.metric_name, m.v
  FROM obs_enriched,
       LATERAL (VALUES ('temperature', TAVG), ('humidity', RHUM), ('precipitation', PRCP),
                       ('wind_speed', AWND)) m(metric_name, v)
  WHERE DATE IS NOT NULL),
ff AS (
  SELECT 'DAILY' AS aggregation_type, metric_name, CAST(DATE AS VARCHAR) AS period_key, DATE, v FROM fl
  UNION ALL SELECT 'MONTHLY', metric_name, printf('%04d-%02d', YEAR, MONTH), DATE, v FROM fl
  UNION ALL SELECT 'SEASONAL', metric_name, CAST(YEAR AS VARCHAR) || '-' || SEASON, DATE, v FROM fl
  UNION ALL SELECT 'YEARLY', metric_name, CAST(YEAR AS VARCHAR), DATE, v FROM fl)
SELECT aggregation_type, metric_name, period_key, min(DATE) AS period_start, max(DATE) AS period_end,
       CAST(TRY_CAST(CAST(avg(v) AS VARCHAR) AS DECIMAL(10, 2)) AS DOUBLE) AS value_mean, CAST(TRY_CAST(CAST(min(v) AS VARCHAR) AS DECIMAL(10, 2)) AS DOUBLE) AS value_min,
       CAST(TRY_CAST(CAST(max(v) AS VARCHAR) AS DECIMAL(10, 2)) AS DOUBLE) AS value_max,
       CAST(TRY_CAST(CAST(stddev_samp(v) AS VARCHAR) AS DECIMAL(10, 2)) AS DOUBLE) AS value_std, count(v) AS value_count,
       CAST(NULL AS VARCHAR) AS location
FROM ff GROUP BY aggregation_type, metric_name, period_key""",
    # H
    "record_ingestion": """
SELECT source_type, 'orders' AS source_name, status, records_count,
       CAST(TRY_CAST(CAST(data_quality_score AS VARCHAR) AS DECIMAL(5, 2)) AS DOUBLE) AS data_quality_score,
       ingestion_timestamp FROM ledger_runs""",
    "record_transformation": """
SELECT transformation_name, transformation_type, input_records, least(output_records, input_records) AS output_records,
       greatest(input_records - least(output_records, input_records), 0) AS records_dropped,
       processing_time_seconds, status FROM transformation_runs""",
    "ingestion_stats": """
SELECT source_type, count(*) AS total_ingestions, CAST(sum(records_count) AS BIGINT) AS total_records,
       avg(data_quality_score) AS avg_quality_score, max(ingestion_timestamp) AS last_ingestion
FROM ledger_runs GROUP BY source_type""",
    "ingestion_summary": """
SELECT source_type, count(*) AS total_ingestions, CAST(sum(records_count) AS BIGINT) AS total_records,
       avg(data_quality_score) AS avg_quality_score,
       CAST(sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS successful_ingestions,
       CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed_ingestions,
       max(ingestion_timestamp) AS last_ingestion
FROM ledger_runs GROUP BY source_type""",
    "transformation_performance": """
SELECT transformation_name, transformation_type, count(*) AS total_runs,
       round(avg(processing_time_seconds), 6) AS avg_processing_time,
       round(avg(CAST(output_records AS DOUBLE) / NULLIF(input_records, 0) * 100), 6) AS avg_retention_rate,
       CAST(sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS successful_runs
FROM transformation_runs GROUP BY transformation_name, transformation_type""",
    "ledger_constraints": """
, ing AS (
  SELECT concat_ws(',', CASE WHEN records_count % 13 = 0 THEN 'source_type' END,
                   CASE WHEN status IS NULL OR status NOT IN ('PENDING', 'SUCCESS', 'FAILED', 'PARTIAL') THEN 'status' END,
                   CASE WHEN data_quality_score * 1.5 - 10 < 0 OR data_quality_score * 1.5 - 10 > 100
                        THEN 'quality_score' END) AS violations FROM ledger_runs),
tra AS (
  SELECT concat_ws(',', CASE WHEN status IS NULL OR status NOT IN ('PENDING', 'RUNNING', 'SUCCESS', 'FAILED')
                        THEN 'status' END,
                   CASE WHEN output_records > input_records THEN 'output_exceeds_input' END) AS violations
  FROM transformation_runs)
SELECT 'ingestion' AS kind, violations, count(*) AS n_rows FROM ing WHERE violations <> '' GROUP BY violations
UNION ALL SELECT 'transformation', violations, count(*) FROM tra WHERE violations <> '' GROUP BY violations
UNION ALL SELECT 'aggregation', 'aggregation_type', 4 * count(DISTINCT YEAR) FROM obs_enriched WHERE DATE IS NOT NULL""",
    # I
    "quality_checks": """
, qc AS (
  SELECT count(*) AS total,
         count(*) FILTER (WHERE DATE IS NULL) AS date_present,
         count(*) FILTER (WHERE DATE IS NOT NULL AND TRY_CAST(DATE AS DATE) IS NULL) AS date_parseable,
         count(*) FILTER (WHERE TAVG IS NOT NULL AND NOT (TAVG >= -60 AND TAVG <= 60)) AS temperature_range,
         count(*) FILTER (WHERE RHUM IS NOT NULL AND NOT (RHUM >= 0 AND RHUM <= 100)) AS humidity_range,
         count(*) FILTER (WHERE PRCP IS NOT NULL AND NOT (PRCP >= 0)) AS precipitation_range,
         count(*) FILTER (WHERE AWND IS NOT NULL AND NOT (AWND >= 0)) AS wind_speed_range,
         count(*) - (SELECT count(*) FROM obs_dedup) AS duplicate_rows
  FROM obs_raw),
ql AS (
  SELECT 'duplicate_rows' AS check_name, 'uniqueness' AS check_type, duplicate_rows AS failed, total FROM qc
  UNION ALL SELECT 'date_present', 'completeness', date_present, total FROM qc
  UNION ALL SELECT 'date_parseable', 'validity', date_parseable, total FROM qc
  UNION ALL SELECT 'temperature_range', 'range', temperature_range, total FROM qc
  UNION ALL SELECT 'humidity_range', 'range', humidity_range, total FROM qc
  UNION ALL SELECT 'precipitation_range', 'range', precipitation_range, total FROM qc
  UNION ALL SELECT 'wind_speed_range', 'range', wind_speed_range, total FROM qc)
SELECT check_name, check_type, coalesce(CAST(failed AS DOUBLE) / NULLIF(total, 0) <= 0.05, true) AS passed,
       CAST(total AS BIGINT) AS total_records, CAST(failed AS BIGINT) AS failed_records,
       CAST(5.0 AS DOUBLE) AS threshold_value,
       CAST(TRY_CAST(CAST(coalesce(CAST(failed AS DOUBLE) / NULLIF(total, 0) * 100.0e0, 0.0e0) AS VARCHAR) AS DECIMAL(10, 2)) AS DOUBLE) AS actual_value
FROM ql""",
    "quality_score": """
SELECT initial AS records_count, final AS records_valid, initial - final AS records_invalid,
       CAST(TRY_CAST(CAST(CASE WHEN initial > 0 THEN final / initial * 100.0e0 ELSE 0.0e0 END AS VARCHAR) AS DECIMAL(5, 2)) AS DOUBLE)
       AS data_quality_score
FROM (SELECT (SELECT count(*) FROM obs_raw) AS initial, (SELECT count(*) FROM obs_clean) AS final)""",
    "period_window": """
, anchor AS (SELECT max(DATE) AS a FROM daily_dated),
periods AS (SELECT * FROM (VALUES ('last_7_days', 7), ('last_30_days', 30), ('last_90_days', 90),
                                  ('last_year', 365), ('all_time', NULL)) p(PERIOD, n))
SELECT PERIOD, count(*) AS DAYS, min(DATE) AS FIRST_DATE, max(DATE) AS LAST_DATE,
       round(avg(TEMP_AVG), 6) AS TEMP_AVG, sum(PRECIPITATION_TOTAL) AS PRECIPITATION_TOTAL
FROM daily_dated, anchor, periods
WHERE periods.n IS NULL OR daily_dated.DATE > anchor.a - CAST(periods.n AS INTEGER)
GROUP BY PERIOD""",
    "overall_mean": """
SELECT round(avg(TEMP_AVG), 6) AS MEAN_OF_DAILY_MEANS,
       round((SELECT avg(TAVG) FROM obs_enriched), 6) AS MEAN_OF_OBSERVATIONS FROM daily""",
    "trend_slope": """
, s AS (SELECT regr_slope(TEMP_AVG, CAST(DATE - DATE '1970-01-01' AS DOUBLE)) AS sl, count(TEMP_AVG) AS n
        FROM daily_dated)
SELECT round(sl, 9) AS SLOPE_PER_DAY, round(sl * 365.25, 6) AS SLOPE_PER_YEAR, n AS N_DAYS,
       CASE WHEN round(sl, 9) > 0 THEN 'rising' WHEN round(sl, 9) < 0 THEN 'falling'
            WHEN round(sl, 9) = 0 THEN 'flat' END AS DIRECTION FROM s""",
    "extreme_months": """
, m AS (SELECT * FROM monthly WHERE TEMP_AVG IS NOT NULL AND YEAR IS NOT NULL),
h AS (SELECT YEAR, MONTH, TEMP_AVG FROM m ORDER BY TEMP_AVG DESC, YEAR, MONTH LIMIT 1),
c AS (SELECT YEAR, MONTH, TEMP_AVG FROM m ORDER BY TEMP_AVG ASC, YEAR, MONTH LIMIT 1)
SELECT h.YEAR AS HOTTEST_YEAR, h.MONTH AS HOTTEST_MONTH, h.TEMP_AVG AS HOTTEST_TEMP,
       c.YEAR AS COLDEST_YEAR, c.MONTH AS COLDEST_MONTH, c.TEMP_AVG AS COLDEST_TEMP FROM h, c""",
    "wettest_season": """
SELECT SEASON, sum(PRECIPITATION_TOTAL) AS PRECIPITATION_TOTAL FROM seasonal WHERE YEAR IS NOT NULL
GROUP BY SEASON ORDER BY PRECIPITATION_TOTAL DESC NULLS LAST, SEASON LIMIT 1""",
    "hottest_year": """
SELECT YEAR, TEMP_AVG FROM yearly WHERE YEAR IS NOT NULL AND TEMP_AVG IS NOT NULL
ORDER BY TEMP_AVG DESC, YEAR LIMIT 1""",
    "station_comparison": """
SELECT *, CAST(rank() OVER (ORDER BY TEMP_AVG DESC NULLS LAST) AS INTEGER) AS TEMP_RANK,
       CAST(rank() OVER (ORDER BY PRECIPITATION_TOTAL DESC NULLS LAST) AS INTEGER) AS RAIN_RANK
FROM (SELECT STATION, min(STATION_NAME) AS STATION_NAME, round(avg(TAVG), 6) AS TEMP_AVG,
             sum(PRCP) AS PRECIPITATION_TOTAL, count(*) AS N_OBS FROM obs_enriched GROUP BY STATION)""",
    "station_slopes": """
SELECT STATION, round(regr_slope(TAVG, x), 9) AS SLOPE_PER_DAY, round(regr_r2(TAVG, x), 6) AS R2,
       count(TAVG) AS N_OBS,
       CASE WHEN round(regr_slope(TAVG, x), 9) > 0 THEN 'rising'
            WHEN round(regr_slope(TAVG, x), 9) < 0 THEN 'falling'
            WHEN round(regr_slope(TAVG, x), 9) = 0 THEN 'flat' END AS DIRECTION
FROM (SELECT *, CAST(DATE - DATE '1970-01-01' AS DOUBLE) AS x FROM obs_clean WHERE DATE IS NOT NULL)
GROUP BY STATION""",
    "hot_cold_days": """
SELECT count(*) FILTER (WHERE TAVG > 30) AS HOT_DAYS, count(*) FILTER (WHERE TAVG < 5) AS COLD_DAYS,
       count(*) AS TOTAL_DAYS FROM station_day""",
    "season_profile": """
SELECT SEASON, round(avg(TAVG), 6) AS TEMP_MEAN, round(stddev_samp(TAVG), 6) AS TEMP_STD,
       round(avg(PRCP), 6) AS PRECIPITATION_MEAN, count(*) AS N_OBS
FROM obs_enriched WHERE DATE IS NOT NULL GROUP BY SEASON""",
    "seasonal_anomalies": """
, d AS (SELECT DATE, SEASON, TEMP_AVG FROM daily_dated WHERE TEMP_AVG IS NOT NULL),
st AS (SELECT SEASON, avg(TEMP_AVG) AS mu, stddev_samp(TEMP_AVG) AS sd FROM d GROUP BY SEASON)
SELECT d.DATE, d.SEASON, d.TEMP_AVG, round(mu, 6) AS SEASON_MEAN, round(sd, 6) AS SEASON_STD,
       round((d.TEMP_AVG - mu) / sd, 6) AS Z_SCORE
FROM d JOIN st ON d.SEASON = st.SEASON WHERE sd > 0 AND abs((d.TEMP_AVG - mu) / sd) > 2.0""",
    # A
    "scan_csv": "SELECT * FROM obs_raw",
    "sink_csv": """
SELECT CAST(DATE AS VARCHAR) AS "Date", TEMP_AVG AS "Temp Moy", TEMP_MIN AS "Temp Min",
       TEMP_MAX AS "Temp Max", PRECIPITATION_TOTAL AS "Précipitations", HUMIDITY_AVG AS "Humidité"
FROM daily""",
    "flatten_payload": """
, ranked AS (
  SELECT *, year(DATE) % 2 = 1 AS odd,
         row_number() OVER (PARTITION BY STATION, year(DATE) ORDER BY DATE) AS i FROM station_day)
SELECT 'OPENMETEO_' || upper(STATION_NAME) AS STATION, STATION_NAME || ', Côte d''Azur, France' AS STATION_NAME,
       CAST(DATE AS VARCHAR) AS DATE, CAST(NULL AS DOUBLE) AS LATITUDE, CAST(NULL AS DOUBLE) AS LONGITUDE,
       0 AS ELEVATION, CASE WHEN odd AND i > 30 THEN NULL ELSE TMAX END AS TMAX, TMIN, TAVG,
       CASE WHEN odd AND i > 50 THEN 0.0e0 ELSE PRCP END AS PRCP, AWND, RHUM
FROM ranked""",
    "land_raw_json": _FLAT,
    "enrich_station": """
SELECT STATION_NAME AS location_name, 'OPENMETEO_' || upper(STATION_NAME) AS STATION,
       STATION_NAME || ', Côte d''Azur, France' AS STATION_NAME, 0 AS ELEVATION FROM obs_raw""",
    "sink_parquet": _DR,
    "scan_dataset": "SELECT * FROM monthly",
    "save_all": """
SELECT 'daily' AS dataset_name, count(*) AS record_count, '' AS partitioned_by,
       'snappy' AS compression, 'overwrite' AS mode, CAST(NULL AS VARCHAR) AS error FROM daily
UNION ALL SELECT 'monthly', count(*), '', 'snappy', 'overwrite', NULL FROM monthly
UNION ALL SELECT 'seasonal', count(*), '', 'snappy', 'overwrite', NULL FROM seasonal""",
    # J
    "resumable_ingest": "SELECT * FROM obs_raw",
    "ingest_payloads": _FLAT,
    "ingest_progress": """
SELECT CAST(4 AS BIGINT) AS batches, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (WHERE DATE IS NULL OR TRY_CAST(DATE AS DATE) IS NULL) AS BIGINT) AS failed_rows,
       CAST(count(*) AS BIGINT) AS cumulative_rows FROM obs_raw""",
    "ingest_share": """
SELECT DISTINCT CAST(5 AS BIGINT) AS files_landed, CAST(4 AS BIGINT) AS files_done, CAST(1 AS BIGINT) AS files_remaining,
       CAST(80.0 AS DOUBLE) AS files_percent, true AS has_bytes FROM obs_raw""",
    "list_datasets": "SELECT DISTINCT n AS name FROM (VALUES ('daily'), ('monthly')) t(n), daily",
    "datasets_overview": """
SELECT DISTINCT n AS name, true AS has_size, true AS has_files, true AS has_time
FROM (VALUES ('daily'), ('monthly')) t(n), daily""",
    "dataset_info": "SELECT DISTINCT 'daily' AS name, true AS has_size, true AS has_files, true AS has_time FROM daily",
    "latest_file": """
SELECT 'later' AS landing, CAST(4 AS BIGINT) AS files, count(*) AS n_rows, sum(RHUM) AS rhum FROM obs_raw""",
    "process_all": """
, tr AS (SELECT *, avg(TEMP_AVG) OVER (ORDER BY DATE ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS MA FROM daily_dated)
SELECT 'raw' AS DATASET, count(*) AS RECORDS, round(sum(TAVG), 4) AS TEMP_SUM, round(sum(PRCP), 4) AS RAIN_SUM,
       min(DATE) AS FIRST_DAY, max(DATE) AS LAST_DAY, CAST(NULL AS BIGINT) AS WEEKDAY_SUM FROM obs_raw
UNION ALL SELECT 'clean', count(*), round(sum(TAVG), 4), round(sum(PRCP), 4), CAST(min(DATE) AS VARCHAR),
       CAST(max(DATE) AS VARCHAR), NULL FROM obs_clean
UNION ALL SELECT 'enriched', count(*), round(sum(TAVG), 4), round(sum(PRCP), 4), CAST(min(DATE) AS VARCHAR),
       CAST(max(DATE) AS VARCHAR), CAST(sum(DAY_OF_WEEK) AS BIGINT) FROM obs_enriched
UNION ALL SELECT 'daily', count(*), round(sum(TEMP_AVG), 4), round(sum(PRECIPITATION_TOTAL), 4),
       CAST(min(DATE) AS VARCHAR), CAST(max(DATE) AS VARCHAR), NULL FROM daily
UNION ALL SELECT 'monthly', count(*), round(sum(TEMP_AVG), 4), round(sum(PRECIPITATION_TOTAL), 4), NULL, NULL, NULL FROM monthly
UNION ALL SELECT 'seasonal', count(*), round(sum(TEMP_AVG), 4), round(sum(PRECIPITATION_TOTAL), 4), NULL, NULL, NULL FROM seasonal
UNION ALL SELECT 'trends', count(*), round(sum(MA), 4), round(sum(PRECIPITATION_TOTAL), 4),
       CAST(min(DATE) AS VARCHAR), CAST(max(DATE) AS VARCHAR), NULL FROM tr""",
}


def oracle_sql() -> dict[str, str]:
    return {name: PREFIX + body for name, body in FINAL.items()}
