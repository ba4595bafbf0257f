"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (through the bindings) in full, so its
work grows with the scale factor. Standard deviations, slopes and averages of
non-integer values are rounded to 6 digits so the oracle comparison does not
depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbus.functions.calendar import format_day, format_month, month_label, season
from nimbus.functions.categories import rain_category, temp_category, temp_range
from nimbus.functions.display import null_to_zero, round_display
from nimbus.operators import aggregate, clean, dashboard, enrich, insight, ledger, query, trend
from nimbus.plans import batch
from nimbus.plans import frames as fr
from nimbus.session import cut_lineage, unique_scratch
from nimbus.sources import bindings, files, payload
from nimbus.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn

    return deco


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols if c in df.columns})


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Rounded decimal columns as doubles (the same values, in the numeric type
    every comparison harness handles)."""
    from pyspark.sql import types as T

    return df.withColumns(
        {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    )


def daily_r(spark, sf) -> DataFrame:
    return r6(fr.daily(spark, sf), "TEMP_STD")


def daily_dated_r(spark, sf) -> DataFrame:
    return r6(fr.daily_dated(spark, sf), "TEMP_STD")


# ------------------------------------------------------------------ B: cleaning


@register("dedup_rows")
def q_dedup_rows(spark, sf):
    return clean.dedup_rows(fr.raw(spark, sf))


@register("drop_null_date")
def q_drop_null_date(spark, sf):
    return clean.drop_null_date(fr.raw(spark, sf))


@register("parse_date")
def q_parse_date(spark, sf):
    return clean.parse_date(fr.raw(spark, sf))


@register("valid_temperature")
def q_valid_temperature(spark, sf):
    return clean.valid_temperature(fr.raw(spark, sf))


@register("valid_humidity")
def q_valid_humidity(spark, sf):
    return clean.valid_humidity(fr.raw(spark, sf))


@register("valid_precipitation")
def q_valid_precipitation(spark, sf):
    return clean.valid_precipitation(fr.raw(spark, sf))


@register("valid_wind")
def q_valid_wind(spark, sf):
    return clean.valid_wind(fr.raw(spark, sf))


@register("clean")
def q_clean(spark, sf):
    return fr.cleaned(spark, sf)


@register("clean_report")
def q_clean_report(spark, sf):
    return clean.clean_report(fr.raw(spark, sf))


@register("project_available")
def q_project_available(spark, sf):
    return clean.project_available(
        fr.daily(spark, sf), ["DATE", "TEMP_AVG", "TEMP_MIN", "TEMP_MAX", "NOT_A_COLUMN"]
    )


@register("date_range")
def q_date_range(spark, sf):
    return clean.date_range(daily_r(spark, sf), "1996-03-01", "1999-10-31")


def _with_odd_values(df: DataFrame, *cols: str) -> DataFrame:
    """The first days of a month turned into NaN and infinities, so that there is something to clean.

    All rows are kept.
    """
    inf = float("inf")
    odd = {1: float("nan"), 2: inf, 3: -inf}
    return df.withColumns(
        {c: F.coalesce(*[F.when(F.col("DAY") == d, F.lit(v)) for d, v in odd.items()], F.col(c)) for c in cols}
    )


@register("nonfinite_to_null")
def q_nonfinite_to_null(spark, sf):
    return clean.nonfinite_to_null(_with_odd_values(daily_r(spark, sf), "TEMP_AVG", "WIND_SPEED_MAX"))


@register("drop_null_measure")
def q_drop_null_measure(spark, sf):
    odd = _with_odd_values(daily_r(spark, sf), "TEMP_AVG")
    return clean.drop_null_measure(clean.nonfinite_to_null(odd), "TEMP_AVG")


# ------------------------------------------------------------- C: scalar functions


@register("calendar_parts")
def q_calendar_parts(spark, sf):
    return fr.enriched(spark, sf).select(
        "DATE", "YEAR", "MONTH", "DAY", "DAY_OF_WEEK", "WEEK_OF_YEAR"
    )


@register("season")
def q_season(spark, sf):
    return fr.cleaned(spark, sf).select("DATE", season(F.month("DATE")).alias("SEASON"))


@register("temp_range")
def q_temp_range(spark, sf):
    return fr.cleaned(spark, sf).select(
        "TMAX", "TMIN", temp_range(F.col("TMAX"), F.col("TMIN")).alias("TEMP_RANGE")
    )


@register("temp_category")
def q_temp_category(spark, sf):
    return fr.cleaned(spark, sf).select("TAVG", temp_category(F.col("TAVG")).alias("TEMP_CATEGORY"))


@register("rain_category")
def q_rain_category(spark, sf):
    return fr.cleaned(spark, sf).select("PRCP", rain_category(F.col("PRCP")).alias("RAIN_CATEGORY"))


@register("enrich")
def q_enrich(spark, sf):
    return fr.enriched(spark, sf)


@register("format_date")
def q_format_date(spark, sf):
    return fr.daily(spark, sf).select(
        "DATE",
        format_day(F.col("DATE")).alias("DATE_TEXT"),
        format_month(F.col("YEAR"), F.col("MONTH")).alias("MONTH_TEXT"),
    )


@register("month_label")
def q_month_label(spark, sf):
    return fr.monthly(spark, sf).select(
        "YEAR", "MONTH", month_label(F.col("YEAR"), F.col("MONTH")).alias("LABEL")
    )


@register("null_to_zero")
def q_null_to_zero(spark, sf):
    # March without a total, May with NaN
    total = F.when(F.col("MONTH") == 5, F.lit(float("nan"))).when(F.col("MONTH") != 3, F.col("PRECIPITATION_TOTAL"))
    return fr.monthly(spark, sf).select("YEAR", "MONTH", null_to_zero(total).alias("PRECIPITATION_TOTAL"))


@register("round_display")
def q_round_display(spark, sf):
    return fr.daily(spark, sf).select(
        "DATE",
        round_display(F.col("TEMP_AVG"), 1).alias("TEMP_AVG"),
        round_display(F.col("HUMIDITY_AVG"), 1).alias("HUMIDITY_AVG"),
        round_display(F.col("PRECIPITATION_TOTAL"), 0).alias("PRECIPITATION_TOTAL"),
    )


# -------------------------------------------------------------- D: aggregations


@register("daily")
def q_daily(spark, sf):
    return r6(aggregate.daily(fr.cleaned(spark, sf), fr.station_codes(spark, sf)), "TEMP_STD")


@register("monthly")
def q_monthly(spark, sf):
    return aggregate.monthly(fr.cleaned(spark, sf), fr.station_codes(spark, sf))


@register("seasonal")
def q_seasonal(spark, sf):
    return aggregate.seasonal(fr.cleaned(spark, sf), fr.station_codes(spark, sf))


@register("yearly")
def q_yearly(spark, sf):
    return aggregate.yearly(fr.cleaned(spark, sf), fr.station_codes(spark, sf))


@register("monthly_rain")
def q_monthly_rain(spark, sf):
    return dashboard.monthly_rain(fr.daily(spark, sf))


@register("stats_temperature")
def q_stats_temperature(spark, sf):
    return r6(dashboard.stats_temperature(fr.daily(spark, sf)), "temperature_mean")


@register("stats_precipitation")
def q_stats_precipitation(spark, sf):
    return r6(dashboard.stats_precipitation(fr.daily(spark, sf)), "precipitation_mean")


@register("stats_humidity")
def q_stats_humidity(spark, sf):
    return r6(dashboard.stats_humidity(fr.daily(spark, sf)), "humidity_mean")


@register("stats_period")
def q_stats_period(spark, sf):
    return dashboard.stats_period(fr.daily(spark, sf))


@register("statistics")
def q_statistics(spark, sf):
    return r6(
        dashboard.statistics(fr.daily(spark, sf)),
        "temperature_mean",
        "precipitation_mean",
        "humidity_mean",
    )


@register("statistics_cards")
def q_statistics_cards(spark, sf):
    return dashboard.statistics_cards(fr.daily(spark, sf))


@register("histogram")
def q_histogram(spark, sf):
    return r6(dashboard.histogram(fr.daily(spark, sf)), "BIN_START")


@register("dataset_counts")
def q_dataset_counts(spark, sf):
    raw = fr.raw(spark, sf)
    days = fr.cleaned(spark, sf).groupBy("DATE").agg(F.count(F.lit(1)).alias(aggregate.ROWS))
    return aggregate.dataset_counts({"raw": raw}).unionByName(aggregate.level_counts(days))


# ------------------------------------------------------------------ E: windows


@register("temp_ma_7d")
def q_temp_ma_7d(spark, sf):
    out = trend.trends(fr.daily(spark, sf), {"TEMP_MA_7D": ("TEMP_AVG", 7)})
    return r6(out.select("DATE", "TEMP_AVG", "TEMP_MA_7D"), "TEMP_MA_7D")


@register("temp_ma_30d")
def q_temp_ma_30d(spark, sf):
    out = trend.trends(fr.daily(spark, sf), {"TEMP_MA_30D": ("TEMP_AVG", 30)})
    return r6(out.select("DATE", "TEMP_AVG", "TEMP_MA_30D"), "TEMP_MA_30D")


@register("prcp_ma_7d")
def q_prcp_ma_7d(spark, sf):
    out = trend.trends(fr.daily(spark, sf), {"PRCP_MA_7D": ("PRECIPITATION_TOTAL", 7)})
    return r6(out.select("DATE", "PRECIPITATION_TOTAL", "PRCP_MA_7D"), "PRCP_MA_7D")


@register("trends")
def q_trends(spark, sf):
    return r6(
        trend.trends(fr.daily(spark, sf)), "TEMP_STD", "TEMP_MA_7D", "TEMP_MA_30D", "PRCP_MA_7D"
    )


@register("station_trends")
def q_station_trends(spark, sf):
    return r6(
        trend.station_trends(fr.cleaned(spark, sf)), "TAVG", "TEMP_MA_7D", "TEMP_MA_30D", "PRCP_MA_7D"
    )


# ------------------------------------------------------------ F: sort / top-k


@register("daily_query")
def q_daily_query(spark, sf):
    return query.daily_query(daily_r(spark, sf), "1996-01-01", "2000-12-31", 5000)


@register("monthly_query")
def q_monthly_query(spark, sf):
    return query.monthly_query(fr.monthly(spark, sf))


@register("seasonal_query")
def q_seasonal_query(spark, sf):
    return query.seasonal_query(fr.seasonal(spark, sf))


@register("temperature_trend")
def q_temperature_trend(spark, sf):
    return query.temperature_trend(fr.daily(spark, sf))


@register("last_n_days")
def q_last_n_days(spark, sf):
    return query.last_n_days(daily_r(spark, sf), 365)


@register("rain_last_24_months")
def q_rain_last_24_months(spark, sf):
    return query.rain_last_24_months(fr.monthly(spark, sf))


@register("preview_50")
def q_preview_50(spark, sf):
    return query.preview(fr.daily(spark, sf), 50)


@register("monthly_series")
def q_monthly_series(spark, sf):
    return query.monthly_series(fr.monthly(spark, sf))


# ---------------------------------------------------------------- G: reshape


@register("month_year_grid")
def q_month_year_grid(spark, sf):
    return query.month_year_grid(fr.monthly(spark, sf))


@register("seasonal_series")
def q_seasonal_series(spark, sf):
    return query.seasonal_series(fr.seasonal(spark, sf))


@register("distinct_years")
def q_distinct_years(spark, sf):
    return query.distinct_years(fr.monthly(spark, sf))


@register("aggregation_facts")
def q_aggregation_facts(spark, sf):
    return decimals_as_double(ledger.aggregation_facts(fr.enriched(spark, sf)))


# ------------------------------------------------------------------ H: ledger


@register("record_ingestion")
def q_record_ingestion(spark, sf):
    path = unique_scratch(spark, "ingestion-ledger")
    runs = bindings.ledger_runs(spark, sf).withColumn("source_name", F.lit("orders"))
    ledger.append_ingestions(runs, path)
    return decimals_as_double(
        spark.read.parquet(path).select(
            "source_type", "source_name", "status", "records_count", "data_quality_score",
            "ingestion_timestamp",
        )
    )


@register("record_transformation")
def q_record_transformation(spark, sf):
    path = unique_scratch(spark, "transformation-ledger")
    runs = bindings.transformation_runs(spark, sf)
    # a run cannot put out more than went in: such rows would be rejected
    allowed = runs.withColumn("output_records", F.least("output_records", F.greatest("input_records", F.lit(0))))
    ledger.append_transformations(allowed, path)
    return decimals_as_double(
        spark.read.parquet(path).select(
            "transformation_name", "transformation_type", "input_records", "output_records", "records_dropped",
            "processing_time_seconds", "status",
        )
    )


@register("ingestion_stats")
def q_ingestion_stats(spark, sf):
    return ledger.ingestion_stats(bindings.ledger_runs(spark, sf))


@register("ingestion_summary")
def q_ingestion_summary(spark, sf):
    return ledger.ingestion_summary(bindings.ledger_runs(spark, sf))


@register("transformation_performance")
def q_transformation_performance(spark, sf):
    return ledger.transformation_performance(bindings.transformation_runs(spark, sf))


@register("ledger_constraints")
def q_ledger_constraints(spark, sf):
    """Broken rules of all three ledger tables: their number by kind and rules."""
    runs = bindings.ledger_runs(spark, sf)
    ingestions = runs.withColumns(
        {
            "source_type": F.when(F.col("records_count") % 13 == 0, F.lit("FTP")).otherwise(F.col("source_type")),
            "data_quality_score": F.col("data_quality_score") * 1.5 - 10.0,
        }
    )
    facts = ledger.aggregation_facts(fr.enriched(spark, sf))
    facts = facts.withColumn(
        "aggregation_type", F.when(F.col("aggregation_type") != "YEARLY", F.col("aggregation_type")).otherwise("DECADE")
    )
    tables = {"ingestion": ingestions, "transformation": bindings.transformation_runs(spark, sf), "aggregation": facts}
    found = [
        ledger.ledger_constraints(df, kind).groupBy(F.array_join("violations", ",").alias("violations"))
        .agg(F.count(F.lit(1)).alias("n_rows")).withColumn("kind", F.lit(kind))
        for kind, df in tables.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


# ------------------------------------------------------- I: declared analyses


@register("quality_checks")
def q_quality_checks(spark, sf):
    return decimals_as_double(ledger.quality_checks(fr.raw(spark, sf)))


@register("quality_score")
def q_quality_score(spark, sf):
    return decimals_as_double(ledger.quality_score(fr.raw(spark, sf)))


@register("period_window")
def q_period_window(spark, sf):
    return insight.period_window(fr.daily(spark, sf))


@register("overall_mean")
def q_overall_mean(spark, sf):
    return insight.overall_mean(fr.enriched(spark, sf))


@register("trend_slope")
def q_trend_slope(spark, sf):
    return trend.trend_slope(fr.daily(spark, sf))


@register("extreme_months")
def q_extreme_months(spark, sf):
    return insight.extreme_months(fr.monthly(spark, sf))


@register("wettest_season")
def q_wettest_season(spark, sf):
    return insight.wettest_season(fr.seasonal(spark, sf))


@register("hottest_year")
def q_hottest_year(spark, sf):
    return insight.hottest_year(fr.yearly(spark, sf))


@register("station_comparison")
def q_station_comparison(spark, sf):
    return insight.station_comparison(fr.cleaned(spark, sf), codes=fr.station_codes(spark, sf))


@register("station_slopes")
def q_station_slopes(spark, sf):
    return trend.station_slopes(fr.cleaned(spark, sf))


@register("hot_cold_days")
def q_hot_cold_days(spark, sf):
    # the days of each station: single stations reach both limits
    return insight.hot_cold_days(fr.station_day(spark, sf).withColumnRenamed("TAVG", "TEMP_AVG"))


@register("season_profile")
def q_season_profile(spark, sf):
    return insight.season_profile(fr.enriched(spark, sf))


@register("seasonal_anomalies")
def q_seasonal_anomalies(spark, sf):
    return insight.seasonal_anomalies(fr.daily(spark, sf))


# ------------------------------------------------- A: sources and sinks


def _raw_schema():
    from pyspark.sql import types as T

    strings = ["STATION", "STATION_NAME", "DATE"]
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in strings]
        + [T.StructField(c, T.DoubleType()) for c in ["TAVG", "TMAX", "TMIN", "PRCP", "RHUM", "AWND"]]
    )


@register("scan_csv")
def q_scan_csv(spark, sf):
    path = unique_scratch(spark, "csv")
    files.sink_csv(fr.raw(spark, sf), path)
    return files.scan_csv(spark, path, _raw_schema())


@register("sink_csv")
def q_sink_csv(spark, sf):
    from pyspark.sql import types as T

    path = unique_scratch(spark, "export")
    files.export_daily_csv(fr.daily(spark, sf), path)
    schema = T.StructType(
        [T.StructField("Date", T.StringType())]
        + [T.StructField(h, T.DoubleType()) for h in files.EXPORT_HEADER[1:]]
    )
    return files.scan_csv(spark, path, schema)


@register("flatten_payload")
def q_flatten_payload(spark, sf):
    """Whole, ragged and empty documents.

    Odd years have short rain and maximum arrays; every document has an empty twin.
    """
    docs = payload.parse_payloads(payload.build_payloads(fr.station_day(spark, sf)))
    daily = F.col("doc.data.daily")
    odd = F.year(F.to_date(F.get(daily["time"], F.lit(0)))) % 2 == 1

    def short(field: str, n: int):
        return F.when(odd, F.slice(daily[field], 1, n)).otherwise(daily[field])

    ragged = daily.withField("precipitation_sum", short("precipitation_sum", 50))
    ragged = ragged.withField("temperature_2m_max", short("temperature_2m_max", 30))
    empty = daily.withField("time", F.array().cast("array<string>"))
    both = docs.select("doc", F.explode(F.array(ragged, empty)).alias("daily"))
    return payload.flatten_payload(both.select(F.col("doc").withField("data.daily", F.col("daily")).alias("doc")))


@register("land_raw_json")
def q_land_raw_json(spark, sf):
    path = unique_scratch(spark, "raw-json")
    docs = payload.parse_payloads(payload.build_payloads(fr.station_day(spark, sf)))
    files.land_raw_json(docs.select("doc.*"), path)
    return payload.flatten_payload(files.scan_raw_json(spark, path))


@register("enrich_station")
def q_enrich_station(spark, sf):
    locs = fr.raw(spark, sf).select(F.col("STATION_NAME").alias("location_name"))
    return payload.enrich_station(locs)


@register("sink_parquet")
def q_sink_parquet(spark, sf):
    path = unique_scratch(spark, "parquet")
    files.sink_parquet(daily_r(spark, sf), path, ["YEAR", "MONTH"])
    return spark.read.parquet(path)


@register("scan_dataset")
def q_scan_dataset(spark, sf):
    root = unique_scratch(spark, "datasets")
    files.save_all({"monthly": fr.monthly(spark, sf)}, root)
    return files.scan_dataset(spark, root, "monthly")


@register("save_all")
def q_save_all(spark, sf):
    root = unique_scratch(spark, "datasets")
    res = files.save_all(
        {"daily": fr.daily(spark, sf), "monthly": fr.monthly(spark, sf), "seasonal": fr.seasonal(spark, sf)},
        root,
    )
    # sizes and durations vary from run to run; the rest is checked
    return res.select(
        "dataset_name", "record_count", F.array_join("partitioned_by", ",").alias("partitioned_by"),
        "compression", "mode", "error",
    )


def _two_datasets(spark, sf) -> str:
    root = unique_scratch(spark, "datasets")
    files.save_all({"daily": fr.daily(spark, sf), "monthly": fr.monthly(spark, sf)}, root)
    return root


@register("list_datasets")
def q_list_datasets(spark, sf):
    return files.list_datasets(spark, _two_datasets(spark, sf))


@register("datasets_overview")
def q_datasets_overview(spark, sf):
    # sizes and times vary from run to run; that they are there is checked
    found = files.datasets_overview(spark, _two_datasets(spark, sf))
    return found.select(
        "name", (F.col("size_mb") >= 0).alias("has_size"), (F.col("file_count") > 0).alias("has_files"),
        F.col("last_modified").isNotNull().alias("has_time"),
    )


@register("dataset_info")
def q_dataset_info(spark, sf):
    found = files.dataset_info_frame(spark, _two_datasets(spark, sf) + "/daily")
    return found.select(
        "name", (F.col("size_mb") >= 0).alias("has_size"), (F.col("file_count") > 0).alias("has_files"),
        F.col("last_modified").isNotNull().alias("has_time"),
    )


# rows of lineitem that one landed file holds at most, if all of them land side by side
LANDED_ROWS = 2_000_000


def _landed_files(spark, sf) -> int:
    """Files that all raw rows land in: more as the table grows, so that no task takes a fixed share of the rows.

    Rows are counted from the Parquet footers.
    """
    return max(1, -(-bindings.table(spark, sf, "lineitem").count() // LANDED_ROWS))


def _deliveries(count, files_each: int):
    """A count of files in deliveries of so many files; one that is no whole number of deliveries stays as it is."""
    count = F.lit(count) if isinstance(count, int) else F.col(count)
    return F.when(count % files_each == 0, (count / files_each)).otherwise(count).cast("long")


@register("latest_file")
def q_latest_file(spark, sf):
    """The newest landing, all its part files read. It is four deliveries: a delivery is one file, of a large table several."""
    path = unique_scratch(spark, "landing")
    raw, each = fr.raw(spark, sf), _landed_files(spark, sf)
    files.sink_csv(raw.where("STATION = 'ST_0'"), path + "/earlier")
    files.sink_csv(raw.repartition(4 * each), path + "/later")
    newest = files.latest_landing(spark, path).collect()[0]
    rows = files.scan_csv(spark, newest["path"], _raw_schema())
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("RHUM").alias("rhum")).select(
        F.lit(newest["path"].rsplit("/", 1)[-1]).alias("landing"), _deliveries(newest["files"], each).alias("files"), "*"
    )


# --------------------------------------------------- J: re-aimed operators


@register("resumable_ingest")
def q_resumable_ingest(spark, sf):
    landing = unique_scratch(spark, "landing")
    sink = unique_scratch(spark, "ingested")
    files.sink_csv(fr.raw(spark, sf), landing)
    ingest.resumable_ingest(
        spark, landing, sink, unique_scratch(spark, "ckpt"), schema=_raw_schema()
    )
    return ingest.read_sink(spark, sink)


@register("ingest_progress")
def q_ingest_progress(spark, sf):
    landing = unique_scratch(spark, "landing")
    each = _landed_files(spark, sf)  # of each micro-batch
    files.sink_csv(fr.raw(spark, sf).repartition(4 * each), landing)
    progress = ingest.resumable_ingest(
        spark, landing, unique_scratch(spark, "ingested"), unique_scratch(spark, "ckpt"),
        schema=_raw_schema(), max_files_per_trigger=each,
    )
    # per-batch split and rates depend on file layout and timing; totals do not
    return progress.agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("num_input_rows").alias("rows"),
        F.sum("failed_rows").alias("failed_rows"),
        F.max("cumulative_rows").alias("cumulative_rows"),
    )


@register("ingest_share")
def q_ingest_share(spark, sf):
    """Four deliveries are ingested, a fifth has landed since. A delivery is one file, of a large table several."""
    landing, sink = unique_scratch(spark, "landing"), unique_scratch(spark, "ingested")
    raw, each = fr.raw(spark, sf), _landed_files(spark, sf)
    files.sink_csv(raw.repartition(4 * each), landing)
    ingest.resumable_ingest(spark, landing, sink, schema=_raw_schema())
    files.sink_csv(raw.repartition(each), landing, mode="append")
    share = ingest.ingest_share(spark, landing, sink)
    counts = [_deliveries(c, each).alias(c) for c in ("files_landed", "files_done", "files_remaining")]
    # bytes depend on how the rows fell into files
    return share.select(*counts, "files_percent", (F.col("bytes_done") > 0).alias("has_bytes"))


@register("ingest_payloads")
def q_ingest_payloads(spark, sf):
    landing = unique_scratch(spark, "payload-landing")
    docs = payload.parse_payloads(payload.build_payloads(fr.station_day(spark, sf)))
    files.land_raw_json(docs.select("doc.*"), landing)
    sink = unique_scratch(spark, "payload-rows")
    ingest.ingest_payloads(spark, landing, sink, unique_scratch(spark, "ckpt"))
    return ingest.read_sink(spark, sink)


@register("process_all")
def q_process_all(spark, sf):
    """Values of all seven frames of a batch run: rows, temperature and rain sums, first and last day."""
    out = unique_scratch(spark, "batch")
    raw = fr.raw(spark, sf)
    batch.run_batch(spark, raw, out, ledger_root=out + "/_ledger")
    stored = {n: spark.read.parquet(f"{out}/{n}") for n in ("clean", "daily", "monthly", "seasonal", "trends")}
    lazy = batch.process_all(raw)
    frames = {"raw": lazy["raw"], "clean": stored["clean"], "enriched": enrich.enrich(stored["clean"].drop("YEAR")),
              "daily": stored["daily"], "monthly": stored["monthly"], "seasonal": stored["seasonal"], "trends": stored["trends"]}

    def values(name: str, df: DataFrame) -> DataFrame:
        temp = "TAVG" if "TAVG" in df.columns else "TEMP_MA_7D" if "TEMP_MA_7D" in df.columns else "TEMP_AVG"
        rain = "PRCP" if "PRCP" in df.columns else "PRECIPITATION_TOTAL"
        day = (F.col("DATE") if "DATE" in df.columns else F.lit(None)).cast("string")
        extra = F.sum("DAY_OF_WEEK") if "DAY_OF_WEEK" in df.columns else F.lit(None).cast("long")
        return df.agg(
            F.count(F.lit(1)).alias("RECORDS"), F.round(F.sum(temp), 4).alias("TEMP_SUM"), F.round(F.sum(rain), 4).alias("RAIN_SUM"),
            F.min(day).alias("FIRST_DAY"), F.max(day).alias("LAST_DAY"), extra.alias("WEEKDAY_SUM"),
        ).withColumn("DATASET", F.lit(name))

    out_frames = [values(n, df) for n, df in frames.items()]
    found = out_frames[0]
    for df in out_frames[1:]:
        found = found.unionByName(df)
    return found


def queries() -> dict[str, Query]:
    return dict(QUERIES)
