"""Physical-plan checks: pushdown, pruning, top-k, no single-task windows,
no cartesian products."""

import os

from pyspark.sql import functions as F

from nimbus.operators import aggregate, clean, dashboard, insight, ledger, query, rank, spans, trend
from nimbus.plans import catalog
from nimbus.plans import frames as fr
from nimbus.session import cut_lineage, unique_scratch
from nimbus.sources import files


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def windows_fed_by_single_partition(text: str) -> list[str]:
    """Window operators whose input exchange is SinglePartition."""
    lines = text.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Window [" not in line:
            continue
        for nxt in lines[i + 1:]:
            if "Exchange" in nxt:
                if "SinglePartition" in nxt:
                    bad.append(line.strip()[:80])
                break
    return bad


def test_filters_reach_parquet_scan(spark, sf_dir):
    path = unique_scratch(spark, "obs")
    fr.raw(spark, sf_dir).write.parquet(path)
    cleaned = clean.clean(spark.read.parquet(path)).select("DATE", "TAVG")
    text = formatted(cleaned)
    assert "GreaterThanOrEqual(PRCP,0.0)" in text
    assert "LessThanOrEqual(TAVG,60.0)" in text
    assert "ReadSchema: struct<STATION:string" in text


def test_date_range_prunes_partitions(spark, sf_dir):
    path = unique_scratch(spark, "daily")
    fr.daily(spark, sf_dir).write.partitionBy("YEAR", "MONTH").parquet(path)
    stored = spark.read.parquet(path)
    q = clean.date_range(stored, "1997-01-01", "1997-12-31").select("DATE", "TEMP_AVG")
    text = formatted(q)
    assert "PartitionFilters: [isnotnull(YEAR" in text
    assert "ReadSchema: struct<DATE:date,TEMP_AVG:double>" in text
    assert q.count() > 0


def test_top_k_is_take_ordered(spark, sf_dir):
    q = query.daily_query(fr.daily(spark, sf_dir), limit=100)
    assert "TakeOrderedAndProject" in plan(q)


def test_windows_are_partitioned(spark, sf_dir):
    for df in (
        trend.trends(fr.daily(spark, sf_dir)),
        trend.station_trends(fr.cleaned(spark, sf_dir)),
        insight.station_comparison(fr.enriched(spark, sf_dir)),
    ):
        df.count()
        assert windows_fed_by_single_partition(plan(df)) == []


def test_histogram_and_periods_have_no_cartesian_product(spark, sf_dir):
    for df in (dashboard.histogram(fr.daily(spark, sf_dir)), insight.period_window(fr.daily(spark, sf_dir))):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_aggregates_are_partial_before_exchange(spark, sf_dir):
    text = plan(fr.monthly(spark, sf_dir))
    assert "partial_sum" in text and "partial_count" in text


def test_levels_and_comparison_fold_rows_by_hash(spark, sf_dir):
    """No sort-based aggregate below the first exchange on the date (or station): rows are folded by hash."""
    rows, codes = fr.cleaned(spark, sf_dir), fr.station_codes(spark, sf_dir)
    for level in ("daily", "monthly", "seasonal", "yearly"):
        text = plan(getattr(aggregate, level)(rows, codes))
        folds = [line for line in text.splitlines() if "keys=[DATE" in line]
        assert folds and all("HashAggregate" in line for line in folds), level
        # what is sorted at most is days
        assert "SortAggregate" not in text[text.index("keys=[DATE"):], level
    stations = aggregate.encoded(rows.select("STATION", "STATION_NAME", "TAVG", "PRCP"), codes, ("STATION_NAME",))
    assert "SortAggregate" not in plan(stations.groupBy("STATION").agg(F.min("STATION_NAME"), F.avg("TAVG")))
    # the dictionary is small and stored: its measured size lets Spark broadcast it
    assert "BroadcastHashJoin" in plan(aggregate.daily(rows, codes))


def test_the_batch_reads_the_clean_table_once(spark, sf_dir):
    """All levels and the facts come from stored day states; none of their plans reaches the clean table."""
    path = unique_scratch(spark, "clean")
    fr.cleaned(spark, sf_dir).write.parquet(path)
    stored = spark.read.parquet(path)
    states = cut_lineage(aggregate.day_states(stored, aggregate.station_codes(stored)))
    for df in (aggregate.daily(states), aggregate.monthly(states), aggregate.seasonal(states), aggregate.yearly(states), ledger.aggregation_facts(states)):
        text = formatted(df)
        assert path not in text and text.count("Scan parquet") <= 2


def test_histogram_has_one_scan(spark, sf_dir):
    text = plan(dashboard.histogram(fr.daily(spark, sf_dir)))
    assert text.count("FileScan") == 1 and "subquery" not in text.lower() and "rangepartitioning" not in text


def test_moving_averages_have_one_exchange_a_branch(spark, sf_dir):
    text = plan(trend.trends(fr.daily(spark, sf_dir)))
    assert text.count("FileScan") == 2 and text.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in text


def test_spans_follow_the_number_of_values(spark):
    few, many = (spark.range(n).select(F.col("id").cast("double").alias("x")) for n in (1000, 9000))
    assert [len(spans.spanned(df, [F.col("x")], 500)[1]) for df in (few, many)] == [2, 18]
    ranked = rank.rank_desc(many, "x", "R", span_values=500)
    assert "BroadcastNestedLoopJoin" not in plan(ranked)
    assert ranked.where("R <> 9000 - x").count() == 0


def test_no_round_robin_in_any_query_plan(spark, sf_dir):
    from nimbus.plans import catalog

    for name in ("clean", "daily", "monthly", "histogram", "statistics", "trend_slope", "quality_checks", "ingestion_summary"):
        assert "RoundRobin" not in plan(catalog.QUERIES[name](spark, sf_dir)), name


def test_aggregation_facts_fan_out_days_not_rows(spark, sf_dir):
    text = plan(ledger.aggregation_facts(fr.enriched(spark, sf_dir)))
    # both generators stand above the aggregate by day
    assert text.count("Generate") >= 2
    assert text.rindex("Generate explode(array(struct(t") < text.index("keys=[DATE")


def _landings(spark, monkeypatch, rows: int) -> list[list[int]]:
    """From now on: rows of each file of every landing that a query writes, with files of at most so many rows of lineitem."""
    written, whole = [], files.sink_csv

    def sink(df, path, mode="overwrite"):
        whole(df, path, mode)
        landed = spark.read.option("header", True).csv(path).groupBy(F.input_file_name()).count().collect()
        written.append([r["count"] for r in landed])

    monkeypatch.setattr(catalog, "LANDED_ROWS", rows, raising=False)
    monkeypatch.setattr(files, "sink_csv", sink)
    return written


def test_ingest_share_lands_a_larger_table_in_more_files(spark, sf_dir, monkeypatch):
    rows = fr.raw(spark, sf_dir).count()
    written = _landings(spark, monkeypatch, 1000)
    share = catalog.QUERIES["ingest_share"](spark, sf_dir).collect()
    assert [tuple(r) for r in share] == [(5, 4, 1, 80.0, True)]
    assert [sum(w) for w in written] == [rows, 2 * rows]
    assert all(max(w) < 1.5 * 1000 for w in written)  # some orders land twice


def test_deliveries_are_whole_or_the_files_are_shown(spark):
    one = spark.range(1)
    assert one.select(*[catalog._deliveries(n, 6).alias(f"n{n}") for n in (0, 6, 24, 23, 25)]).first() == (0, 1, 4, 23, 25)
    assert one.withColumn("n", F.lit(5)).select(catalog._deliveries("n", 1)).first()[0] == 5


def test_ingest_progress_lands_a_larger_table_in_more_files(spark, sf_dir, monkeypatch):
    rows = fr.raw(spark, sf_dir).count()
    written = _landings(spark, monkeypatch, 1000)
    progress = catalog.QUERIES["ingest_progress"](spark, sf_dir).first()
    assert (progress.batches, progress.rows, progress.cumulative_rows) == (4, rows, rows)
    assert sum(written[0]) == rows and max(written[0]) < 1000 / 2


def test_latest_file_lands_a_larger_table_in_more_files(spark, sf_dir, monkeypatch):
    rows = fr.raw(spark, sf_dir).count()
    written = _landings(spark, monkeypatch, 1000)
    latest = catalog.QUERIES["latest_file"](spark, sf_dir).first()
    assert (latest.landing, latest["files"], latest.n_rows) == ("later", 4, rows)
    assert sum(written[1]) == rows and max(written[1]) < 1000 / 2
