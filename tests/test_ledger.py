"""Ledger appends and constraint checks."""

import statistics

import pytest
from pyspark.sql import functions as F

from nimbus.operators import ledger
from nimbus.session import unique_scratch


def test_record_and_summaries(spark):
    path = unique_scratch(spark, "ledger")
    ledger.record_ingestion(spark, path, "API", "weather", 10, 9, 1, quality_score=90.0)
    ledger.record_ingestion(spark, path, "API", "weather", 5, 5, 0, status="FAILED", quality_score=100.0)
    ledger.record_ingestion(spark, path, "CSV", "file", 3, 3, 0, quality_score=50.0)
    df = spark.read.parquet(path)
    s = {r.source_type: r for r in ledger.ingestion_summary(df).collect()}
    assert s["API"].total_ingestions == 2 and s["API"].total_records == 15
    assert s["API"].failed_ingestions == 1 and s["API"].successful_ingestions == 1
    assert float(s["API"].avg_quality_score) == 95.0


def test_constraints_reject_bad_rows(spark):
    path = unique_scratch(spark, "ledger")
    with pytest.raises(ValueError):
        ledger.record_ingestion(spark, path, "FTP", "x")
    with pytest.raises(ValueError):
        ledger.record_ingestion(spark, path, "API", "x", quality_score=120.0)
    with pytest.raises(ValueError):
        ledger.record_transformation(spark, path + "_t", "agg", 5, 10)
    row = ledger.record_transformation(spark, path + "_t", "agg", 10, 4).first()
    assert row.records_dropped == 6


def test_a_retried_run_leaves_one_row_each(spark):
    path = unique_scratch(spark, "ledger")
    for rows in (10, 12):
        ledger.record_ingestion(spark, path, "API", "weather", rows, ingestion_id="run-1")
    ledger.record_ingestion(spark, path, "API", "weather", 5, ingestion_id="run-2")
    got = {r.ingestion_id: r.records_count for r in spark.read.parquet(path).collect()}
    assert got == {"run-1": 12, "run-2": 5} and spark.read.parquet(path).count() == 2
    steps = path + "_t"
    for out in (4, 5):
        made = [ledger.transformation_row(n, 10, out, ingestion_id="run-1") for n in ("daily", "monthly")]
        ledger.record_transformations(spark, steps, made)
    ledger.record_transformation(spark, steps, "daily", 10, 4)
    rows = spark.read.parquet(steps).collect()
    assert sorted((r.transformation_name, r.output_records) for r in rows) == [("daily", 4), ("daily", 5), ("monthly", 5)]
    facts = path + "_f"
    for n in (3, 2):
        ledger.put_run(spark.range(n).withColumn("x", F.lit(n)), facts, "run-1")
    ledger.put_run(spark.range(1).withColumn("x", F.lit(9)), facts, "run-2")
    assert sorted(r.x for r in spark.read.parquet(facts).collect()) == [2, 2, 9]
    twice = spark.createDataFrame([("a",), ("a",)], "ingestion_id string").selectExpr("ingestion_id", "'API' source_type", "'SUCCESS' status")
    with pytest.raises(ValueError, match="share an id"):
        ledger.append_ingestions(twice, path)


def test_spreads_of_values_far_from_zero(spark):
    """Values 1e8 apart from a spread of 1: squares of sums would lose it."""
    days = [(f"2020-{m:02d}-{d:02d}", "S", "s", 1e8 + (m * 7 + d * 3 + k) % 5 * 0.5) for m in (1, 2, 3) for d in range(1, 28) for k in range(3)]
    rows = spark.createDataFrame(days, "DATE string, STATION string, STATION_NAME string, TAVG double").withColumn("DATE", F.to_date("DATE"))
    facts = {(r.aggregation_type, r.period_key): float(r.value_std) for r in ledger.aggregation_facts(rows).collect()}
    for kind, key, prefix in (("YEARLY", "2020", "2020"), ("MONTHLY", "2020-02", "2020-02"), ("DAILY", "2020-01-05", "2020-01-05")):
        values = [v for d, _, _, v in days if d.startswith(prefix)]
        assert facts[(kind, key)] == pytest.approx(statistics.stdev(values), abs=0.0051)
        assert facts[(kind, key)] > 0.4


def test_checks_observed_on_the_cleaning_pass(spark, sf_dir):
    from pyspark.sql.observation import Observation

    from nimbus.operators import clean
    from nimbus.plans import frames as fr
    from nimbus.schema import DEFAULT_RULES
    from nimbus.sources import files

    raw, seen = fr.raw(spark, sf_dir), Observation("checks")
    cleaned = clean.clean_counted(raw, DEFAULT_RULES, seen, ledger.check_counts(raw))
    assert cleaned.exceptAll(clean.clean(raw)).count() == 0 and cleaned.count() == clean.clean(raw).count()
    got = ledger.observed_checks(spark, files.observed_all(seen), raw.columns).collect()
    assert got == ledger.quality_checks(raw).collect()


def test_facts_are_linked_to_their_steps(spark, sf_dir):
    from nimbus.plans import batch
    from nimbus.plans import frames as fr

    out = unique_scratch(spark, "batch")
    for _ in range(2):  # a retry of the run
        batch.run_batch(spark, fr.raw(spark, sf_dir), out, out + "/_ledger", ingestion_id="run-7")
    steps = {r.transformation_id: r.transformation_name for r in spark.read.parquet(out + "/_ledger/spark_transformations").collect()}
    assert sorted(steps.values()) == ["clean", "daily", "monthly", "seasonal", "trends"]
    facts = spark.read.parquet(out + "/_ledger/aggregation_facts")
    assert facts.count() == ledger.aggregation_facts(fr.enriched(spark, sf_dir)).count()
    assert {(r.aggregation_type, steps[r.transformation_id]) for r in facts.select("aggregation_type", "transformation_id").distinct().collect()} == set(ledger.FACT_STEPS.items())
    assert spark.read.parquet(out + "/_ledger/data_quality_checks").count() == 7


def test_quality_checks_shape(spark, sf_dir):
    from nimbus.plans import frames as fr

    q = ledger.quality_checks(fr.raw(spark, sf_dir)).collect()
    names = [r.check_name for r in q]
    assert names[0] == "duplicate_rows" and len(names) == 7
    assert all(r.total_records == q[0].total_records for r in q)
