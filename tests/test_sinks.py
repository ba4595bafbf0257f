"""Parquet/CSV sinks, dataset listing and the batch run."""

import os

import pytest
from pyspark.sql import functions as F

from nimbus.plans import batch
from nimbus.plans import frames as fr
from nimbus.session import unique_scratch
from nimbus.sources import files


def test_sink_parquet_append_and_overwrite(spark, sf_dir):
    path = unique_scratch(spark, "ds")
    m = fr.monthly(spark, sf_dir)
    n = m.count()
    meta = files.sink_parquet(m, path, ["YEAR"], mode="overwrite")
    assert meta["record_count"] == n and meta["partitioned_by"] == ["YEAR"]
    files.sink_parquet(m, path, ["YEAR"], mode="append")
    assert spark.read.parquet(path).count() == 2 * n
    later = m.filter(F.col("YEAR") == 1996)
    # only the partitions written are replaced
    files.sink_parquet(later, path, ["YEAR"], mode="replace_partitions")
    assert spark.read.parquet(path).count() == 2 * n - later.count()
    # the whole dataset is replaced, and no session setting is left behind
    files.sink_parquet(later, path, ["YEAR"], mode="overwrite")
    assert spark.read.parquet(path).count() == later.count()
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "STATIC"


def test_save_all_isolates_failures(spark, sf_dir):
    root = unique_scratch(spark, "root")
    bad = fr.monthly(spark, sf_dir).withColumn("boom", F.raise_error(F.lit("no" * 600)))
    res = files.save_all({"monthly": fr.monthly(spark, sf_dir), "broken": bad}, root).collect()
    by = {r.dataset_name: r for r in res}
    assert by["monthly"].error is None and by["monthly"].record_count > 0
    assert "no" * 600 in by["broken"].error  # the whole text
    names = {r.name for r in files.list_datasets(spark, root).collect()}
    assert "monthly" in names


def test_a_failed_replacement_leaves_the_old_dataset(spark, sf_dir):
    root = unique_scratch(spark, "root")
    m = fr.monthly(spark, sf_dir)
    path, n = os.path.join(root, "monthly"), m.count()
    files.sink_parquet(m, path)
    bad = m.withColumn("TEMP_AVG", F.when(F.col("YEAR") == 1996, F.raise_error(F.lit("no"))).otherwise(F.col("TEMP_AVG")))
    for _ in range(2):
        with pytest.raises(Exception, match="no"):
            files.sink_parquet(bad, path)
        assert spark.read.parquet(path).count() == files.scan_dataset(spark, root, "monthly").count() == n
    assert sorted(os.listdir(root)) == ["monthly"]  # nothing is left of the staged folders
    # even one that reads what it replaces
    files.sink_parquet(spark.read.parquet(path).limit(3), path)
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("died", ["after the commit", "after the old rows went"])
def test_a_crash_after_the_commit_leaves_the_new_dataset(spark, sf_dir, monkeypatch, died):
    root = unique_scratch(spark, "root")
    m = fr.monthly(spark, sf_dir)
    path = os.path.join(root, "monthly")
    files.sink_parquet(m, path)
    with monkeypatch.context() as patched:
        calls = []
        patched.setattr(files, "settle", lambda spark, path, whole=files.settle: whole(spark, path) if not calls.append(1) and len(calls) == 1 else None)
        files.sink_parquet(m.limit(2), path)
    if died == "after the old rows went":
        fs, place = files._at(spark, path)
        fs.delete(place, True)
    assert files.scan_dataset(spark, root, "monthly").count() == 2
    assert {r.name for r in files.list_datasets(spark, root).collect()} <= {"monthly"}
    files.sink_parquet(m.limit(1), path, mode="append")  # finishes the move first
    assert spark.read.parquet(path).count() == 3 and sorted(os.listdir(root)) == ["monthly"]


def test_dataset_info_and_latest(spark, sf_dir):
    root = unique_scratch(spark, "root")
    files.save_all({"daily": fr.daily(spark, sf_dir)}, root)
    info = files.dataset_info(spark, os.path.join(root, "daily"))
    assert info["file_count"] > 0 and info["size_mb"] >= 0
    assert files.dataset_info(spark, os.path.join(root, "absent"))["file_count"] == 0
    assert files.scan_dataset(spark, root, "absent") is None
    folder = unique_scratch(spark, "csv")
    files.sink_csv(fr.raw(spark, sf_dir).repartition(2), folder)
    latest = files.latest_file(spark, folder).first()
    assert latest.path.endswith(".csv")


def test_export_csv_header(spark, sf_dir):
    path = unique_scratch(spark, "export")
    files.export_daily_csv(fr.daily(spark, sf_dir), path)
    header = spark.read.text(path).first()[0]
    assert header == ",".join(files.EXPORT_HEADER)


def test_run_batch_writes_and_records(spark, sf_dir):
    out = unique_scratch(spark, "batch")
    res = {r.dataset_name: r for r in batch.run_batch(spark, fr.raw(spark, sf_dir), out, out + "/_ledger").collect()}
    assert set(res) == {"daily", "monthly", "seasonal", "trends"}
    assert res["daily"].record_count == fr.daily(spark, sf_dir).count()
    led = spark.read.parquet(out + "/_ledger/spark_transformations")
    assert led.count() == 5
    assert led.filter(F.col("output_records") > F.col("input_records")).count() == 0
    frames = batch.process_all(fr.raw(spark, sf_dir))
    assert list(frames) == ["raw", "clean", "enriched", "daily", "monthly", "seasonal", "trends"]


def test_process_latest_uses_newest_csv(spark, sf_dir):
    import time as _t

    from nimbus.plans.catalog import _raw_schema

    landing = unique_scratch(spark, "landing")
    raw = fr.raw(spark, sf_dir)
    files.sink_csv(raw.limit(100).coalesce(1), landing + "/old")
    _t.sleep(1.1)
    files.sink_csv(raw.coalesce(1), landing + "/new")
    out = unique_scratch(spark, "out")
    res = {r.dataset_name: r for r in batch.process_latest(spark, landing, out, schema=_raw_schema()).collect()}
    assert res["daily"].record_count == fr.daily(spark, sf_dir).count()


def test_datasets_overview(spark, sf_dir):
    root = unique_scratch(spark, "root")
    files.save_all({"daily": fr.daily(spark, sf_dir), "seasonal": fr.seasonal(spark, sf_dir)}, root)
    rows = {r.name: r for r in files.datasets_overview(spark, root).collect()}
    assert set(rows) == {"daily", "seasonal"}
    assert rows["daily"].file_count >= 1 and rows["daily"].size_mb >= 0
    one = files.dataset_info(spark, os.path.join(root, "daily"))
    assert one["file_count"] == rows["daily"].file_count


def test_scan_csv_applies_types_by_name(spark):
    path = unique_scratch(spark, "csv")
    df = spark.createDataFrame(
        [("2020-01-01", "S1", "3.5", "x"), ("bad", "S2", "oops", "y")],
        "DATE string, STATION string, TAVG string, EXTRA string",
    )
    files.sink_csv(df.coalesce(1), path)
    got = files.scan_csv(spark, path).orderBy("STATION").collect()
    assert got[0].TAVG == 3.5 and got[1].TAVG is None and got[0].EXTRA == "x"
    assert files.scan_csv(spark, path).columns == ["DATE", "STATION", "TAVG", "EXTRA"]


def test_cli_query(spark, capsys):
    from nimbus.__main__ import main

    assert main(["query", "statistics_cards", "--sf", "/root/testdata/sf0.001", "--rows", "1"]) == 0
    assert "avg_temp" in capsys.readouterr().out


TABLES = ("clean", "daily", "monthly", "seasonal", "trends")


def stored(spark, root):
    return {t: sorted(map(str, spark.read.parquet(f"{root}/{t}").select(*sorted(spark.read.parquet(f"{root}/{t}").columns)).collect())) for t in TABLES}


def test_batch_over_less_data_equals_a_fresh_run(spark, sf_dir):
    again, fresh = unique_scratch(spark, "batch"), unique_scratch(spark, "batch")
    raw = fr.raw(spark, sf_dir)
    less = raw.filter("DATE LIKE '1996-02-1%'")
    batch.run_batch(spark, raw, again)
    batch.run_batch(spark, less, again)
    batch.run_batch(spark, less, fresh)
    assert stored(spark, again) == stored(spark, fresh)


def test_batch_over_nothing(spark, sf_dir):
    root = unique_scratch(spark, "batch")
    res = batch.run_batch(spark, fr.raw(spark, sf_dir).limit(0), root, root + "/_ledger").collect()
    assert {r.dataset_name: (r.record_count, r.error) for r in res} == {n: (0, None) for n in TABLES[1:]}
    empty = files.scan_dataset(spark, root, "daily", fr.daily(spark, sf_dir).schema)
    assert empty.count() == 0


def test_failed_daily_stops_only_trends(spark, sf_dir, monkeypatch):
    from nimbus.operators import aggregate

    whole = aggregate.daily
    monkeypatch.setattr(aggregate, "daily", lambda rows: whole(rows).withColumn("boom", F.raise_error(F.lit("no"))))
    root = unique_scratch(spark, "batch")
    res = {r.dataset_name: r.error for r in batch.run_batch(spark, fr.raw(spark, sf_dir), root, root + "/_ledger").collect()}
    assert res["daily"] and "daily was not stored" in res["trends"] and not res["monthly"] and not res["seasonal"]
    steps = {r.transformation_name: r for r in spark.read.parquet(root + "/_ledger/spark_transformations").collect()}
    assert steps["daily"].status == "FAILED" and steps["daily"].error_message and steps["monthly"].status == "SUCCESS"
    assert all(r.completed_at >= r.started_at for r in steps.values())


def test_process_all_is_lazy(spark, sf_dir):
    raw = fr.raw(spark, sf_dir)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    frames = batch.process_all(raw)
    assert list(tracker.getJobIdsForGroup("lazy")) == []
    spark.sparkContext.setJobGroup("other", "other")
    assert len(frames) == 7


def test_whole_run_fills_the_ledger(spark, sf_dir):
    root = unique_scratch(spark, "run")
    files.sink_csv(fr.raw(spark, sf_dir).repartition(4), root + "/landing")
    batch.ingest_and_batch(spark, root + "/landing", root + "/sink", root + "/out", root + "/ledger")
    run = spark.read.parquet(root + "/ledger/ingestion_metadata").collect()
    assert len(run) == 1 and run[0].records_count == fr.raw(spark, sf_dir).count() and run[0].status == "PARTIAL"
    for table in batch.LEDGER_TABLES:
        ids = {r.ingestion_id for r in spark.read.parquet(f"{root}/ledger/{table}").select("ingestion_id").distinct().collect()}
        assert ids == {run[0].ingestion_id}


def test_newest_landing_is_read_whole(spark, sf_dir):
    folder, out = unique_scratch(spark, "landing"), unique_scratch(spark, "batch")
    raw = fr.raw(spark, sf_dir)
    files.sink_csv(raw.limit(3), folder + "/first")
    files.sink_csv(raw.repartition(4), folder + "/second")
    from nimbus.plans.catalog import _raw_schema

    batch.process_latest(spark, folder, out, schema=_raw_schema())
    assert spark.read.parquet(out + "/clean").count() == fr.cleaned(spark, sf_dir).count()


def write(path, name, *lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_csv_columns_go_by_name(spark, tmp_path):
    import pytest

    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    write(one, "a.csv", "DATE,STATION,TAVG", "2020-01-01,S1,3.5")
    row = files.scan_csv(spark, one).collect()[0]
    assert (row.DATE, row.STATION, row.TAVG) == ("2020-01-01", "S1", 3.5)
    write(two, "a.csv", "DATE,STATION,TAVG", "2020-01-01,S1,3.5")
    write(two, "b.csv", "STATION,DATE,TAVG", "S2,2020-01-02,4.5")
    with pytest.raises(Exception, match="header"):
        files.scan_csv(spark, two).collect()
