"""Resumable ingestion: a rerun ingests only new files, exactly once."""

import os

import pytest
from pyspark.sql import functions as F

from nimbus.plans import frames as fr
from nimbus.session import unique_scratch
from nimbus.sources import files
from nimbus.streaming import ingest


def _schema():
    from nimbus.plans.catalog import _raw_schema

    return _raw_schema()


def test_rerun_ingests_only_new_files(spark, sf_dir):
    landing = unique_scratch(spark, "landing")
    sink = unique_scratch(spark, "sink")
    ckpt = unique_scratch(spark, "ckpt")
    raw = fr.raw(spark, sf_dir)
    n = raw.count()
    files.sink_csv(raw.repartition(3), landing + "/batch1")

    p1 = ingest.resumable_ingest(spark, landing + "/*", sink, ckpt, schema=_schema())
    assert spark.read.parquet(sink).count() == n
    assert p1.agg(F.sum("num_input_rows")).first()[0] == n

    p2 = ingest.resumable_ingest(spark, landing + "/*", sink, ckpt, schema=_schema())
    assert spark.read.parquet(sink).count() == n
    assert (p2.agg(F.sum("num_input_rows")).first()[0] or 0) == 0

    extra = raw.limit(10)
    files.sink_csv(extra.coalesce(1), landing + "/batch2")
    ingest.resumable_ingest(spark, landing + "/*", sink, ckpt, schema=_schema())
    assert spark.read.parquet(sink).count() == n + 10


def test_progress_reports_failed_rows(spark, sf_dir):
    landing = unique_scratch(spark, "landing")
    raw = fr.raw(spark, sf_dir)
    files.sink_csv(raw.repartition(2), landing)
    prog = ingest.resumable_ingest(
        spark, landing, unique_scratch(spark, "sink"), unique_scratch(spark, "ckpt"),
        schema=_schema(), max_files_per_trigger=1,
    )
    assert prog.count() == 2
    failed = prog.agg(F.sum("failed_rows")).first()[0]
    expect = raw.filter(F.col("DATE").isNull() | F.try_to_date("DATE").isNull()).count()
    assert failed == expect
    assert prog.agg(F.max("cumulative_rows")).first()[0] == raw.count()


def write(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


HEADER = "DATE,STATION,TAVG"


def test_every_batch_has_its_progress(spark, tmp_path):
    landing, sink = str(tmp_path / "landing"), str(tmp_path / "sink")
    for i in range(8):
        write(landing, f"{i}.csv", HEADER, f"2020-01-0{i + 1},S,1.5")
    progress = ingest.resumable_ingest(spark, landing, sink, max_files_per_trigger=1)
    assert [r.cumulative_rows for r in progress.orderBy("batch_id").collect()] == list(range(1, 9))
    # totals go on in the next run
    write(landing, "later.csv", HEADER, "bad,S,1.5", "2020-02-01,S,2")
    again = ingest.resumable_ingest(spark, landing, sink)
    assert [r.cumulative_rows for r in again.collect()] == [10]
    totals = ingest.ingest_totals(ingest.ingest_history(spark, sink)).collect()[0]
    assert (totals.batches, totals.rows, totals.failed_rows, totals.valid_percent) == (9, 10, 1, 90.0)
    assert sorted(ingest.read_sink(spark, sink).columns) == sorted(ingest.OBSERVATION.names)


@pytest.mark.parametrize("died", ["before the rows", "between rows and progress", "before the commit"])
def test_a_run_that_died_is_repeated_whole(spark, tmp_path, monkeypatch, died):
    """Rows and progress are written by batch number before the commit: nothing is lost or counted twice."""
    landing, sink = str(tmp_path / "landing"), str(tmp_path / "sink")
    write(landing, "a.csv", HEADER, "2020-01-01,S,1.5", "2020-01-02,S,1.5")
    ingest.resumable_ingest(spark, landing, sink)
    write(landing, "b.csv", HEADER, "2020-01-03,S,1.5", "bad,S,2", "2020-01-05,S,1.5")
    place = {"before the rows": "land_batch", "between rows and progress": "record_progress", "before the commit": "record_progress"}[died]
    whole = getattr(ingest, place)

    def dying(*args):
        if died == "before the commit":
            whole(*args)
        raise SystemError("the driver died here")

    with monkeypatch.context() as patched:
        patched.setattr(ingest, place, dying)
        with pytest.raises(Exception, match="died here"):
            ingest.resumable_ingest(spark, landing, sink)
    write(landing, "c.csv", HEADER, "2020-01-06,S,1.5")
    ingest.resumable_ingest(spark, landing, sink, max_files_per_trigger=1)
    assert spark.read.parquet(sink).count() == ingest.read_sink(spark, sink).count() == 6
    history = ingest.ingest_history(spark, sink).orderBy("batch_id").collect()
    assert [(r.batch_id, r.num_input_rows, r.failed_rows, r.cumulative_rows) for r in history] == [(0, 2, 0, 2), (1, 3, 1, 5), (2, 1, 0, 6)]


def test_an_empty_landing_has_no_progress(spark, tmp_path):
    landing, sink = tmp_path / "landing", str(tmp_path / "sink")
    landing.mkdir()
    for where in (str(landing), str(landing / "*")):
        assert ingest.resumable_ingest(spark, where, sink).count() == 0
    assert ingest.ingest_payloads(spark, str(landing), sink).count() == 0
    assert ingest.ingest_totals(ingest.ingest_history(spark, sink)).collect()[0].rows == 0
    assert ingest.read_sink(spark, sink, ingest.OBSERVATION).count() == 0
    share = ingest.ingest_share(spark, str(landing), sink).collect()[0]
    assert (share.files_landed, share.files_done, share.files_percent) == (0, 0, 100.0)


def test_the_share_of_landed_files(spark, tmp_path):
    landing, sink = str(tmp_path / "landing"), str(tmp_path / "sink")
    for i in range(3):
        write(landing, f"{i}.csv", HEADER, f"2020-01-0{i + 1},S,1.5")
    assert ingest.ingest_share(spark, landing, sink).collect()[0].files_done == 0
    ingest.resumable_ingest(spark, landing, sink)
    write(landing, "3.csv", HEADER, "2020-01-09,S,1.5", "2020-01-10,S,1.5")
    share = ingest.ingest_share(spark, landing, sink).collect()[0]
    assert (share.files_landed, share.files_done, share.files_remaining, share.files_percent) == (4, 3, 1, 75.0)
    assert share.bytes_landed > share.bytes_done > 0 and share.bytes_percent == round(100 * share.bytes_done / share.bytes_landed, 2)
    ingest.resumable_ingest(spark, landing, sink)
    assert ingest.ingest_share(spark, landing, sink).collect()[0].files_percent == 100.0


def test_a_new_checkpoint_on_a_used_sink_raises(spark, tmp_path):
    landing, sink = str(tmp_path / "landing"), str(tmp_path / "sink")
    write(landing, "a.csv", HEADER, "2020-01-01,S,1.5")
    ingest.resumable_ingest(spark, landing, sink)
    write(landing, "b.csv", HEADER, "2020-01-02,S,1.5")
    with pytest.raises(ValueError, match="does not know"):
        ingest.resumable_ingest(spark, landing, sink, str(tmp_path / "new"))
    ingest.resumable_ingest(spark, landing, sink)
    assert spark.read.parquet(sink).count() == 2


def test_two_landings_keep_apart(spark, tmp_path):
    for name in ("x", "y"):
        write(str(tmp_path / name), "a.csv", "TAVG,DATE,STATION", f"1.5,2020-01-01,{name}")
        ingest.resumable_ingest(spark, str(tmp_path / name), str(tmp_path / f"sink_{name}"))
        row = spark.read.parquet(str(tmp_path / f"sink_{name}")).collect()[0]
        assert (row.STATION, row.DATE, row.TAVG) == (name, "2020-01-01", 1.5)  # by name, not by place


def test_a_file_with_another_header_raises(spark, tmp_path):
    landing = str(tmp_path / "landing")
    write(landing, "a.csv", HEADER, "2020-01-01,S,1.5")
    write(landing, "b.csv", "STATION,DATE,TAVG", "S,2020-01-01,1.5")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        ingest.resumable_ingest(spark, landing, str(tmp_path / "sink"))


def test_payload_progress_counts_rows(spark, sf_dir):
    from nimbus.sources import payload

    landing, sink = unique_scratch(spark, "landing"), unique_scratch(spark, "sink")
    docs = payload.parse_payloads(payload.build_payloads(fr.station_day(spark, sf_dir)))
    files.land_raw_json(docs.select("doc.*"), landing)
    progress = ingest.ingest_payloads(spark, landing, sink)
    assert progress.agg(F.sum("num_input_rows")).collect()[0][0] == spark.read.parquet(sink).count()
