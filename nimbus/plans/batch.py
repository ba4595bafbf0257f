"""The three-phase batch run: clean -> aggregate -> store, with a run ledger.

The cleaned rows are written once as a Parquet table in the output folder
(shared storage), which cuts the lineage: a lost executor costs a re-read, not a
recomputation from the raw files. One pass over that table folds it to mergeable
day states, and all aggregates and the aggregation facts are rolled up from the
days. Row counts and the quality checks are metrics observed on the cleaning pass.
"""

from __future__ import annotations

import os
import time
import uuid
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from nimbus.operators import aggregate, clean, enrich, ledger, trend
from nimbus.schema import DEFAULT_RULES, ValidationRules
from nimbus.session import cut_lineage
from nimbus.sources import files


def process_all(raw: DataFrame, rules: ValidationRules = DEFAULT_RULES) -> dict[str, DataFrame]:
    """The seven named frames, lazily (nothing runs until an action)."""
    cleaned = clean.clean(raw, rules)
    enriched = enrich.enrich(cleaned)
    daily = aggregate.daily(enriched)
    return {
        "raw": raw,
        "clean": cleaned,
        "enriched": enriched,
        "daily": daily,
        "monthly": aggregate.monthly(enriched),
        "seasonal": aggregate.seasonal(enriched),
        "trends": trend.trends(daily, lazy=True),
    }


LEDGER_TABLES = ("spark_transformations", "aggregation_facts", "data_quality_checks")


def run_batch(
    spark: SparkSession,
    raw: DataFrame,
    out_root: str,
    ledger_root: str | None = None,
    rules: ValidationRules = DEFAULT_RULES,
    ingestion_id: str | None = None,
) -> DataFrame:
    """Clean, aggregate and store daily, monthly, seasonal and trends.

    Returns the save results (one row per aggregate; a failed one has its
    error text and stops no other). With ``ledger_root``, every step is
    appended to the ledger, failed ones included, and so are the aggregation
    facts and the quality checks, all linked to ``ingestion_id``.
    """
    started = time.time()
    clean_path = os.path.join(out_root, "clean")
    seen = Observation(f"cleaning_{time.time_ns()}")
    rows = clean.clean_counted(raw, rules, seen, ledger.check_counts(raw, rules)).withColumn("YEAR", F.year("DATE"))
    parts = files.DEFAULT_PARTITIONING["clean"]
    try:
        clean_meta = files.sink_parquet(rows, clean_path, parts)
    except Exception as exc:
        if ledger_root:
            failed = ledger.transformation_row(
                "clean", None, None, time.time() - started, clean_path, {"rules": rules.__dict__},
                ingestion_id, "CLEANING", "FAILED", str(exc),
            )
            ledger.record_transformations(spark, os.path.join(ledger_root, LEDGER_TABLES[0]), [failed])
        raise
    clean_time = time.time() - started

    # the declared schema also reads a dataset without any row; YEAR comes from the folders
    stored = files.scan_dataset(spark, out_root, "clean", rows.schema).drop("YEAR")
    # the only pass over the cleaned rows: all levels and the facts are rolled up from its days
    # (the codes read the two station columns once more)
    states = cut_lineage(aggregate.day_states(stored, aggregate.station_codes(stored)), "day-states")
    daily = aggregate.daily(states)
    # facts and quality checks fill the cores beside the others
    side = ThreadPoolExecutor(max_workers=2)
    records = _side_records(side, spark, states, files.observed_all(seen), raw.columns, rules, ledger_root, ingestion_id) if ledger_root else []
    results = files.save_all(
        {"daily": daily, "monthly": aggregate.monthly(states), "seasonal": aggregate.seasonal(states)},
        out_root,
    )
    failed_daily = results.where("dataset_name = 'daily' AND error IS NOT NULL").select("error").collect()

    def trends() -> DataFrame:
        if failed_daily:
            raise RuntimeError(f"daily was not stored: {failed_daily[0]['error']}")
        return trend.trends(files.scan_dataset(spark, out_root, "daily", daily.schema), materialize=False)

    all_results = results.unionByName(files.save_all({"trends": trends}, out_root, spark=spark))
    if ledger_root:
        n_raw = files.observed(seen, "_total")
        steps = [
            ledger.transformation_row(
                "clean", n_raw, clean_meta["record_count"], clean_time,
                clean_meta["output_path"], {"rules": rules.__dict__}, ingestion_id, kind="CLEANING",
            )
        ]
        written = {r["dataset_name"]: r for r in all_results.collect()}  # 4 rows
        for name, r in written.items():
            source = written["daily"]["record_count"] if name == "trends" else clean_meta["record_count"]
            status = "SUCCESS" if r["error"] is None else "FAILED"
            steps.append(
                ledger.transformation_row(
                    name, source, r["record_count"], r["duration_seconds"], r["output_path"], None,
                    ingestion_id, "AGGREGATION", status, r["error"],
                )
            )
        ledger.record_transformations(spark, os.path.join(ledger_root, LEDGER_TABLES[0]), steps)
    for record in records:
        record.result()  # a failed write raises here
    side.shutdown()
    return all_results


def _side_records(
    pool: ThreadPoolExecutor, spark: SparkSession, states: DataFrame, counts: dict, columns: list[str],
    rules: ValidationRules, ledger_root: str, ingestion_id: str | None,
) -> list[Future]:
    """Puts the aggregation facts and the quality checks into their ledger tables, side by side."""
    steps = {} if ingestion_id is None else {s: ledger.transformation_id(ingestion_id, s) for s in set(ledger.FACT_STEPS.values())}
    frames = {
        LEDGER_TABLES[1]: ledger.linked_facts(ledger.aggregation_facts(states), steps),
        LEDGER_TABLES[2]: ledger.observed_checks(spark, counts, columns, rules),
    }
    return [pool.submit(ledger.put_run, df, os.path.join(ledger_root, table), ingestion_id) for table, df in frames.items()]


def ingest_and_batch(
    spark: SparkSession,
    landing: str,
    sink: str,
    out_root: str,
    ledger_root: str,
    fmt: str = "csv",
    checkpoint: str | None = None,
    rules: ValidationRules = DEFAULT_RULES,
) -> DataFrame:
    """Ingest what has landed, record the run, and run the batch over the whole sink."""
    from nimbus.schema import OBSERVATION
    from nimbus.streaming import ingest

    ingestion_id = ingest_recorded(spark, landing, sink, ledger_root, fmt, checkpoint)
    return run_batch(spark, ingest.read_sink(spark, sink, OBSERVATION), out_root, ledger_root, rules, ingestion_id)


def ingest_recorded(
    spark: SparkSession, landing: str, sink: str, ledger_root: str, fmt: str = "csv", checkpoint: str | None = None
) -> str:
    """One ingest run and its row in the ingestion ledger (also when it fails); the row's id."""
    from nimbus.streaming import ingest

    started, ingestion_id = time.time(), str(uuid.uuid4())
    ledger_path = os.path.join(ledger_root, "ingestion_metadata")
    common = {"source_path": landing, "ingestion_id": ingestion_id}
    kind = "JSON" if fmt == "json" else "CSV"
    try:
        run = ingest.ingest_payloads if fmt == "json" else ingest.resumable_ingest
        totals = ingest.ingest_totals(run(spark, landing, sink, checkpoint)).collect()[0]
    except Exception as exc:
        ledger.record_ingestion(
            spark, ledger_path, kind, os.path.basename(landing.rstrip("/")), status="FAILED",
            duration_seconds=time.time() - started, error_message=str(exc), **common,
        )
        raise
    ledger.record_ingestion(
        spark, ledger_path, kind, os.path.basename(landing.rstrip("/")), totals["rows"], totals["valid_rows"],
        totals["failed_rows"], "PARTIAL" if totals["failed_rows"] else "SUCCESS", time.time() - started,
        totals["valid_percent"], details={"batches": totals["batches"]}, **common,
    )
    return ingestion_id


def process_latest(
    spark: SparkSession,
    landing: str,
    out_root: str,
    ledger_root: str | None = None,
    schema=None,
    rules: ValidationRules = DEFAULT_RULES,
) -> DataFrame:
    """Run the batch on the newest CSV landing under ``landing`` (all its part files)."""
    from nimbus.schema import OBSERVATION

    latest = files.latest_landing(spark, landing, "*.csv").first()
    if latest is None:
        raise FileNotFoundError(f"no CSV file under {landing}")
    raw = files.scan_csv(spark, latest["path"], schema or OBSERVATION)
    return run_batch(spark, raw, out_root, ledger_root, rules)
