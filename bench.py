"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver), twice; the faster run is reported (the
first run of a plan also pays for code generation). The end-to-end batch run
(clean, aggregate, store four datasets and the ledger) is the headline value.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nimbus.plans import batch  # noqa: E402
from nimbus.plans import catalog  # noqa: E402
from nimbus.plans import frames as fr  # noqa: E402
from nimbus.session import build_session, unique_scratch  # noqa: E402

HEADLINE = [
    "clean",
    "daily",
    "monthly",
    "seasonal",
    "trends",
    "station_trends",
    "statistics",
    "histogram",
    "daily_query",
    "month_year_grid",
    "aggregation_facts",
    "quality_checks",
    "period_window",
    "seasonal_anomalies",
    "flatten_payload",
    "ingestion_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        f"local[{cpus}]",
        app_name="nimbus-bench",
        shuffle_partitions=cpus,
        extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    # warm-up: JVM JIT, file listing caches (also gives the row count), and
    # one full pass through cleaning and the daily aggregate
    rows = fr.raw(spark, sf_dir).count()
    for name in ("clean", "daily"):
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        timings[name] = round(min(runs), 3)

    runs = []
    for _ in range(2):
        t0 = time.perf_counter()
        out = unique_scratch(spark, "bench-batch")
        batch.run_batch(spark, fr.raw(spark, sf_dir), out, ledger_root=out + "/_ledger")
        runs.append(time.perf_counter() - t0)
    timings["batch_run"] = round(min(runs), 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "batch_run_seconds",
                "value": timings["batch_run"],
                "unit": "sec",
                "queries": timings,
                "total_query_seconds": round(sum(timings.values()), 3),
                "input_rows": rows,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
