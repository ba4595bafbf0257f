"""Command line: ``python -m nimbus <command> ...``.

  batch   --input PATH [--format csv|json|parquet] --out DIR [--ledger DIR] [--latest]
          clean, aggregate and store daily / monthly / seasonal / trends
  ingest  --landing DIR --sink DIR [--format csv|json] [--checkpoint DIR] [--ledger DIR]
          append files landed since the last run
  run     --landing DIR --sink DIR --out DIR --ledger DIR [--format csv|json] [--checkpoint DIR]
          ingest, then batch over the sink, with every step in the ledger
  query   NAME --sf DIR [--rows N]
          run a registered query on a folder of driver tables and show it

The session comes from ``spark-submit`` / the environment; ``--master`` is
only for local runs.
"""

from __future__ import annotations

import argparse
import sys

from nimbus.schema import OBSERVATION
from nimbus.session import build_session


def _raw(spark, path: str, fmt: str):
    from nimbus.sources import files, payload

    if fmt == "json":
        return payload.flatten_payload(files.scan_raw_json(spark, path))
    if fmt == "parquet":
        return spark.read.schema(OBSERVATION).parquet(path)
    return files.scan_csv(spark, path)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="nimbus")
    parser.add_argument("--master", default=None)
    sub = parser.add_subparsers(dest="command", required=True)

    b = sub.add_parser("batch")
    b.add_argument("--input", required=True)
    b.add_argument("--format", choices=["csv", "json", "parquet"], default="csv")
    b.add_argument("--out", required=True)
    b.add_argument("--ledger", default=None)
    b.add_argument("--latest", action="store_true", help="only the newest CSV landing under --input")

    i = sub.add_parser("ingest")
    i.add_argument("--landing", required=True)
    i.add_argument("--sink", required=True)
    i.add_argument("--format", choices=["csv", "json"], default="csv")
    i.add_argument("--checkpoint", default=None)
    i.add_argument("--ledger", default=None)

    r = sub.add_parser("run")
    for option in ("--landing", "--sink", "--out", "--ledger"):
        r.add_argument(option, required=True)
    r.add_argument("--format", choices=["csv", "json"], default="csv")
    r.add_argument("--checkpoint", default=None)

    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--sf", required=True)
    q.add_argument("--rows", type=int, default=20)

    args = parser.parse_args(argv)
    spark = build_session(args.master, app_name=f"nimbus-{args.command}")

    if args.command == "batch":
        from nimbus.plans import batch

        if args.latest:
            result = batch.process_latest(spark, args.input, args.out, args.ledger)
        else:
            result = batch.run_batch(spark, _raw(spark, args.input, args.format), args.out, args.ledger)
        result.show(truncate=False)
    elif args.command == "ingest":
        from nimbus.plans import batch
        from nimbus.streaming import ingest

        if args.ledger:
            batch.ingest_recorded(spark, args.landing, args.sink, args.ledger, args.format, args.checkpoint)
        elif args.format == "json":
            ingest.ingest_payloads(spark, args.landing, args.sink, args.checkpoint)
        else:
            ingest.resumable_ingest(spark, args.landing, args.sink, args.checkpoint)
        ingest.ingest_totals(ingest.ingest_history(spark, args.sink)).show(truncate=False)
        ingest.ingest_share(spark, args.landing, args.sink, args.checkpoint).show(truncate=False)
    elif args.command == "run":
        from nimbus.plans import batch

        batch.ingest_and_batch(
            spark, args.landing, args.sink, args.out, args.ledger, args.format, args.checkpoint
        ).show(truncate=False)
    else:
        from nimbus.plans import catalog

        if args.name not in catalog.QUERIES:
            print(f"unknown query {args.name!r}; known: {', '.join(sorted(catalog.QUERIES))}")
            return 2
        catalog.QUERIES[args.name](spark, args.sf).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
