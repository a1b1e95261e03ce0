"""Command line: ``python -m wardline <command>``.

  prepare --sf-dir DIR --out SNAP        derive the 17 tables from test data, save a snapshot
  list                                   registered job names
  run JOB --tables SNAP --out DIR        run a job over a snapshot and write the result
      --format parquet|json|show [--keys K1,K2,...]
      [--complaint C --date-from D --date-to D]   (q11)
      [--input-bytes N]                      size shuffles for an input of N bytes

Results are written as new directories (never overwriting); ``show`` prints
the first rows instead.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from wardline.plans import reports as R
from wardline.plans.registry import JOBS, KEYED_JOBS
from wardline.session import local_session, size_shuffles
from wardline.sources.fixtures import build_tables
from wardline.sources.store import export_text, load_tables, save_tables, write_json, write_snapshot


def _job(name: str, args: argparse.Namespace):
    if name == "q11_complaint_daterange":
        given = [args.complaint, args.date_from, args.date_to]
        if any(given) and not all(given):
            raise SystemExit("q11 needs --complaint, --date-from and --date-to")
        if all(given):
            return lambda t: R.q11_complaint_daterange(t, *given)
    elif args.complaint or args.date_from or args.date_to:
        raise SystemExit(f"{name} takes no complaint or dates")
    job = JOBS[name]
    if args.keys:
        keys = [k.strip() for k in args.keys.split(",") if k.strip()]
        if name not in KEYED_JOBS:
            raise SystemExit(f"{name} takes no keys")
        return lambda t: job(t, **{KEYED_JOBS[name]: keys})
    return job


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="wardline")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("prepare")
    p.add_argument("--sf-dir", required=True)
    p.add_argument("--out", required=True)
    sub.add_parser("list")
    r = sub.add_parser("run")
    r.add_argument("job", choices=sorted(JOBS))
    r.add_argument("--tables", required=True)
    r.add_argument("--out")
    r.add_argument("--format", choices=["parquet", "json", "show"], required=True)
    r.add_argument("--keys")
    r.add_argument("--complaint")
    r.add_argument("--date-from")
    r.add_argument("--date-to")
    r.add_argument("--input-bytes", type=int)
    args = ap.parse_args(argv)

    if args.cmd == "list":
        print("\n".join(sorted(JOBS)))
        return
    spark = SparkSession.getActiveSession() or local_session()
    if args.cmd == "prepare":
        save_tables(build_tables(spark, args.sf_dir), args.out)
        return
    if args.input_bytes:
        size_shuffles(spark, args.input_bytes)
    df = _job(args.job, args)(load_tables(spark, args.tables))
    if args.format == "show":
        export_text(df).show(20, truncate=False)
    elif not args.out:
        raise SystemExit("--out is required for parquet/json")
    elif args.format == "parquet":
        write_snapshot(df, args.out)
    else:
        write_json(df, args.out)


if __name__ == "__main__":
    main()
