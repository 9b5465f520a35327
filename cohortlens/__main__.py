"""Command line: run the analysis, or one report, over two cell tables.

    python -m cohortlens run  --activity A --progression P --out DIR [--format csv]
    python -m cohortlens show retention_curve --activity A --progression P
    python -m cohortlens nightly --activity A --progression P --root DIR
    python -m cohortlens published retention_curve --root DIR [--run-id ID]
    python -m cohortlens list

``--base/--cand/--horizon`` choose the builds; every report parameter of
``AnalysisParams`` has an option of its name.  ``run --publish`` and ``nightly``
publish a run when it is whole; ``run --format csv --bad-records quarantine``
keeps records that are no cells under ``OUT/quarantine``.  On a cluster, submit with
``spark-submit -m cohortlens ...`` and a shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from cohortlens import fixed

from cohortlens.plans.analysis import AnalysisParams, prepare, run_analysis
from cohortlens.sources.cells import (
    read_activity, read_activity_checked, read_progression, read_progression_checked, write_cells)
from cohortlens.sources.partitions import window_from_partitions
from cohortlens.spec import CohortSpec


def _analysis(spark: SparkSession, args: argparse.Namespace) -> tuple:
    """(activity, progression, spec, window); the window of Parquet cells comes from their folders."""
    act = read_activity(spark, args.activity, args.format)
    stored = args.activity if args.format == "parquet" else None
    prog = read_progression(spark, args.progression, args.format)
    if args.cmd == "run" and args.format == "csv":   # read each CSV once
        if args.bad_records == "quarantine":
            act, bad_act = read_activity_checked(spark, args.activity)
            prog, bad_prog = read_progression_checked(spark, args.progression)
            for name, bad in (("activity", bad_act), ("progression", bad_prog)):
                bad.write.mode("overwrite").parquet(f"{args.out}/quarantine/{name}")
        for name, df in (("activity", act), ("progression", prog)):
            write_cells(df, f"{args.out}/cells/{name}")
        stored = f"{args.out}/cells/activity"
        act = read_activity(spark, stored)
        prog = read_progression(spark, f"{args.out}/cells/progression")
    spec = CohortSpec(base=args.base, cand=args.cand, horizon=args.horizon)
    expected = getattr(args, "expected_extract", None)
    return act, prog, spec, window_from_partitions(spark, stored, spec, expected) if stored else None


_TUPLES = {f.name for f in fields(AnalysisParams) if isinstance(f.default, tuple)}


def _add_params(p: argparse.ArgumentParser) -> None:
    """An option per report parameter: ``--break-level 7``, ``--reach-levels 1,7,8``."""
    def numbers(text: str) -> tuple[int, ...]:
        return tuple(int(x) for x in text.split(","))
    for f in fields(AnalysisParams):
        kind = numbers if f.name in _TUPLES else str if isinstance(f.default, str) else int
        p.add_argument(f"--{f.name.replace('_', '-')}", type=kind, default=f.default,
                       help=f"report parameter (default {f.default})")


def _params(args: argparse.Namespace) -> AnalysisParams:
    return AnalysisParams(**{f.name: getattr(args, f.name) for f in fields(AnalysisParams)})


def _published(spark: SparkSession, args: argparse.Namespace) -> int:
    from cohortlens.plans import runs

    try:
        if args.report is None:
            df = runs.published_runs(spark, args.root).select("run_id", "published_at", "extract_date")
            df.orderBy("published_at").show(args.rows, truncate=False)
        else:
            runs.read_published(spark, args.root, args.report, args.run_id).show(args.rows, truncate=False)
    except runs.NoPublishedRun as none:
        print(none, file=sys.stderr)
        return 2
    return 0


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="cohortlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("run", "show", "nightly"):
        p = sub.add_parser(name)
        _add_params(p)
        if name == "show":
            p.add_argument("report")
            p.add_argument("--rows", type=int, default=100)
        p.add_argument("--activity", required=True)
        p.add_argument("--progression", required=True)
        if name != "nightly":   # which reads Parquet cells stored by install date
            p.add_argument("--format", choices=("csv", "parquet"), default="parquet")
        p.add_argument("--base", default=fixed.BASE_BUILD)
        p.add_argument("--cand", default=fixed.CANDIDATE_BUILD)
        p.add_argument("--horizon", type=int, default=fixed.HORIZON_DAYS)
        if name == "run":
            p.add_argument("--out", required=True)
            p.add_argument("--publish", action="store_true",
                           help="write the run under OUT/runs and publish it when it is whole")
            p.add_argument("--bad-records", choices=("stop", "quarantine"), default="stop",
                           help="what CSV records do that are no cells")
        if name == "nightly":
            p.add_argument("--root", required=True, help="holds the state and the published runs")
        if name != "show":
            p.add_argument("--expected-extract", type=dt.date.fromisoformat, metavar="YYYY-MM-DD",
                           help="stop unless the extract date derived from the data is this one")
            p.add_argument("--out-format", choices=("parquet", "json"), default="parquet")
            p.add_argument("--threads", type=int, default=16,
                           help="concurrent report jobs (small jobs: more than cores helps)")
    sub.add_parser("list")
    p = sub.add_parser("published", help="a report of a published run, or the runs")
    p.add_argument("report", nargs="?")
    p.add_argument("--root", required=True)
    p.add_argument("--run-id")
    p.add_argument("--rows", type=int, default=100)
    args = ap.parse_args(argv)

    if args.cmd == "list":
        from cohortlens.plans.analysis import REPORT_NAMES

        print("\n".join(REPORT_NAMES))
        return 0

    spark = SparkSession.builder.appName("cohortlens").getOrCreate()
    if args.cmd == "published":
        return _published(spark, args)
    if args.cmd == "nightly":
        from cohortlens.plans.nightly import nightly_run

        spec = CohortSpec(base=args.base, cand=args.cand, horizon=args.horizon)
        run, done = nightly_run(spark, args.activity, args.progression, args.root, spec, _params(args),
                                expected_extract=args.expected_extract, threads=args.threads,
                                out_format=args.out_format)
        print(f"{run.run_id}\tread {len(done.read)} of {len(done.dates)} install dates")
        return 0
    act, prog, spec, window = _analysis(spark, args)
    if args.cmd == "run":
        options = {"threads": args.threads, "out_format": args.out_format,
                   "analysis": prepare(spark, act, prog, spec, _params(args), window=window,
                                       expected_extract=args.expected_extract)}
        if args.publish:
            from cohortlens.plans.runs import published_run

            run = published_run(spark, act, prog, args.out, spec, _params(args), **options)
            paths = {name: f"{args.out}/{path}" for name, (path, _, _) in run.reports.items()}
        else:
            paths = run_analysis(spark, act, prog, args.out, spec, _params(args), **options)
        for name, path in sorted(paths.items()):
            print(f"{name}\t{path}")
        return 0
    analysis = prepare(spark, act, prog, spec, _params(args), rollups=False, window=window)
    reports = analysis.reports()
    if args.report not in reports:
        print(f"unknown report {args.report!r}; try 'list'", file=sys.stderr)
        return 2
    from cohortlens.plans.analysis import presentation_order

    df = reports[args.report]()
    order = presentation_order(args.report, df)
    (df.orderBy(*order) if order else df).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
