"""Benchmark: every registered report at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Phases: (1) build the activity/progression cells from the driver tables and
write them to the shared folder; (2) the whole analysis as one run (window,
shared rollups, every report written, long metrics table) -- the headline
value; (3) every registered query on its own (cold) and the headline
reports again (warm).  For reference, the same report SQL is also timed in
DuckDB over the same cell files.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = ["retention_curve", "retention_maturity_gate", "mix_balance", "level_funnel",
            "integrity_report"]


def _sf(sf_dir: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", sf_dir)
    return float(m.group(1)) if m else sf_dir


def _timed(fn):
    t0 = time.perf_counter()
    out = fn()
    return out, time.perf_counter() - t0


def _run(df) -> int:
    # Force full evaluation without moving rows to the driver.
    return df.write.format("noop").mode("overwrite").save() or 0


def duckdb_times(act_path: str, prog_path: str, names: list[str], threads: int) -> dict:
    try:
        import duckdb
    except ImportError:
        return {}
    from cohortlens.plans import oracle as O

    con = duckdb.connect()
    con.execute(f"SET threads = {threads}")
    con.execute(f"CREATE VIEW act AS SELECT * FROM read_parquet('{act_path}/*.parquet')")
    con.execute(f"CREATE VIEW prog AS SELECT * FROM read_parquet('{prog_path}/*.parquet')")
    def fetch(sql: str):
        res = con.execute(sql)
        for attr in ("to_arrow_table", "fetch_arrow_table", "fetchall"):
            if hasattr(res, attr):
                return getattr(res, attr)()
        return None

    out = {}
    for name in names:
        sql = O.over_tables(O.ORACLE[name])
        _, sec = _timed(lambda: fetch(sql))
        out[name] = round(sec, 4)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(2 * cpus)))

    from cohortlens.plans import catalog
    from cohortlens.session import local_session
    from cohortlens.sources import fixture

    spark = local_session(cpus, shuffle_partitions=partitions, app_name="cohortlens-bench")

    import tempfile

    from cohortlens.plans.analysis import run_analysis

    (act, prog), build_sec = _timed(lambda: fixture.fixture_tables(spark, sf_dir))
    rows = {"act": act.count(), "prog": prog.count()}
    runs = []
    for _ in range(2):
        out = tempfile.mkdtemp(prefix="cohortlens-bench-")
        # Report jobs are small and latency-bound (planning, codegen, commit on
        # the driver), so twice as many submitters as cores keeps them overlapped.
        _, sec = _timed(lambda: run_analysis(spark, act, prog, out, catalog.SPEC, catalog.PARAMS,
                                             threads=2 * cpus))
        runs.append(round(sec, 3))
    ctx, prepare_sec = _timed(lambda: catalog.context(spark, sf_dir))

    queries = catalog.queries()
    cold = {}
    for name, q in queries.items():
        _, sec = _timed(lambda: _run(q(spark, sf_dir)))
        cold[name] = round(sec, 3)
    warm = {}
    for name in HEADLINE:
        _, sec = _timed(lambda: _run(queries[name](spark, sf_dir)))
        warm[name] = round(sec, 3)

    act_path, prog_path = fixture.fixture_paths(spark, sf_dir)
    try:
        duck = duckdb_times(act_path, prog_path, catalog.report_names(), cpus)
    except Exception as e:  # the reference timing must never break the bench line
        duck = {"error": str(e)[:200]}

    result = {
        "metric": "full_analysis_sec",
        "value": runs[0],
        "unit": "sec",
        "queries": cold,
        "sf": _sf(sf_dir),
        "full_analysis_warm_sec": runs[1],
        "all_queries_one_by_one_sec": round(sum(cold.values()), 3),
        "headline_warm_sec": warm,
        "headline_warm_total_sec": round(sum(warm.values()), 3),
        "build_cells_sec": round(build_sec, 3),
        "window_and_rollups_sec": round(prepare_sec, 3),
        "cells_rows": rows,
        "cores": cpus,
        "shuffle_partitions": partitions,
        "duckdb_same_sql_on_cells_sec": duck,
        "duckdb_total_sec": (round(sum(v for v in duck.values() if isinstance(v, float)), 3)
                             if duck else None),
        "window": [str(ctx.window.start), str(ctx.window.end), str(ctx.window.extract)],
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
