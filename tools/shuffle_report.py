"""Shuffle bytes and task time per report of one full analysis run.

    python tools/shuffle_report.py /root/testdata/sf0.1 [scratch_dir]

Runs ``run_analysis`` with Spark's event log written to a scratch folder,
then sums, per job description ("cohortlens prepare …" / "cohortlens report
…"), the shuffle bytes written and the executor run time of its tasks.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv: list[str]) -> None:
    from pyspark.sql import SparkSession

    from cohortlens.plans import catalog
    from cohortlens.plans.analysis import run_analysis
    from cohortlens.session import shared_dir
    from cohortlens.sources.fixture import fixture_tables

    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    scratch = argv[1] if len(argv) > 1 else tempfile.mkdtemp(prefix="shuffle-report-")
    logs = os.path.join(scratch, "events")
    os.makedirs(logs, exist_ok=True)
    spark = (SparkSession.builder.master("local[8]").appName("cohortlens-shuffle-report")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "16")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logs)
             .config("spark.eventLog.rolling.enabled", "false")
             .config("spark.eventLog.compress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    act, prog = fixture_tables(spark, sf_dir)
    run_analysis(spark, act, prog, os.path.join(scratch, "out"), catalog.SPEC, catalog.PARAMS)
    spark.stop()

    stage_desc, totals = {}, defaultdict(lambda: [0, 0, 0])
    for path in glob.glob(os.path.join(logs, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description", "")
                    for sid in ev.get("Stage IDs", []):
                        stage_desc[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    desc = stage_desc.get(ev.get("Stage ID"), "")
                    if not desc.startswith("cohortlens"):
                        continue
                    m = ev.get("Task Metrics") or {}
                    w = (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    totals[desc][0] += w
                    totals[desc][1] += m.get("Executor Run Time", 0)
                    totals[desc][2] += 1
    print("| job | shuffle written | task time | tasks |\n|---|---|---|---|")
    for desc, (w, t, n) in sorted(totals.items(), key=lambda kv: -kv[1][0]):
        print(f"| {desc.replace('cohortlens ', '')} | {w / 1e6:.2f} MB | {t / 1e3:.2f} s | {n} |")


if __name__ == "__main__":
    main(sys.argv[1:])
