"""Command line: report parameters, quarantine, published and nightly runs."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlens import spec as S
from cohortlens.__main__ import main
from cohortlens.plans import runs
from cohortlens.sources.cells import write_cells
from cohortlens.sources.faults import csv_with_bad_records


@pytest.fixture(scope="module")
def cells(small_cells):
    """Two months of cells, by install date and as CSV with bad records."""
    base = tempfile.mkdtemp(prefix="cli-cells-", dir="/tmp")
    recent = [df.filter(F.col(S.INSTALL_DATE) >= F.lit("2001-06-01").cast("date")) for df in small_cells]
    for df, name in zip(recent, ("act", "prog"), strict=True):
        write_cells(df, f"{base}/{name}")
    csv_with_bad_records(recent[0]).write.option("header", True).csv(f"{base}/act-csv")
    recent[1].write.option("header", True).csv(f"{base}/prog-csv")
    return base


def test_report_parameters(cells, capsys):
    args = ["--activity", f"{cells}/act", "--progression", f"{cells}/prog", "--reach-levels", "1,3,5"]
    assert main(["show", "level_reach", *args]) == 0
    levels = [line.split("|")[1].strip() for line in capsys.readouterr().out.splitlines() if line.startswith("|")][1:]
    assert levels == ["1", "3", "5"]
    assert main(["show", "retention_slice", *args, "--slice-value", "NATION_3", "--slice-column", S.COUNTRY]) == 0
    assert "cohort_size" in capsys.readouterr().out


def test_publish_with_quarantine(spark, cells, capsys):
    out = tempfile.mkdtemp(prefix="cli-publish-", dir="/tmp")
    args = ["run", "--activity", f"{cells}/act-csv", "--progression", f"{cells}/prog-csv", "--format", "csv", "--out", out,
            "--threads", "4"]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        main([*args, "--publish"])   # the default stops at a bad record
    assert main(["published", "--root", out, "retention_curve"]) == 2   # and nothing is published
    assert main([*args, "--publish", "--bad-records", "quarantine"]) == 0
    printed = capsys.readouterr().out
    assert "/runs/" in printed and "typed_metrics" in printed
    bad = spark.read.parquet(f"{out}/quarantine/activity")
    assert bad.count() > 0 and {r[0] for r in bad.select("reason").distinct().collect()} <= {"malformed", "missing key"}
    kept = spark.read.parquet(f"{out}/cells/activity").count()
    assert kept + bad.count() == spark.read.option("header", True).csv(f"{cells}/act-csv").count()
    assert main(["published", "--root", out, "retention_curve"]) == 0
    assert "retention_pct" in capsys.readouterr().out


def test_nightly(spark, cells, capsys):
    root = tempfile.mkdtemp(prefix="cli-nightly-", dir="/tmp")
    args = ["nightly", "--activity", f"{cells}/act", "--progression", f"{cells}/prog", "--root", root, "--threads", "4"]
    assert main(args) == 0
    days = len([d for d in os.listdir(f"{cells}/act") if "=" in d])
    assert f"read {days} of {days} install dates" in capsys.readouterr().out
    assert main(args) == 0
    assert f"read 0 of {days} install dates" in capsys.readouterr().out
    assert runs.published_runs(spark, root).count() == 2
    assert main(["published", "--root", root]) == 0
    assert "published_at" in capsys.readouterr().out
