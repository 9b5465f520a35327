"""Command line, stop-the-run rule and the report list."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest

from cohortlens import spec as S
from cohortlens.__main__ import main
from cohortlens.operators.integrity import IntegrityError
from cohortlens.plans import catalog
from cohortlens.plans.analysis import REPORT_NAMES, prepare, run_analysis


@pytest.fixture(scope="module")
def csv_cells(spark, small_cells):
    act, prog = small_cells
    d = tempfile.mkdtemp(prefix="cells-cli-", dir="/tmp")
    a, p = os.path.join(d, "act"), os.path.join(d, "prog")
    act.write.option("header", True).csv(a)
    prog.write.option("header", True).csv(p)
    return a, p


def test_report_names_are_complete(small_cells, spark):
    act, prog = small_cells
    names = set(prepare(spark, act, prog, rollups=False).reports())
    assert names == set(REPORT_NAMES)
    assert set(catalog.report_names()) == names | {"fixture_activity", "fixture_progression"}


def test_cli_show_reads_csv(csv_cells, capsys):
    a, p = csv_cells
    assert main(["show", "retention_curve", "--activity", a, "--progression", p,
                 "--format", "csv"]) == 0
    out = capsys.readouterr().out
    assert "retention_pct" in out and "100.0" in out


def test_cli_run_writes_reports(csv_cells, capsys):
    a, p = csv_cells
    out = tempfile.mkdtemp(prefix="cli-run-", dir="/tmp")
    assert main(["run", "--activity", a, "--progression", p, "--format", "csv",
                 "--out", out, "--threads", "4"]) == 0
    printed = capsys.readouterr().out
    assert "integrity_report" in printed and "metrics" in printed


def test_cli_run_writes_json(spark, csv_cells, capsys):
    a, p = csv_cells
    out = tempfile.mkdtemp(prefix="cli-json-", dir="/tmp")
    assert main(["run", "--activity", a, "--progression", p, "--format", "csv",
                 "--out", out, "--out-format", "json", "--threads", "4"]) == 0
    curve = spark.read.json(os.path.join(out, "retention_curve"))
    assert curve.count() == 16
    metrics = spark.read.json(os.path.join(out, "metrics"))
    assert metrics.filter("report = 'retention_curve'").count() == 16 * 4


def test_identity_break_stops_the_run(spark, small_cells):
    act, prog = small_cells
    broken = prog.unionByName(spark.createDataFrame(
        [(dt.date(2001, 7, 1), "10.2", "ZZ", "n", "p", 0, 1, 5, 3, 1, 5, 10.0)],
        S.PROGRESSION_SCHEMA))
    out = tempfile.mkdtemp(prefix="failon-", dir="/tmp")
    with pytest.raises(IntegrityError):
        run_analysis(spark, act, broken, out, catalog.SPEC, catalog.PARAMS, threads=2)
    assert not os.path.exists(os.path.join(out, "retention_curve"))


def test_other_stop_rules_use_the_integrity_report(spark, small_cells):
    act, prog = small_cells
    out = tempfile.mkdtemp(prefix="failon2-", dir="/tmp")
    with pytest.raises(IntegrityError):
        run_analysis(spark, act, prog, out, catalog.SPEC, catalog.PARAMS, threads=2,
                     fail_on=("identity_breaks", "act_cells_without_prog"))
    assert os.path.exists(os.path.join(out, "integrity_report"))
    assert not os.path.exists(os.path.join(out, "retention_curve"))
