"""Bad CSV records go to the quarantine, whatever is read; reports as SQL table functions."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlens import spec as S
from cohortlens.operators import retention as R
from cohortlens.operators.window import derive_window
from cohortlens.plans import catalog
from cohortlens.plans.sql import SQL_REPORTS, function_call, register_functions, sql_report
from cohortlens.sources import cells as C
from conftest import SF_SMALL
from parity import _key, _norm
from test_plans import _plan

HEADER = ",".join(reversed([f.name for f in S.ACTIVITY_SCHEMA.fields])) + ",note"
GOOD = ["50.5,12,10,0,p,n,US,10.2,2026-04-01,x", "1,2,3,1,p,n,US,11.0,2026-04-02,"]
BAD = {
    "oops,12,10,0,p,n,US,10.2,2026-04-01,x": "malformed",
    "50.5,1.5,10,0,p,n,US,10.2,2026-04-01,x": "malformed",
    "50.5,12,10,0,p,n,US,10.2,2026-14-01,x": "malformed",
    "50.5,12,10": "malformed",
    "50.5,12,10,0,p,n,US,10.2,2026-04-01,x,y,z": "malformed",
    "50.5,12,10,0,p,n,,10.2,2026-04-01,x": "missing key",
    "50.5,12,10,,p,n,US,10.2,2026-04-01,x": "missing key",
}


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)


@pytest.fixture(scope="module")
def csv_path():
    path = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write("\n".join([HEADER, GOOD[0], *BAD, GOOD[1]]) + "\n")
    return path


def test_bad_records_are_quarantined_and_clean_ones_kept(spark, csv_path):
    cells, quarantine = C.read_activity_checked(spark, csv_path)
    assert cells.schema == S.ACTIVITY_SCHEMA
    assert sorted(tuple(r) for r in cells.collect()) == [
        (dt.date(2026, 4, 1), "10.2", "US", "n", "p", 0, 10, 12, 50.5),
        (dt.date(2026, 4, 2), "11.0", "US", "n", "p", 1, 3, 2, 1.0)]
    got = quarantine.collect()
    assert sorted(r["reason"] for r in got) == sorted(BAD.values())
    assert {r["record"] for r in got if r["record"]} == {k for k, v in BAD.items() if v == "malformed"}
    assert all(r["file"].endswith("a.csv") for r in got)


def test_a_record_is_bad_whatever_is_read(spark, csv_path):
    """Reports that ask for few columns see the same cells (readers convert only what is asked for)."""
    cells, quarantine = C.read_activity_checked(spark, csv_path)
    assert cells.count() == cells.select(S.COUNTRY).count() == 2
    assert cells.agg(F.sum(S.ACTIVE)).first()[0] == 13
    counts = {r["check_name"]: r["n"] for r in C.quarantine_counts(quarantine).collect()}
    assert counts == {"malformed_records": 5, "missing_key_records": 2}


def test_clean_and_empty_files(spark, small_cells):
    path = tempfile.mkdtemp(prefix="csv-clean-", dir="/tmp") + "/act"
    act, prog = small_cells
    act.write.option("header", True).csv(path)
    cells, quarantine = C.read_activity_checked(spark, path)
    assert rows(cells) == rows(act) and quarantine.count() == 0
    assert {r["n"] for r in C.quarantine_counts(quarantine).collect()} == {0}
    prog.limit(50).write.option("header", True).csv(path + "-prog")
    assert C.read_progression_checked(spark, path + "-prog")[0].count() == 50
    with open(path + ".csv", "w") as f:
        f.write(HEADER + "\n")
    assert C.read_activity_checked(spark, path + ".csv")[0].count() == 0
    with pytest.raises(ValueError, match="columns missing"):
        C.read_progression_checked(spark, path)


def test_reports_run_on_the_clean_cells_of_a_dirty_file(spark):
    a = catalog.analysis(spark, SF_SMALL)
    cells, quarantine = catalog.csv_cells(a, SF_SMALL)
    assert quarantine.count() > 0
    clean = a.act.join(quarantine.select(*S.KEY6), S.KEY6, "left_anti").filter(F.col(S.COUNTRY).isNotNull())
    w = derive_window(cells, catalog.SPEC)
    assert rows(R.retention_naive(cells, catalog.SPEC)) is not None
    assert cells.count() <= clean.count() <= a.act.count()
    assert rows(R.retention_curve(cells, w, catalog.SPEC)) == rows(
        R.retention_curve(cells.repartition(3), w, catalog.SPEC))


@pytest.mark.parametrize("name", SQL_REPORTS)
def test_functions_equal_the_texts(spark, name):
    a = catalog.analysis(spark, SF_SMALL)
    C.register(spark, a.act, a.prog)
    assert f"mine_{name}" in register_functions(spark, a.window, a.spec, prefix="mine_")
    called = spark.sql(function_call(name, a.window, a.spec, a.params.slice_value, prefix="mine_"))
    text = sql_report(spark, name, a.window, a.spec, slice_value=a.params.slice_value)
    assert called.columns == text.columns and rows(called) == rows(text)
    empty = function_call(name, a.window, a.spec, "it's \\ nowhere", prefix="mine_")
    assert (spark.sql(empty).count() == 0) == ("slice" in name)


def test_function_arguments_reach_the_scan(spark):
    a = catalog.analysis(spark, SF_SMALL)
    C.register(spark, a.act, a.prog)
    register_functions(spark, a.window, a.spec, prefix="mine_")
    for name in ("retention_curve", "level_funnel"):
        plan = _plan(spark.sql(function_call(name, a.window, a.spec, prefix="mine_")))
        assert "Join" not in plan, plan
        pushed = [line for line in plan.splitlines() if line.strip().startswith("PushedFilters")]
        assert pushed and all(f"GreaterThanOrEqual(d_install_date,{a.window.start})" in p for p in pushed), plan


def test_functions_compose_with_sql(spark):
    a = catalog.analysis(spark, SF_SMALL)
    C.register(spark, a.act, a.prog)
    register_functions(spark, a.window, a.spec, prefix="mine_")
    call = function_call("retention_curve", a.window, a.spec, prefix="mine_").removeprefix("SELECT * FROM ")
    row = spark.sql(f"SELECT version, MAX(retention_pct) AS best FROM {call} WHERE cohort_day > 0 GROUP BY version").collect()
    curve = R.retention_curve(a.act, a.window, a.spec).filter("cohort_day > 0")
    assert {r["version"]: r["best"] for r in row} == {
        r["version"]: r["b"] for r in curve.groupBy("version").agg(F.max("retention_pct").alias("b")).collect()}
