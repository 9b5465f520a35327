"""The rollup-backed reports equal the cell-backed ones, and a full run
writes every report plus the long metrics table."""

from __future__ import annotations

import tempfile

import pytest

from cohortlens.plans import catalog
from conftest import SF_SMALL
from parity import _key, _norm

NAMES = catalog.report_names()


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)


@pytest.mark.parametrize("name", NAMES)
def test_rollups_equal_cells(spark, name):
    rolled = catalog.queries(rollups=True)[name](spark, SF_SMALL)
    cells = catalog.queries(rollups=False)[name](spark, SF_SMALL)
    assert rolled.columns == cells.columns
    assert _rows(rolled) == _rows(cells)


def test_run_analysis_writes_everything(spark, small_cells):
    from cohortlens.plans.analysis import DETAIL_REPORTS, run_analysis

    act, prog = small_cells
    out = tempfile.mkdtemp(prefix="analysis-", dir="/tmp")
    paths = run_analysis(spark, act, prog, out, catalog.SPEC, catalog.PARAMS, threads=4)
    reports = [n for n in paths if n != "metrics"]
    assert set(reports) == set(NAMES) - {"fixture_activity", "fixture_progression"}
    metrics = spark.read.parquet(paths["metrics"])
    got = {r["report"] for r in metrics.select("report").distinct().collect()}
    assert "retention_curve" in got and "integrity_report" in got
    assert not (got & DETAIL_REPORTS)
    curve = spark.read.parquet(paths["retention_curve"])
    m = metrics.filter("report = 'retention_curve' AND metric = 'retention_pct'").count()
    assert m == curve.count()


def test_written_reports_are_ordered(spark, small_cells):
    from cohortlens.plans.analysis import run_analysis

    act, prog = small_cells
    out = tempfile.mkdtemp(prefix="ordered-", dir="/tmp")
    paths = run_analysis(spark, act, prog, out, catalog.SPEC, catalog.PARAMS, threads=4,
                         only=["retention_curve", "level_funnel", "mix_balance"])
    curve = [(r["version"], r["cohort_day"]) for r in spark.read.parquet(paths["retention_curve"]).collect()]
    assert curve == sorted(curve)
    levels = [r["i_level"] for r in spark.read.parquet(paths["level_funnel"]).collect()]
    assert levels == sorted(levels)
    mix = [(r["dim"], -r["pct_10_2"]) for r in spark.read.parquet(paths["mix_balance"]).collect()]
    assert mix == sorted(mix)


def test_concurrent_queries_share_one_build(spark):
    from concurrent.futures import ThreadPoolExecutor

    from cohortlens.sources import fixture

    names = ["retention_curve", "level_funnel", "mix_balance", "integrity_report"]
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda n: catalog.queries()[n](spark, SF_SMALL).count(), names))
    assert all(c > 0 for c in counts)
    keys = [k for k in fixture._MATERIALISED if k[1].endswith("sf0.001")]
    assert len(keys) == 1


def test_quirk_summary_from_flagged_cells_equals_join(spark, small_cells):
    from cohortlens.operators import integrity as Q
    from cohortlens.plans.analysis import activity_rollup

    act, prog = small_cells
    pairs = Q.cell_pairs(act, prog)
    direct = Q.playtime_quirk(act, pairs=pairs).collect()
    flagged = Q.playtime_quirk_cells(act, pairs=pairs)
    via_cells = Q.playtime_quirk_from(flagged, act).collect()
    via_rollup = Q.playtime_quirk_from(flagged, activity_rollup(act), row_count="n_cells").collect()
    assert direct == via_cells == via_rollup


def test_full_run_quirk_summary_matches_query(spark, small_cells):
    from cohortlens.plans.analysis import run_analysis

    act, prog = small_cells
    out = tempfile.mkdtemp(prefix="quirk-run-", dir="/tmp")
    paths = run_analysis(spark, act, prog, out, catalog.SPEC, catalog.PARAMS, threads=4,
                         only=["playtime_quirk", "playtime_quirk_cells"])
    written = spark.read.parquet(paths["playtime_quirk"])
    expected = catalog.queries()["playtime_quirk"](spark, SF_SMALL)
    assert _rows(written.select(*expected.columns)) == _rows(expected)


def test_full_run_mix_gap_matches_query(spark, small_cells):
    from cohortlens.plans.analysis import run_analysis

    act, prog = small_cells
    out = tempfile.mkdtemp(prefix="mix-run-", dir="/tmp")
    paths = run_analysis(spark, act, prog, out, catalog.SPEC, catalog.PARAMS, threads=4,
                         only=["mix_balance", "mix_max_gap"])
    written = spark.read.parquet(paths["mix_max_gap"])
    expected = catalog.queries()["mix_max_gap"](spark, SF_SMALL)
    assert _rows(written) == _rows(expected)


def test_unexpected_extract_stops_before_any_output(spark, small_cells):
    import datetime as dt
    import os

    from cohortlens.operators.window import WindowError
    from cohortlens.plans.analysis import run_analysis

    act, prog = small_cells
    out = tempfile.mkdtemp(prefix="analysis-", dir="/tmp")
    with pytest.raises(WindowError):
        run_analysis(spark, act, prog, out, catalog.SPEC, catalog.PARAMS,
                     expected_extract=dt.date(1999, 1, 1))
    assert os.listdir(out) == []
