"""The window from the date folders equals the window from a scan, and reads next to nothing."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortlens import spec as S
from cohortlens.operators.window import WindowError, derive_window
from cohortlens.plans.catalog import SPEC
from cohortlens.sources import partitions as P
from cohortlens.sources.cells import read_activity, write_cells
from test_plans import _plan


@pytest.fixture(scope="module")
def stored(spark, small_cells, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("by-date") / "act")
    write_cells(small_cells[0], path)
    # a later date whose files hold no row, and cells without a date
    days = small_cells[0].agg(F.max(S.INSTALL_DATE)).first()[0] + dt.timedelta(days=3)
    cells = small_cells[0].drop(S.INSTALL_DATE)
    cells.limit(0).coalesce(1).write.parquet(f"{path}/{S.INSTALL_DATE}={days}")
    cells.limit(2).coalesce(1).write.parquet(f"{path}/{S.INSTALL_DATE}=__HIVE_DEFAULT_PARTITION__")
    return path


def test_equals_the_scan(spark, stored):
    act = read_activity(spark, stored)
    assert act.filter(F.col(S.INSTALL_DATE).isNull()).count() == 2
    for spec in (SPEC, replace(SPEC, base=SPEC.cand, cand=SPEC.base), replace(SPEC, horizon=3)):
        assert P.window_from_partitions(spark, stored, spec) == derive_window(act, spec)


def test_blocks_reach_every_date(spark, stored):
    act = read_activity(spark, stored)
    days = P.listed_dates(spark, stored)
    held = sorted(r[0] for r in act.select(S.INSTALL_DATE).distinct().collect() if r[0])
    assert days[:-1] == held
    for day in held[:: max(1, len(held) // 5)]:
        rows = act.filter(F.col(S.INSTALL_DATE) >= F.lit(day))
        assert P._nearest(rows, days, "first") == day
        assert P._nearest(act.filter(F.col(S.INSTALL_DATE) <= F.lit(day)), days[::-1], "last") == day
    assert P._nearest(act.filter(F.lit(False)), days, "first") is None


def test_no_column_is_read_for_the_extract_date(spark, stored):
    act, days = read_activity(spark, stored), P.listed_dates(spark, stored)
    plan = _plan(P.rows_on(act, days[-2], days[-1]))
    assert "ReadSchema: struct<>" in plan and f"{S.INSTALL_DATE}" in plan.split("PartitionFilters", 1)[1].split("\n", 1)[0]
    plan = _plan(P.rows_on(act.filter(F.col(S.VERSION) == SPEC.cand), days[0], days[1]))
    assert f"ReadSchema: struct<{S.VERSION}:string>" in plan
    assert f"EqualTo({S.VERSION},{SPEC.cand})" in plan


def test_cells_not_stored_by_date_are_scanned(spark, small_cells, tmp_path):
    path = str(tmp_path / "flat")
    write_cells(small_cells[0], path, partition_by=None)
    assert P.listed_dates(spark, path) is None
    assert P.window_from_partitions(spark, path, SPEC) == derive_window(small_cells[0], SPEC)


def test_windows_that_cannot_be(spark, stored):
    with pytest.raises(WindowError, match="no installs"):
        P.window_from_partitions(spark, stored, replace(SPEC, cand="none"))
    with pytest.raises(WindowError, match="empty window"):
        P.window_from_partitions(spark, stored, replace(SPEC, horizon=5000))
    with pytest.raises(WindowError, match="differs"):
        P.window_from_partitions(spark, stored, SPEC, expected_extract=dt.date(2026, 5, 3))
