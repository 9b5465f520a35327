"""Planted faults reach every integrity counter; the cubes and the quirk from the pairs equal the cells."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlens import spec as S
from cohortlens.operators import integrity as Q
from cohortlens.operators import mix as M
from cohortlens.operators import retention as R
from cohortlens.plans import analysis as A
from cohortlens.plans import catalog
from cohortlens.sources.faults import with_faults
from conftest import SF_SMALL
from parity import _key, _norm
from test_plans import _plan


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)


@pytest.fixture(scope="module")
def faulty(spark):
    return catalog.faulty_analysis(spark, SF_SMALL)


def test_every_counter_is_above_zero(spark, faulty):
    report = {r["check_name"]: r["n"] for r in faulty.reports()["integrity_report"]().collect()}
    assert len(report) == 15 and all(n > 0 for n in report.values()), report


def test_faults_follow_the_keys_not_the_layout(spark, small_cells):
    act, prog = small_cells
    one = [df.groupBy().agg(F.count("*"), F.sum(F.xxhash64(*df.columns) % 1_000_003)).first() for df in with_faults(act, prog)]
    two = [df.groupBy().agg(F.count("*"), F.sum(F.xxhash64(*df.columns) % 1_000_003)).first()
           for df in with_faults(act.repartition(5, S.COUNTRY), prog.repartition(3))]
    assert one == two


def test_cells_without_a_key_get_no_fault(spark):
    row = (None, None, None, None, None, 0, 10, 10, 50.0)
    act = spark.createDataFrame([row] * 3, S.ACTIVITY_SCHEMA)
    prog = spark.createDataFrame([(None, None, None, None, None, 0, 1, 2, 1, 1, 2, 3.0)], S.PROGRESSION_SCHEMA)
    a, p = with_faults(act, prog)
    assert [tuple(r) for r in a.collect()] == [row] * 3 and p.count() == 1


@pytest.mark.parametrize("name", ["duplicate_act_keys", "duplicate_prog_keys", "playtime_quirk_cells", "playtime_quirk",
                                  "mix_balance", "retention_slice", "retention_slice_curve", "level_by_country"])
def test_faulty_rollups_equal_cells(spark, faulty, name):
    """Duplicated keys, orphans and odd cells: pairs and cubes give what the cells give."""
    plain = A.prepare(spark, faulty.act, faulty.prog, catalog.SPEC, catalog.PARAMS, rollups=False)
    assert rows(faulty.reports()[name]()) == rows(plain.reports()[name]())


def test_quirk_reads_no_activity_on_clean_cells(spark, faulty):
    """Without duplicated keys the quirk is a filter of the pairs: no join, and no scan of the cells."""
    clean = catalog.analysis(spark, SF_SMALL)
    for name in ("playtime_quirk_cells", "playtime_quirk"):
        plan = _plan(clean.reports()[name]())
        assert "Join" not in plan and "cohortlens-fixture" not in plan, plan
    flagged = _plan(faulty.reports()["playtime_quirk_cells"]())
    assert "BroadcastHashJoin" in flagged and "SortMergeJoin" not in flagged   # rows under duplicated keys only


@pytest.mark.parametrize("name", ["mix_balance", "mix_max_gap", "retention_slice", "retention_slice_curve", "level_by_country"])
def test_dimension_reports_read_one_part_of_a_cube(spark, name):
    plan = _plan(catalog.analysis(spark, SF_SMALL).reports()[name]())
    assert "cohortlens-fixture" not in plan and "_cube" in plan, plan
    filters = [line for line in plan.splitlines() if line.strip().startswith("PartitionFilters")]
    assert filters and all("dim" in line for line in filters), plan


def test_cube_keeps_null_values_apart_from_totals(spark, small_cells):
    act, _ = small_cells
    nulls = act.withColumn(S.COUNTRY, F.when(F.col(S.COUNTRY) != "NATION_2", F.col(S.COUNTRY)))
    cube = A.activity_cube(nulls, catalog.SPEC)
    total = nulls.agg(F.sum(S.ACTIVE), F.count("*")).first()
    for dim in [A.ALL_CELLS, *(n for n, _ in catalog.SPEC.dims)]:
        assert cube.filter(F.col("dim") == dim).agg(F.sum(S.ACTIVE), F.sum(A.CELLS)).first() == total
    missing = nulls.filter(F.col(S.COUNTRY).isNull()).agg(F.sum(S.ACTIVE)).first()[0]
    assert missing and cube.filter("dim = 'country' AND val IS NULL").agg(F.sum(S.ACTIVE)).first()[0] == missing
    w = catalog.analysis(spark, SF_SMALL).window
    assert rows(M.mix_balance_from_cube(cube, w, catalog.SPEC)) == rows(M.mix_balance(nulls, w, catalog.SPEC))
    by_network = A.cube_part(cube, "network", S.NETWORK)
    value = act.first()[S.NETWORK]
    assert rows(R.retention_slice(by_network, w, S.NETWORK, value, catalog.SPEC)) == rows(
        R.retention_slice(nulls, w, S.NETWORK, value, catalog.SPEC))


def test_slice_by_a_column_that_is_no_dimension_reads_the_cells(spark, small_cells):
    import dataclasses

    spec = dataclasses.replace(catalog.SPEC, dims=(("network", S.NETWORK),))
    a = A.prepare(spark, *small_cells, spec, catalog.PARAMS)
    assert rows(a.reports()["retention_slice"]()) == rows(catalog.queries()["retention_slice"](spark, SF_SMALL))
    assert {r["dim"] for r in a.reports()["mix_balance"]().collect()} == {"network"}


def test_quirk_beyond_the_broadcast_bound(spark, faulty, monkeypatch):
    expected = rows(faulty.reports()["playtime_quirk_cells"]())
    monkeypatch.setattr(Q, "BROADCAST_KEYS", 0)
    assert rows(faulty.reports()["playtime_quirk_cells"]()) == expected
