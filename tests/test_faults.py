"""Fault injection: each integrity check fires exactly on planted faults, and
edge cases (empty input, absent candidate, zero denominators, NULL keys)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens import spec as S
from cohortlens.operators import integrity as Q
from cohortlens.operators import retention as R
from cohortlens.operators.window import WindowError, derive_window, quarantine, two_builds
from cohortlens.spec import CohortSpec

D = dt.date

# Planted faults (FIXTURES.md section 3), in the column order of the schemas.
PLANTED_ACT = [
    (D(2001, 7, 1), "10.2", "ZZ", "n", "p", 0, 10, 10, 100.0),
    (D(2001, 7, 1), "10.2", "ZZ", "n", "p", 0, 10, 10, 100.0),
    (D(2001, 7, 2), "10.2", "ZZ", "n", "p", 0, 5, -1, 100.0),
    (D(2001, 7, 31), "10.2", "ZZ", "n", "p", 0, 5, 5, 100.0),
    (D(2001, 7, 31), "10.2", "ZZ", "n", "p", 5, 2, 2, 10.0),
    (D(2001, 7, 3), "10.2", "ZZ", "n", "p", 1, 5, 5, 100.0),
    (D(2001, 7, 4), "10.2", "ZZ", "n", "p", 0, 5, 5, 100.0),
    (D(2001, 7, 4), "10.2", "ZZ", "n", "p", 1, 9, 9, 100.0),
    (D(2001, 7, 5), "10.2", "ZZ", "n", "p", 0, 1, 1, 90000.0),
    (D(2001, 7, 6), "10.2", "ZZ", "n", "p", 0, 3, 3, 0.0),
]
PLANTED_PROG = [
    (D(2001, 7, 1), "10.2", "ZZ", "n", "p", 0, 1, 5, 3, 1, 5, 10.0),
    (D(2001, 7, 4), "10.2", "ZZ", "n", "p", 0, 2, 3, 2, 1, 3, 10.0),
    (D(2001, 7, 4), "10.2", "ZZ", "n", "p", 0, 2, 3, 2, 1, 3, 10.0),
    (D(2001, 7, 10), "10.2", "ZZ", "n", "p", 0, 1, 2, 1, 1, 2, 10.0),
    (D(2001, 7, 5), "10.2", "ZZ", "n", "p", 0, 3, 1, 1, 0, 2, 10.0),
    (D(2001, 7, 6), "10.2", "ZZ", "n", "p", 0, 1, 0, 1, -1, 0, 0.0),
]
# Expected increase of each counter over the clean fixture.
EXPECTED_INCREASE = {
    "identity_breaks": 1, "negatives": 2, "dup_act": 1, "dup_prog": 1,
    "rows_beyond_extract": 1, "bad_cohort_cells": 2, "prog_cells_without_act": 1,
    "act_cells_without_prog": 5, "cells_sessions_lt_actives": 1,
    "cells_playtime_gt_24h": 1, "cells_users_gt_starts": 1,
}
SPEC = CohortSpec()


def _counters(act, prog):
    w = derive_window(act, SPEC)
    rows = Q.integrity_report(act, prog, w.extract, SPEC).collect()
    return {r["check_name"]: r["n"] for r in rows}, w


def _zero_pt(act, w):
    return sum(r["actives_zero_playtime"] for r in Q.zero_playtime_actives(act, w, SPEC).collect())


def test_planted_faults_fire_exactly(spark, small_cells):
    act, prog = small_cells
    clean, w = _counters(act, prog)
    bad_act = act.unionByName(spark.createDataFrame(PLANTED_ACT, S.ACTIVITY_SCHEMA))
    bad_prog = prog.unionByName(spark.createDataFrame(PLANTED_PROG, S.PROGRESSION_SCHEMA))
    dirty, w2 = _counters(bad_act, bad_prog)
    assert w2 == w
    for check, inc in EXPECTED_INCREASE.items():
        assert dirty[check] - clean[check] == inc, check
    assert dirty["act_rows"] - clean["act_rows"] == len(PLANTED_ACT)
    assert dirty["prog_rows"] - clean["prog_rows"] == len(PLANTED_PROG)
    assert _zero_pt(bad_act, w) - _zero_pt(act, w) == 3


def test_clean_fixture_counters_are_zero(small_cells):
    act, prog = small_cells
    counters, _ = _counters(act, prog)
    for check in ("identity_breaks", "negatives", "dup_act", "dup_prog", "rows_beyond_extract",
                  "bad_cohort_cells", "prog_cells_without_act", "cells_sessions_lt_actives",
                  "cells_playtime_gt_24h", "cells_users_gt_starts"):
        assert counters[check] == 0, check
    # Values measured on the fixture (FIXTURES.md section 2, sf0.001).
    assert counters["act_cells_without_prog"] == 34
    assert counters["missing_version_day_rows"] == 4116
    assert counters["install_date_gaps"] == 4168
    assert counters["act_rows"] == 5279 and counters["prog_rows"] == 31657


def test_empty_input_raises(spark):
    empty = spark.createDataFrame([], S.ACTIVITY_SCHEMA)
    with pytest.raises(WindowError):
        derive_window(empty, SPEC)


def test_missing_candidate_raises(spark, small_cells):
    act, _ = small_cells
    with pytest.raises(WindowError):
        derive_window(act.filter(F.col(S.VERSION) != SPEC.cand), SPEC)


def test_expected_extract_guard(small_cells):
    act, _ = small_cells
    with pytest.raises(WindowError):
        derive_window(act, SPEC, expected_extract=D(2026, 5, 3))
    assert derive_window(act, SPEC, expected_extract=D(2001, 8, 1)).extract == D(2001, 8, 1)


def test_zero_denominator_is_null_not_error(spark):
    rows = [(D(2001, 1, 1), "10.2", "X", "n", "p", 0, 0, 0, 0.0),
            (D(2001, 1, 1), "10.2", "X", "n", "p", 1, 0, 0, 0.0),
            (D(2001, 1, 1), "11.0", "X", "n", "p", 0, 4, 4, 10.0),
            (D(2001, 1, 9), "11.0", "X", "n", "p", 0, 4, 4, 10.0)]
    act = spark.createDataFrame(rows, S.ACTIVITY_SCHEMA)
    out = {r["s_app_version"]: r for r in R.retention_naive(act, SPEC).collect()}
    assert out["10.2"]["d1"] is None
    assert out["11.0"]["d1"] is None   # no day-1 row: unobserved, not zero


def test_null_key_is_orphan_and_one_group(spark):
    act_rows = [(D(2001, 1, 1), "10.2", None, "n", "p", 0, 1, 1, 1.0),
                (D(2001, 1, 1), "10.2", None, "n", "p", 0, 1, 1, 1.0)]
    prog_rows = [(D(2001, 1, 1), "10.2", None, "n", "p", 0, 1, 1, 1, 0, 1, 1.0)]
    act = spark.createDataFrame(act_rows, S.ACTIVITY_SCHEMA)
    prog = spark.createDataFrame(prog_rows, S.PROGRESSION_SCHEMA)
    assert Q.duplicate_keys(act, S.KEY6).count() == 1          # NULLs group together
    orphans = Q.orphan_cells(Q.progression_grain(prog), Q.activity_grain(act))
    assert orphans.count() == 1                                  # ...but never join


def test_quarantine_keeps_other_and_null_labels(spark):
    rows = [(D(2001, 1, 1), v, "X", "n", "p", 0, 1, 1, 1.0)
            for v in ("10.2", "11.0", "11.0.1", None)]
    act = spark.createDataFrame(rows, S.ACTIVITY_SCHEMA)
    assert two_builds(act, SPEC).count() == 2
    labels = sorted((r[S.VERSION] or "") for r in quarantine(act, SPEC).collect())
    assert labels == ["", "11.0.1"]


def test_all_null_measure(spark):
    rows = [(D(2001, 1, 1), "10.2", "X", "n", "p", 0, None, None, None),
            (D(2001, 1, 1), "11.0", "X", "n", "p", 0, None, None, None)]
    act = spark.createDataFrame(rows, S.ACTIVITY_SCHEMA)
    out = R.retention_naive(act, SPEC).collect()
    assert all(r["d1"] is None for r in out)


def test_duplicate_prog_keys_via_pairs(spark, small_cells):
    act, prog = small_cells
    dup_rows = [(D(2001, 7, 4), "10.2", "ZZ", "n", "p", 0, 2, 3, 2, 1, 3, 10.0),
                (D(2001, 7, 4), "10.2", "ZZ", "n", "p", 0, 2, 3, 2, 1, 3, 10.0),
                (D(2001, 7, 4), "10.2", None, "n", "p", 0, 2, 3, 2, 1, 3, 10.0),
                (D(2001, 7, 4), "10.2", None, "n", "p", 0, 2, 3, 2, 1, 3, 10.0)]
    bad = prog.unionByName(spark.createDataFrame(dup_rows, S.PROGRESSION_SCHEMA))
    pairs = Q.cell_pairs(act, bad)
    got = sorted((r[S.COUNTRY] or "", r["n"]) for r in Q.duplicate_prog_keys(bad, pairs).collect())
    brute = sorted((r[S.COUNTRY] or "", r["n"]) for r in Q.duplicate_keys(bad, S.KEY7).collect())
    assert got == brute == [("", 2), ("ZZ", 2)]


def test_duplicate_level_flag(spark):
    """Distinct levels: sum of 2**level equals their OR; anything else flags."""
    def prog_with(levels, country):
        return [(D(2001, 1, 1), "10.2", country, "n", "p", 0, lv, 1, 1, 0, 1, 1.0) for lv in levels]
    rows = (prog_with([1, 2, 3], "clean") + prog_with([1, 2, 2], "dup")
            + prog_with([None, None], "nulls") + prog_with([None, 4], "one_null")
            + prog_with([99], "odd") + prog_with([0, 30], "edges"))
    prog = spark.createDataFrame(rows, S.PROGRESSION_SCHEMA)
    act = spark.createDataFrame([], S.ACTIVITY_SCHEMA)
    pairs = Q.cell_pairs(act, prog, levels=(0, 30))   # a level beyond the masks is recounted
    flags = {r[S.COUNTRY]: r["p_dup_suspect"] for r in pairs.collect()}
    assert flags == {"clean": False, "dup": True, "nulls": True, "one_null": False,
                     "odd": True, "edges": False}
    flags = {r[S.COUNTRY]: r["p_dup_suspect"] for r in Q.cell_pairs(act, prog).collect()}
    assert flags["odd"] is False and flags["dup"] is True   # the derived range covers it
    exact = {r[S.COUNTRY] for r in Q.duplicate_prog_keys(prog, Q.cell_pairs(act, prog)).collect()}
    assert exact == {"dup", "nulls"}


def test_many_levels_flag_no_clean_group(spark):
    def prog_with(levels, country):
        return [(D(2001, 1, 1), "10.2", country, "n", "p", 0, lv, 1, 1, 0, 1, 1.0) for lv in levels]
    rows = (prog_with(range(1, 501), "clean") + prog_with([*range(1, 501), 437], "dup")
            + prog_with([-3, 59, 60, 500], "edges"))
    prog = spark.createDataFrame(rows, S.PROGRESSION_SCHEMA)
    pairs = Q.cell_pairs(spark.createDataFrame([], S.ACTIVITY_SCHEMA), prog)
    flags = {r[S.COUNTRY]: r["p_dup_suspect"] for r in pairs.collect()}
    assert flags == {"clean": False, "dup": True, "edges": False}
    assert [r[S.LEVEL] for r in Q.duplicate_prog_keys(prog, pairs).collect()] == [437]


def test_rows_beyond_extract_on_either_table(spark, small_cells):
    act, prog = small_cells
    w = derive_window(act, SPEC)
    future_prog = prog.unionByName(spark.createDataFrame(
        [(D(2001, 7, 31), "10.2", "ZZ", "n", "p", 5, 1, 1, 1, 0, 1, 1.0)], S.PROGRESSION_SCHEMA))
    assert Q.rows_beyond_extract(act, w.extract).first()[0] == 0
    assert Q.rows_beyond_extract(future_prog, w.extract).first()[0] == 1


def test_empty_window_raises(spark):
    # The candidate's first install is later than extract - horizon.
    rows = [(D(2001, 1, 1), "10.2", "X", "n", "p", 0, 5, 5, 10.0),
            (D(2001, 1, 5), "11.0", "X", "n", "p", 0, 5, 5, 10.0),
            (D(2001, 1, 8), "10.2", "X", "n", "p", 0, 5, 5, 10.0)]
    act = spark.createDataFrame(rows, S.ACTIVITY_SCHEMA)
    with pytest.raises(WindowError):
        derive_window(act, SPEC)


@pytest.mark.parametrize("horizon", [7, 59, 60, 61, 62, 63, 90, 365])
def test_missing_days_agree_with_the_detail_at_any_horizon(spark, small_cells, horizon):
    act, prog = small_cells
    spec = CohortSpec(horizon=horizon)
    gaps = act.filter("not (i_cohort_groups = 0 and day(d_install_date) % 5 = 0)")
    extract = D(2001, 12, 31)
    n = {r.check_name: r.n for r in Q.integrity_report(gaps, prog, extract, spec).collect()}
    assert n["missing_version_day_rows"] == Q.missing_cohort_days(gaps, extract, spec).count()


def test_unknown_check_name_raises(spark):
    report = spark.createDataFrame([("identity_breaks", 0)], "check_name string, n long")
    with pytest.raises(ValueError, match="identity_break"):
        Q.assert_clean(report, ("identity_break",))


@pytest.mark.parametrize("stray", [-1_000_000, 2_000_000_000])
def test_stray_level_flags_at_most_its_own_group(spark, stray):
    def prog_with(levels, country):
        return [(D(2001, 1, 1), "10.2", country, "n", "p", 0, lv, 1, 1, 0, 1, 1.0) for lv in levels]
    rows = prog_with([1, 2, 3, 700], "clean") + prog_with([1, 2, 2], "dup") + prog_with([1, stray], "stray")
    act = spark.createDataFrame([], S.ACTIVITY_SCHEMA)
    prog = spark.createDataFrame(rows, S.PROGRESSION_SCHEMA)
    flags = {r[S.COUNTRY]: r["p_dup_suspect"] for r in Q.cell_pairs(act, prog).collect()}
    assert flags == {"clean": False, "dup": True, "stray": False}   # the stray block has a mask of its own
    # more blocks than masks: those with most rows keep theirs, other groups are recounted exactly
    far = [r for k in range(30) for r in prog_with([stray + 60 * k * (1 if stray < 0 else -1)] * (k == 7) +
                                                   [stray + 60 * k * (1 if stray < 0 else -1)], f"far{k}")]
    many = spark.createDataFrame(rows + prog_with([1, 2, 3, 700], "clean2") + far, S.PROGRESSION_SCHEMA)
    pairs = Q.cell_pairs(act, many)
    flags = {r[S.COUNTRY]: r["p_dup_suspect"] for r in pairs.collect()}
    assert not flags["clean"] and not flags["clean2"] and flags["dup"]
    assert sum(flags.values()) < len(flags)
    exact = {r[S.COUNTRY] for r in Q.duplicate_prog_keys(many, pairs).collect()}
    assert exact == {"dup", "far7"}
    empty = spark.createDataFrame([], S.PROGRESSION_SCHEMA)
    assert Q.cell_pairs(act, empty).count() == 0 and Q.level_blocks(empty) == [0]
